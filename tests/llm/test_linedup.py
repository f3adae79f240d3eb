from collections import Counter

from pyspark.sql import functions as F
from samples import prose

from scoreloom.llm import linedup as L


def worded(text):
    return [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]


def shortest_runs(lines, least=20):
    """Bounds of the shortest runs of ``least`` words from each line on, and up to each line."""
    size, out = [len(x.split()) for x in lines], set()
    for i in range(len(lines)):
        out |= {(i, next(j for j in range(i, len(lines)) if sum(size[i : j + 1]) >= least))} if sum(size[i:]) >= least else set()
        out |= {(next(j for j in range(i, -1, -1) if sum(size[j : i + 1]) >= least), i)} if sum(size[: i + 1]) >= least else set()
    return out


def brute(docs):
    """Lines removed by document: each run's lines are aligned with those of the first document that holds the run."""
    lines = {i: worded(t) for i, t in docs}
    first, where = {}, {}
    for i in sorted(lines):
        where[i] = {}
        for a, b in shortest_runs(lines[i]):
            where[i].setdefault(tuple(lines[i][a : b + 1]), []).append(a)
        for run in where[i]:
            first.setdefault(run, i)
    out = {}
    for i in lines:
        gone = set()
        for f in {first[r] for r in where[i]} - {i}:
            left, right = ({p + k: x for r in where[i] if first[r] == f for p in where[d][r] for k, x in enumerate(r)} for d in (i, f))
            gone |= set(L.blocks(L.align(left, right), {p: len(x.split()) for p, x in enumerate(lines[i])}))
        out[i] = len(gone)
    return out


def patience(a, b):
    """Pairs of positions by patience diff, written anew: recursion over slices, the longest chain by comparing all."""
    if not a or not b:
        return []
    if a[0][1] == b[0][1]:
        return [(a[0][0], b[0][0]), *patience(a[1:], b[1:])]
    if a[-1][1] == b[-1][1]:
        return [*patience(a[:-1], b[:-1]), (a[-1][0], b[-1][0])]
    na, nb = Counter(x for _, x in a), Counter(x for _, x in b)
    once = [(i, next(j for j, y in enumerate(b) if y[1] == x)) for i, (_, x) in enumerate(a) if na[x] == nb[x] == 1]
    best = []
    for k, (_, j) in enumerate(once):
        best.append(max(([*best[m], k] for m in range(k) if once[m][1] < j), key=len, default=[k]))
    chain = [once[k] for k in max(best, key=len, default=[])]
    out, i0, j0 = [], 0, 0
    for i, j in chain:
        out += [*patience(a[i0:i], b[j0:j]), (a[i][0], b[j][0])]
        i0, j0 = i + 1, j + 1
    return out + (patience(a[i0:], b[j0:]) if chain else [])


def every_pair(docs, least=20):
    """Positions removed by document: all lines aligned with those of every earlier document, blocks taken from the pairs themselves."""
    lines = dict(sorted((i, worded(t)) for i, t in docs))
    out = {}
    for i in lines:
        out[i] = set()
        for f in lines:
            if f >= i:
                break
            both = set(lines[i]) & set(lines[f])
            if sum(len(x.split()) for x in lines[i] if x in both) < least:
                continue
            block = []
            for p, q in [*patience(*([(k, x) for k, x in enumerate(lines[d]) if x in both] for d in (i, f))), (-9, -9)]:
                if block and (p, q) != (block[-1][0] + 1, block[-1][1] + 1):
                    out[i] |= {k for k, _ in block} if sum(len(lines[i][k].split()) for k, _ in block) >= least else set()
                    block = []
                block.append((p, q))
    return out


def removed(docs, **options):
    rows = L.repeated_lines(docs, **options).collect()
    return {r.id: set(r.removed) for r in rows}


def test_equals_brute_force(docs):
    found = {r.doc_id: r.n for r in L.drop_repeated_lines(docs, count_col="n").collect()}
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found == expected and sum(found.values())


def test_recall_against_every_pair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found, truth = removed(docs), every_pair([(r.doc_id, r.text) for r in docs.collect()])
    all_found, all_true = ({(i, p) for i in x for p in x[i]} for x in (found, truth))
    recall, precision = len(all_found & all_true) / len(all_true), len(all_found & all_true) / len(all_found)
    print("recall", recall, "precision", precision, "of", len(all_true))
    assert recall >= 0.99 and precision >= 0.99


def test_passage_stays_in_the_first_document_only(spark):
    passage = "\n".join(prose(k, 18) for k in range(3))
    docs = [(i, f"{prose(100 + i, 30)}\n{passage}\n\n{prose(200 + i, 30)}\nAll rights reserved.") for i in range(6)]
    out = {r.doc_id: r.text for r in L.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == docs[0][1]
    for i in range(1, 6):
        assert out[i] == f"{prose(100 + i, 30)}\n{prose(200 + i, 30)}\nAll rights reserved."


def test_block_whose_lines_have_earlier_holders_of_their_own(spark):
    one, two, three = prose(1, 8), prose(2, 12), prose(3, 6)
    own = lambda k: prose(100 + k, 9)
    parts = [[own(0), one], [own(1), two], [own(2), three], [own(3), one, two, own(4)], [own(5), one, two, three], [own(6), two, three, one, own(7)], [one, two, own(8), two, three, one]]
    docs = [(i, "\n".join(p)) for i, p in enumerate(parts)]
    found = removed(spark.createDataFrame(docs, "doc_id long, text string"))
    assert found == {i: p for i, p in every_pair(docs).items() if p}
    assert len(found[4]) == 2 and 5 not in found and len(found[6]) == 5


def test_block_whose_lines_each_come_first_elsewhere(spark):
    block = [prose(300 + k, 8) for k in range(10)]
    docs = [(k, f"{prose(k, 30)}\n{block[k]}") for k in range(10)] + [(i, "\n".join([prose(i, 30), *block])) for i in (100, 101)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert removed(frame) == {101: set(range(1, 11))}
    assert removed(frame, least=81) == {} and removed(frame, least=80) == {101: set(range(1, 11))}
    assert {len(p) for i, p in removed(frame, least=8).items() if i >= 100} == {10}


def test_many_partners_give_rows_in_proportion(spark):
    """A document whose every line has a first holder of its own."""
    lines = [prose(500 + k, 25) for k in range(300)]
    docs = [(k, x) for k, x in enumerate(lines)] + [(1000, "\n".join(lines))]
    assert removed(spark.createDataFrame(docs, "doc_id long, text string")) == {1000: set(range(300))}


def test_workers_get_batches_of_bounded_size(spark, monkeypatch, tmp_path):
    """Long texts and long lists of shared runs: Spark's own batches, of 10,000 rows, would have 90 and 30 MB here."""

    def noted(name):
        made = getattr(L, name)

        def wrapped(least):
            def run(batches, inner=made(least)):
                def seen():
                    for batch in batches:
                        with (tmp_path / name).open("a") as f:
                            f.write(f"{batch.num_rows} {batch.nbytes}\n")
                        yield batch

                yield from inner(seen())

            return run

        monkeypatch.setattr(L, name, wrapped)

    for name in ("_run_batches", "_align_batches"):
        noted(name)
    text, n = "\n".join(prose(k, 20) for k in range(300)), 2500
    docs = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.lit("\nnumber "), F.col("id").cast("string")).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    out = L.drop_repeated_lines(docs, count_col="n").groupBy("n", F.col("text").startswith("number")).count().collect()
    assert {tuple(r) for r in out} == {(0, False, 1), (300, True, n - 1)}
    for name, rows in (("_run_batches", n), ("_align_batches", n - 1)):
        sizes = [tuple(map(int, x.split())) for x in (tmp_path / name).read_text().splitlines()]
        print(name, len(sizes), "batches, largest", max(b for _, b in sizes))
        assert sum(k for k, _ in sizes) == rows and max(b for _, b in sizes) <= 5 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_only_texts_that_change_go_to_the_workers(spark, monkeypatch, tmp_path):
    cut = L._without

    def noted(texts, removed):
        with (tmp_path / "texts").open("a") as f:
            f.write("".join(f"{x}\n" for x in texts.is_valid().to_pylist()))
        return cut(texts, removed)

    monkeypatch.setattr(L, "_without", noted)
    docs = [(k, prose(k % 40, 30)) for k in range(50)] + [(90, None), (91, "")]
    out = {r.doc_id: r.text for r in L.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {k: "" if 40 <= k < 50 else x for k, x in docs}
    assert Counter((tmp_path / "texts").read_text().split()) == {"True": 10, "False": 42}


def test_alignment():
    assert L.patience([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    assert L.align(dict(enumerate([1, 2, 3, 2])), dict(enumerate([9, 1, 2, 3]))) == [(0, 1), (1, 2), (2, 3)]
    assert L.align({}, {0: 1}) == []
    assert L.blocks([(0, 0), (1, 1), (3, 2)], {0: 12, 1: 9, 3: 30}, 20) == [0, 1, 3]
    assert L.blocks([(0, 0), (1, 2)], {0: 12, 1: 12}, 20) == []


def test_odd_rows(spark, odd, odd_rows, none):
    out = L.drop_repeated_lines(odd)
    assert out.schema == odd.schema
    before = Counter((r[0], r[1]) for r in odd_rows)
    after = Counter((r.doc_id, r.text) for r in out.collect())
    changed = before - after
    assert set(changed) == {(2, odd_rows[2][1]), (7, odd_rows[9][1])}
    assert after[(2, "")] == 1 and after[(7, "")] == 1 and after[(1, odd_rows[0][1])] == 2
    assert L.drop_repeated_lines(none).count() == 0
