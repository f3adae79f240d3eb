import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from samples import prose

from scoreloom.llm import bytescan, simhash
from scoreloom.llm.common import stage
from scoreloom.llm.components import connected


def reference(text):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    ones = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        ones += [(h >> i) & 1 for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def components(prints):
    """Least id reachable over links of 2 bits or fewer, by brute force."""
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints_equal_the_definition(odd_rows, docs):
    texts = [r[1] for r in odd_rows if len(r[1] or "") < 5000] + [r.text for r in docs.limit(60).collect()]
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == [reference(t) for t in texts]


def test_values_within_two_bits_share_a_codeword():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 3000)
    for flips in (1, 2):
        y = x.copy()
        for _ in range(flips):
            y ^= 1 << rng.integers(0, 23, len(x))
        a, b = simhash.golay_indices(x), simhash.golay_indices(y)
        assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(a, b, strict=True))


def test_components_equal_brute_force(docs):
    found = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    prints = {i: r.fp % (1 << 64) for i, r in found.items()}
    assert {i: r.component_id for i, r in found.items()} == components(prints)


def test_large_buckets_keep_every_link(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 63))
    values = {centre}
    for _ in range(300):
        a, b = rng.integers(0, 64, 2)
        values.add(centre ^ (1 << int(a)) ^ (1 << int(b)))
    values |= {int(v) for v in rng.integers(0, 1 << 63, 200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    roots = {r.node: r.root for r in connected(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    truth = components({v: v % (1 << 64) for v in signed})
    groups = lambda m: {frozenset(k for k in signed if m.get(k, k) == g) for g in {m.get(k, k) for k in signed}}
    assert groups(roots) == groups(truth)


def test_odd_rows(odd, odd_rows, none):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == by[2] == 1 and by[7] == 6
    assert {by[3], by[4], by[5]} == {3}, "texts without a word have fingerprint zero"
    kept = simhash.drop_near_duplicates(odd)
    assert kept.schema == odd.schema
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 6, 8, 9, 9], "id 9 has two texts, each a document"
    assert simhash.simhash_components(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_rows_are_told_apart_by_fingerprint(spark, odd, odd_rows):
    kept = simhash.drop_near_duplicates(odd).where("doc_id is null").collect()
    assert [r.text for r in kept] == [odd_rows[6][1]], "its component has no id; the null text is a copy of document 3"
    a, b, c = (prose(k, 60) for k in (50, 51, 52))
    rows = [(1, a), (9, a), (9, b), (None, b), (None, c), (None, c)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted([(1, a), (9, b), (0, c), (0, c)])


def test_repeated_ids_and_rows_without_an_id(spark):
    a, b, c, d, e = (prose(k, 60) for k in (60, 61, 62, 63, 64))
    rows = [(1, a), (None, a), (None, b), (None, c), (5, d), (5, e), (5, e)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted([(1, a), (0, b), (0, c), (5, d), (5, e)])


def test_joins_on_a_hot_root_can_be_split(spark):
    """A star whose centre holds nearly all edges: the joins' larger sides are dealt to several tasks."""
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hot = spark.range(1, 60_000).selectExpr("0L as n", "id * 7919 as w").union(spark.range(200).selectExpr("id + 1 as n", "id as w"))
        least = stage(hot.groupBy("n").agg(F.min("w").alias("m")), "least")
        joined = hot.repartition(8).join(least, "n")
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        roots = connected(hot.select(F.col("n").alias("a"), F.col("w").alias("b")))
        assert roots.where("root = 0").count() == roots.count()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_xxh64_of_all_lengths():
    data = np.frombuffer(bytes(range(1, 200)) * 2, np.uint8)
    ends = np.arange(0, 150)
    assert bytescan.xxh64(data, np.zeros(150, np.int64), ends).tolist() == [xxhash.xxh64_intdigest(data[:e].tobytes(), 42) for e in ends]


def test_connected_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in connected(edges).collect()}
    assert all(roots[i] == 0 for i in range(41)) and roots[101] == roots[100] == 100
    assert connected(edges.where("a < 0").select(F.col("a"), F.col("b"))).count() == 0


def test_an_id_with_near_texts_keeps_the_one_of_least_hash(spark):
    base = prose(77, 400).split()
    near = next(t for k in range(400) for t in [" ".join([*base[:k], "changed", *base[k + 1 :]])] if 0 < (reference(t) ^ reference(" ".join(base))).bit_count() <= 2)
    rows = [(5, " ".join(base), 1), (5, near, 2), (5, near, 2), (5, prose(78, 300), 3), (9, near, 4), (6, None, 5), (6, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int").repartition(3)
    by_hash = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) as h").collect()}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text or "") for r in kept.collect())
    assert got == sorted([(5, min(rows[0][1], near, key=by_hash.get)), (5, rows[3][1]), (6, "")])
