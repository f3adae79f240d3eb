from scoreloom.llm import decontaminate as D


def brute(docs, items):
    sets = [(i, D.shingle_set(t)) for i, t in items]
    return sorted(((d, i, len(q & s), len(q)) for d, t in docs for s in [D.shingle_set(t)] for i, q in sets if q and 5 * len(q & s) >= 4 * len(q)), key=str)


def test_equals_brute_force(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    found = sorted(map(tuple, D.contained_items(docs, items).collect()), key=str)
    assert found == brute(plain, [(r.item_id, r.text) for r in items.collect()]) and found
    assert D.drop_contaminated(docs, items).count() == len(plain) - len({f[0] for f in found})


def test_partly_changed_and_short_items(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    near = words.copy()
    near[20] = "other"  # 5 of 36 shingles are lost
    far = words.copy()
    far[10] = far[25] = "other"
    docs = [(1, "intro " * 500 + " ".join(near) + " outro" * 500), (2, " ".join(far)), (3, "a b c"), (4, "x a b c"), (5, item.upper())]
    items = [(0, item), (1, "A b  c"), (2, None), (3, ""), (None, "a b c"), (0, item)]
    found = D.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 0), (5, 0), (3, 1), (3, None)}


def test_blocks_give_the_same(spark, sf_dir, docs, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(tuple, D.contained_items(docs, items).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 1500)
    assert len(list(D._blocks(items.select("item_id", "text")))) > 3
    assert sorted(map(tuple, D.contained_items(docs, items).collect())) == whole


def test_odd_rows(spark, odd, none, odd_rows):
    items = spark.createDataFrame([(1, odd_rows[0][1]), (None, None)], "item_id long, text string")
    found = D.contained_items(odd, items)
    assert sorted(r.doc_id for r in found.collect()) == [1, 1, 2]
    left = D.drop_contaminated(odd, items)
    assert left.schema == odd.schema and left.count() == len(odd_rows) - 3
    assert D.contained_items(none, items).count() == 0
    assert D.contained_items(odd, items.where("item_id = 77")).count() == 0
    assert D.drop_contaminated(odd, items.where("item_id = 77")).count() == len(odd_rows)
