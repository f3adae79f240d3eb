import math
import random
import re
from collections import Counter

import pytest
from samples import prose

from scoreloom.llm import search as S

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in PATTERN.findall(text or "")]


def brute(docs, items, top=10):
    """The scores' definition, document by document."""
    bags = [(i, words(t)) for i, t in docs]
    bags = [(i, w) for i, w in bags if w]
    n, total = len(bags), sum(len(w) for _, w in bags)
    bags, out = [(i, Counter(w), len(w)) for i, w in bags], []
    for item, text in items:
        q, scores = Counter(words(text)), []
        df = {t: sum(t in w for _, w, _ in bags) for t in q}
        for i, w, size in bags:
            m = 100 - 75 + (75 * size * n) // total
            score = 0
            for t, k in q.items():
                tf = w[t]
                if tf:
                    score += k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def found(spark, docs, items, top=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in S.ranked(d, spark.createDataFrame(items, "item_id long, text string"), top).collect())


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "SHARD", (50, 400, 1 << 21)[seed])
    monkeypatch.setattr(S, "BEAM", (1, 4, 32)[seed])
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "naïve", "x9"]
    text = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.1)), 62)] for _ in range(n))
    docs = [(rng.randrange(10_000), text(rng.choice([1, 3, 20, 80]))) for _ in range(120)]
    items = [(k, text(rng.choice([1, 2, 8, 30]))) for k in range(25)]
    assert found(spark, docs, items) == brute(docs, items)


def test_equal_scores_are_ranked_by_id(spark):
    docs = [(k, "same words here") for k in range(500, 100, -1)] + [(7, "other words")]
    assert found(spark, docs, [(1, "same here")], 5) == [(1, k, 100 + k, s) for k, (*_, s) in enumerate(brute(docs, [(1, "same here")], 5), 1)]


def test_odd_rows(spark, odd, odd_rows):
    items = [(1, prose(2, 80)), (2, None), (3, ""), (4, " .,; "), (5, "WORD é😀"), (6, prose(1, 60_000)), (7, "nowhere"), (5, "WORD é😀")]
    got = sorted(tuple(r) for r in S.ranked(odd, spark.createDataFrame(items, "item_id long, text string")).collect())
    expected = brute([r[:2] for r in odd_rows], items[:-1])
    assert got == expected
    assert {r[0] for r in got} == {1, 5, 6}


def test_null_ids_come_last(spark):
    docs = [(None, "one two"), (9, "one two"), (3, "one two")]
    assert [r[2] for r in found(spark, docs, [(1, "one")])] == [3, 9, None]


def test_empty_tables(spark, none, odd):
    item = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert S.ranked(none, item).count() == 0
    assert S.ranked(odd, item.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
    assert S.ranked(odd, item.where("false")).count() == 0


def test_blocks_of_items_give_the_same(spark, docs, sf_dir, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = sorted(map(tuple, S.ranked(docs, items).collect()))
    monkeypatch.setattr(S, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(S, "GROUP", 3)
    assert sorted(map(tuple, S.ranked(docs, items).collect())) == one


def test_ids_with_several_texts(spark):
    docs = [(1, "alpha beta"), (2, "beta gamma")]
    assert found(spark, docs, [(1, "alpha"), (1, "beta")]) == brute(docs, [(1, "alpha beta")])
