import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from samples import prose

from scoreloom.llm import bytescan as B
from scoreloom.llm import embedding as E


def hashes(text):
    (_, data, offsets), = B.chunks(pa.array([text]))
    return E.tokens(data, offsets)[0].tolist()


def brute_sums(texts):
    """Contexts word by word."""
    out = defaultdict(lambda: np.zeros(E.DIMS + 1, np.int64))
    for text in texts:
        h = hashes(text or "") if text else []
        index = E.index_vectors(np.array(h, np.uint64)).astype(np.int64) if h else []
        for i, word in enumerate(h):
            own = out[word >> (64 - E.SLOT_BITS)]
            own[E.DIMS] += 1
            for lag in range(1, E.REACH + 1):
                if i >= lag:
                    own[: E.DIMS] += index[i - lag]
                if i + lag < len(h):
                    own[: E.DIMS] += np.roll(index[i + lag], 1)
    return out


def brute_vectors(texts):
    sums = brute_sums(texts)
    total = sum(sums.values(), np.zeros(E.DIMS + 1))
    out = np.zeros((1 << E.SLOT_BITS, E.DIMS))
    for slot, v in sums.items():
        own = v[: E.DIMS] - v[E.DIMS] * total[: E.DIMS] / total[E.DIMS]
        out[slot] = own / max(np.linalg.norm(own), 1e-9)
    return out


def brute_pooled(text, vectors):
    h = hashes(text) if text else []
    if not h:
        return np.zeros(E.FEATURES)
    own = np.stack([vectors[x >> (64 - E.SLOT_BITS)] for x in h]).astype(float)
    like = [sum(own[i] @ own[i - lag] for i in range(lag, len(h))) / len(h) for lag in range(1, E.REACH + 1)]
    return np.concatenate([own.mean(0), own.std(0), like, [np.log1p(len(h))]])


TEXTS = [prose(k, 5 + 30 * k) for k in range(12)] + ["", None, "one", " \n ", "é😀 | x || y!!", "a,b", prose(3, 95)]


def test_words_are_runs_of_letters_or_marks():
    assert hashes("The&&& the, 12é") == [hashes(x)[0] for x in ("The", "&&&", "the", ",", "12é")]
    (_, data, offsets), = B.chunks(pa.array(["ab", "", "cd e"]))
    assert E.tokens(data, offsets)[1].tolist() == [0, 2, 2]


def test_vectors_equal_brute_force(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    assert np.allclose(E.word_vectors(docs), brute_vectors(TEXTS), atol=1e-5)


def test_pooling_equals_brute_force():
    vectors = brute_vectors(TEXTS)
    assert np.allclose(E.pooled(pa.array(TEXTS), vectors.astype(np.float32)), [brute_pooled(t, vectors) for t in TEXTS], atol=1e-4)


def test_long_texts_go_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    whole = E.word_vectors(docs)
    rows = E.pooled(pa.array(TEXTS), whole)
    monkeypatch.setattr(E, "BLOCK", 7)
    monkeypatch.setattr(E, "CHUNK", 100)
    assert (E.word_vectors(docs) == whole).all() and np.allclose(E.pooled(pa.array(TEXTS), whole), rows)


def test_temperature_is_the_likeliest():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(E.fit_temperature(3 * z, y) - 3) < 0.2 and E.fit_temperature(z[:0], y[:0]) == 1


def test_network_learns_what_is_not_linear():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert np.mean((E.fit_network(x[:3000], y[:3000]).probability(x[3000:]) > 0.5) == y[3000:]) > 0.9
    assert E.fit_network(x[:0], y[:0]).probability(x[:2]).tolist() == [0.5, 0.5]
    assert E.fit_network(x[:8], np.ones(8)).probability(x[:1])[0] == 0.9


@pytest.fixture(scope="module")
def scored(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return E.quality_scores(docs, labels).join(labels.select("doc_id", "quality"), "doc_id", "left").toPandas()


def test_held_out_accuracy(scored):
    assert len(scored) == 1000 and scored.score.between(0, 1).all()
    assert (scored.held_out == scored.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((scored.score >= 0.3).astype(int) == scored.predicted).all()
    held = scored[scored.held_out & scored.quality.notna()]
    assert (held.predicted == held.quality).mean() > 0.93
    poor, good = (held.score[held.quality == k].to_numpy() for k in (0, 1))
    assert (good[:, None] > poor).mean() > 0.93


def test_labels_of_held_out_rows_have_no_say(spark, odd, labels):
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = lambda x: {r.doc_id: round(r.score, 9) for r in E.quality_scores(docs, x).collect()}
    assert rows(labels) == rows(flipped)


def test_odd_rows(spark, odd, odd_rows, none, labels):
    some = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 0), (7, None), (None, 1), (9, 1), (5, 0), (3, 1)], "doc_id long, quality int")
    got = E.quality_scores(odd, some)
    rows = got.collect()
    assert len(rows) == len(odd_rows) and set(got.columns) == {*odd.columns, "predicted"}
    by = defaultdict(set)
    for r in rows:
        by[r.text].add(r.score)
        assert 0 <= r.score <= 1 and isinstance(r.held_out, bool)
    assert all(len(v) == 1 for v in by.values()) and by[None] == by[""] == by[" \n\t "]
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert E.quality_scores(none, labels).count() == 0
    assert {r.score for r in E.quality_scores(odd, labels.where("false")).collect()} == {0.5}
