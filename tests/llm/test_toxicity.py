import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from samples import prose

from scoreloom.llm import toxicity as T


def planted(n=600):
    rng, docs, labels = random.Random(4), [], []
    for i in range(n):
        words, bad = prose(i, 60).split(), i % 5 == 0
        for _ in range(4 if bad else 0):
            words[rng.randrange(60)] = rng.choice(["wretch", "grublow" + rng.choice(["er", "est", "ing", "ed", "s", "ish", "o", "a"])])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = planted()
    out = T.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_used(spark):
    docs, labels = planted(300)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    one, two = ({r.doc_id: r.score for r in T.toxicity(frame, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped))
    assert one == two


def test_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (6, 0), (9, 1), (None, 1), (3, None), (2, 0)], "doc_id long, toxic int")
    out = T.toxicity(odd, labels)
    assert out.count() == len(odd_rows)
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert T.toxicity(none, labels).count() == 0
    flat = T.toxicity(odd, labels.where("toxic = 0")).collect()
    assert {r.score for r in flat} == {0.0}, "one class only"
    assert T.drop_toxic(odd, odd, labels.where("doc_id = 77")).schema == odd.schema


def test_table_keeps_every_ratio(spark):
    n = 1_200_000
    ratios = spark.range(n).select(F.col("id").alias("g"), (F.col("id") % 7 + 1).cast("int").alias("ratio"))
    table = T.scoring_table(ratios)
    ratio = table.of(np.arange(2 * n, dtype=np.uint64))
    assert (ratio[:n] == np.arange(n) % 7 + 1).all() and not ratio[n:].any()
    assert not T.scoring_table(ratios.where("g < 0")).of(np.arange(5, dtype=np.uint64)).any()


class Brute:
    """The two models from their definition, over tuples of symbols."""

    def __init__(self, rows):
        self.top = defaultdict(lambda: [0, 0])
        for text, toxic in rows:
            for w in set(re.findall("[a-z]+", text.lower())):
                for g in self.grams(w):
                    self.top[g][toxic] += 1
        every = {g[k:] for g in self.top for k in range(len(g))}
        self.next, self.left = defaultdict(list), defaultdict(Counter)
        for g in self.top:
            self.next[g[:-1]].append(g)
        for g in every:
            if len(g) > 1:
                self.left[g[1:-1]][g[1:]] += 1

    @staticmethod
    def grams(word):
        s = [T.FIRST, *word.encode(), T.LAST]
        return [tuple(s[max(0, i - T.ORDER + 1) : i + 1]) for i in range(1, len(s))]

    def shared(self, g):
        if not g:
            return 1 / T.SYMBOLS
        own = self.left[g[:-1]]
        total = sum(own.values())
        return max(own[g] - T.DISCOUNT, 0) / total + T.DISCOUNT * len(own) / total * self.shared(g[1:])

    def ratio(self, g):
        if g not in self.top:
            return 0.0
        own = {x: self.top[x] for x in self.next[g[:-1]]}
        total = sum(map(sum, own.values()))
        mass = T.DISCOUNT * len(own) / total
        held = {x: [n * (sum(c) - T.DISCOUNT) / sum(c) for n in c] for x, c in own.items()}
        p = []
        for k in (1, 0):
            everyone = sum(map(sum, held.values()))
            p.append((1 - mass) * (held[g][k] + T.SHARED * sum(held[g]) / everyone) / (sum(c[k] for c in held.values()) + T.SHARED) + mass * self.shared(g[1:]))
        return math.log(p[0] / p[1])

    def features(self, text):
        words = set(re.findall("[a-z]+", text.lower()))
        each = sorted((sum(round(self.ratio(g) * T.UNIT) / T.UNIT for g in self.grams(w)) for w in words), reverse=True)
        return [sum(each) / max(sum(len(w) + 1 for w in words), 1), *(sum(each[:k]) / k for k in T.MOST)]


def key(g):
    return sum(b << (8 * i) for i, b in enumerate(g)) | len(g) << 56


def test_probabilities_equal_brute_force(spark):
    docs, labels = planted(60)
    truth = dict(labels)
    rows = [(t, truth[i], 0) for i, t in docs]
    model = T.log_ratios(T.count_grams(spark.createDataFrame(rows, "text string, toxic int, fold int")))
    found = {r.g: r.ratio for r in model.collect()}
    brute = Brute([(t, y) for t, y, _ in rows])
    assert found.keys() == {key(g) for g in brute.top}
    assert all(abs(found[key(g)] - brute.ratio(g) * T.UNIT) <= 0.51 for g in brute.top)
    assert max(found.values()) > T.UNIT and min(found.values()) < 0


def test_models_are_probabilities():
    docs, labels = planted(30)
    brute = Brute([(t, y) for (_, t), (_, y) in zip(docs, labels, strict=True)])
    context = tuple([T.FIRST, *b"al"])
    assert abs(sum(brute.shared((*context[1:], b)) for b in range(1, 257)) - 1) < 1e-9


def test_scores_follow_the_features_for_any_slices(spark, monkeypatch):
    docs, labels = planted(200)
    texts = [*docs, (900, ""), (901, None), (902, "new words only"), (903, docs[0][1] + " " + docs[0][1].upper())]
    frame, truth = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(frame, truth)
    one = {r.doc_id: r.s for r in T.with_scores(frame, model, "s").collect()}
    rest = {i: zlib.crc32(str(i).encode()) % 3 for i, _ in docs}
    brute = Brute([(t, dict(labels)[i]) for i, t in docs if rest[i] != 1])
    for i, t in texts:
        x = (np.array(brute.features(t or "")) - model.mean) / model.scale
        assert abs(one[i] - 1 / (1 + math.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -40, 40)))) < 1e-6
    assert one[903] == one[0] and one[900] == one[901]
    monkeypatch.setattr(T, "SLICE", 700)
    assert {r.doc_id: r.s for r in T.with_scores(frame, model, "s").collect()} == one
