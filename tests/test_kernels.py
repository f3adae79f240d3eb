"""Exact quantiles, resampling and shuffled labels against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions.keyed import uniform as keyed_uniform
from scoreloom.operators import metrics as M
from scoreloom.operators import quantiles as Q
from scoreloom.operators import resampling as R


def frame(spark, values, parts=4):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(parts)


SETS = {
    "normal": lambda r: r.normal(size=3000),
    "heavy": lambda r: np.exp(r.normal(scale=40, size=3000)),
    "ties": lambda r: r.choice([0.0, 0.5, 1.0], size=3000, p=[0.6, 0.3, 0.1]),
    "one": lambda r: [7.5],
    "same": lambda r: [2.0] * 500,
    "signs": lambda r: np.concatenate([-np.exp(r.normal(scale=9, size=1500)), [0.0, -0.0] * 20, np.exp(r.normal(scale=9, size=700))]),
    "infinite": lambda r: np.concatenate([r.normal(size=300), [np.inf] * 40, [-np.inf] * 40]),
}


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("gathered", [2, 2_000])
def test_quantiles_equal_numpy(spark, monkeypatch, name, gathered):
    monkeypatch.setattr(Q, "GATHERED", gathered)
    monkeypatch.setattr(Q, "ACCURACY", 20 if gathered == 2 else 1_000)
    values = list(SETS[name](np.random.default_rng(5)))
    p = [0.0, 0.05, 0.5, 0.99, 1.0]
    found = Q.exact_quantiles(frame(spark, [*values, None, float("nan")]), ["v"], p)["v"]
    expected = np.quantile(np.array(values, float), [0.0, 0.05, 0.5, 0.99, 1.0]) if name != "infinite" else [-np.inf, -np.inf, np.median(values), np.inf, np.inf]
    assert np.allclose(found, expected, rtol=1e-12, equal_nan=False)


def test_quantiles_of_nothing(spark):
    assert Q.exact_quantiles(frame(spark, []), ["v"], [0.5, 1.0]) == {"v": [None, None]}
    assert Q.exact_quantiles(frame(spark, [None, float("nan")]), ["v"], [0.5]) == {"v": [None]}
    two = Q.exact_quantiles(frame(spark, [1, 2, 3]), {"a": F.col("v"), "b": -F.col("v")}, [0.25])
    assert two == {"a": [1.5], "b": [-2.5]}


def uniform(key):
    return int(hashlib.sha256(key.encode()).hexdigest()[:13], 16) / 2**52


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    made = [(f"c{int(r.integers(40))}:{k % 2}", k % 2, float(r.random() * 0.7 + 0.3 * (k % 2))) for k in range(400)]
    return spark.createDataFrame(made, "cluster_id string, label int, score double").repartition(3)


def brute_replicates(found, samples, seed):
    """Mean score by label and replicate."""
    out = {}
    for label in (0, 1):
        ids = sorted({r.cluster_id for r in found if r.label == label}, key=lambda c: (hashlib.md5(c.encode()).hexdigest(), c))
        own = [[r.score for r in found if r.cluster_id == c and r.label == label] for c in ids]
        for b in range(samples):
            drawn = [own[int(uniform(f"{seed}|{b}|{label}|{k}") * len(ids))] for k in range(len(ids))]
            out[b, label] = sum(map(sum, drawn)) / sum(map(len, drawn))
    return out


@pytest.mark.parametrize("sent", [0, 1_000])
def test_any_statistic_of_draws_equals_brute_force(spark, rows, monkeypatch, sent):
    monkeypatch.setattr(R, "SENT", sent)
    by = R.replicates(rows, {"total": F.col("score")}, lambda of: {"mean_0": of("total", 0) / of("n", 0), "ratio": of("total", 1) / of("total", 0) * of("n", 0) / of("n", 1)}, 12, "s")
    expected = brute_replicates(rows.collect(), 12, "s")
    got = {r.b: r for r in by.collect()}
    assert len(got) == 12
    for b, r in got.items():
        assert abs(r.mean_0 - expected[b, 0]) < 1e-9 and abs(r.ratio - expected[b, 1] / expected[b, 0]) < 1e-9


@pytest.mark.parametrize("block", [4, 65_536])
def test_draws_of_many_clusters_are_added_up_by_blocks(spark, rows, monkeypatch, block):
    monkeypatch.setattr(R, "SENT", 0)
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(F, "posexplode", lambda *_: pytest.fail("a row for each draw"))
    got = {r.b: r.mean for r in R.replicates(rows, {"total": F.col("score")}, lambda of: {"mean": of("total", 1) / of("n", 1)}, 9, "s").collect()}
    expected = brute_replicates(rows.collect(), 9, "s")
    assert len(got) == 9 and all(abs(got[b] - expected[b, 1]) < 1e-9 for b in got)


def test_keyed_numbers_equal_those_of_columns(spark):
    tails = ["|1|é", "|", "", "|0|" + "x" * 100]
    by_column = [[r.u for r in spark.createDataFrame([(h + t,) for h in ("s|0", "s|1")], "k string").select(keyed_uniform(F.col("k")).alias("u")).collect()] for t in tails]
    assert R.keyed_numbers(["s|0", "s|1"], tails).tolist() == by_column


def test_poisson_weights(spark, rows):
    by = R.replicates(rows, {"total": F.col("score")}, lambda of: {"n": of("n", 0), "mean": of("total", 0) / of("n", 0)}, 300, "p", "poisson").toPandas()
    exact = rows.where("label = 0").agg(F.avg("score"), F.count("*")).first()
    assert abs(by["mean"].mean() - exact[0]) < 0.01 and abs(by["n"].mean() - exact[1]) < 8


def test_statistics_of_no_rows(spark, rows):
    assert R.replicates(rows.where("false"), {}, lambda of: {"n": of("n", 0)}, 5, "s").count() == 0
    assert R.replicates(rows.where("label = 1"), {}, lambda of: {"n": of("n", 0)}, 5, "s").where("n is not null").count() == 0


@pytest.mark.parametrize("fan", [2, 64])
def test_prefix_sums(spark, monkeypatch, fan):
    monkeypatch.setattr(R, "FAN", fan)
    parts = spark.createDataFrame([(k, key, k * k + key) for k in range(23) if k != 5 for key in (0, 1)], "part long, b int, p long")
    got = {(r.b, r.part): r.p_before for r in R.prefix_sums(parts, "part", ["p"], ["b"]).collect()}
    assert got == {(key, k): sum(j * j + key for j in range(k) if j != 5) for k in range(23) if k != 5 for key in (0, 1)}
    assert R.prefix_sums(parts.where("false"), "part", ["p"], ["b"]).count() == 0


def brute_null(found, samples, seed):
    clusters = {r.cluster_id: r.label for r in found}
    k, out = sum(clusters.values()), {}
    for b in range(samples):
        chosen = set(sorted(clusters, key=lambda c: uniform(f"{seed}|{b}|{c}"))[:k])
        label = np.array([r.cluster_id in chosen for r in found])
        score = np.array([r.score for r in found])
        cuts = np.unique(score)
        gap = max(abs((score[label] <= t).mean() - (score[~label] <= t).mean()) for t in cuts)
        out[b] = (1 + gap) / 2
    return out


@pytest.mark.parametrize("part_rows", [7, 20_000])
@pytest.mark.parametrize("score", ["score", "round(score, 1)", "0.5"])
def test_null_accuracies_equal_brute_force(spark, rows, monkeypatch, part_rows, score):
    monkeypatch.setattr(R, "PART_ROWS", part_rows)
    monkeypatch.setattr(R, "FAN", 3)
    own = rows.selectExpr("cluster_id", "label", f"cast({score} as double) as score")
    got = {r.b: r.oracle_ba for r in R.null_accuracies(own.select("cluster_id", "score"), own.select("cluster_id", "label").distinct(), 20, "q").collect()}
    expected = brute_null(own.collect(), 20, "q")
    assert got.keys() == expected.keys() and all(abs(got[b] - expected[b]) < 1e-12 for b in got)


def test_one_score_for_all_rows_is_dealt_to_many_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "PART_ROWS", 50)
    own = spark.range(2000).selectExpr("cast(id as string) as cluster_id", "cast(id % 2 as int) as label", "0.5d as score")
    sizes = []
    real = R.stage
    monkeypatch.setattr(R, "stage", lambda df, name: sizes.append((name, out := real(df, name))) or out)
    assert {r.oracle_ba for r in R.null_accuracies(own.select("cluster_id", "score"), own.select("cluster_id", "label"), 9, "q").collect()} == {0.5}
    placed = dict(sizes)["ranges"].groupBy("part").count().toPandas()
    assert placed["count"].max() <= 150 and len(placed) > 20


def test_interval_guards(spark, rows):
    with pytest.raises(ValueError, match="200"):
        M.clustered_interval(rows, 0.5, 10)
