"""Metrics, thresholds and reports over score rows, each with its DuckDB statement."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.keyed import uniform_sql
from scoreloom.operators import metrics as M
from scoreloom.operators import reports as R
from scoreloom.plans.fixtures import SCORE_ROWS, THRESHOLD, score_rows
from scoreloom.registry import query

S, T, B = SCORE_ROWS, THRESHOLD, 200
_HIT = f"(CASE WHEN label = 1 THEN score >= {T} ELSE score < {T} END)::INT"
_RATES = "avg(hit) FILTER (WHERE label = 1) AS tpr, avg(hit) FILTER (WHERE label = 0) AS tnr, (avg(hit) FILTER (WHERE label = 1) + avg(hit) FILTER (WHERE label = 0)) / 2 AS balanced_accuracy"
_COUNTS = "count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_ai, count(*) FILTER (WHERE label = 0) AS n_real"
_H = f"{S}, h AS (SELECT *, {_HIT} AS hit FROM score_rows)"
#: Clusters in the order of their index, draws of ``b`` replicates, and sums by replicate and label.
_CLUSTERS = "c AS (SELECT label, cluster_id, count(*) AS n, {sums} FROM {rows} GROUP BY label, cluster_id), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(cluster_id), cluster_id) - 1 AS idx, count(*) OVER (PARTITION BY label) AS idx_n FROM c)"


def _draws(seed: str, samples: int = B) -> str:
    u = uniform_sql(f"'{seed}|' || b || '|' || label || '|' || idx")
    return f"d AS (SELECT b, label, floor({u} * idx_n)::BIGINT AS idx FROM k, (SELECT unnest(range(0, {samples})) AS b))"


@query(f"WITH {_H} SELECT {_RATES}, {_COUNTS} FROM h")
def point_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.point_metrics(score_rows(spark, sf), T)


@query(f"WITH {_H} SELECT degradation, {_RATES}, {_COUNTS} FROM h GROUP BY degradation")
def metrics_by_degradation(spark: SparkSession, sf: str) -> DataFrame:
    return M.point_metrics(score_rows(spark, sf), T, keys=["degradation"])


def _rows_sql() -> str:
    """One row a metric: the value in ``p``, the bounds of the replicates in ``r``, clusters in ``c``."""
    one = lambda m: f"SELECT '{m}' AS metric, (SELECT {m} FROM p) AS value, (SELECT quantile_cont({m}, 0.025::DOUBLE) FROM r) AS ci_lower, (SELECT quantile_cont({m}, 0.975::DOUBLE) FROM r) AS ci_upper, (SELECT count(*) FROM c WHERE label = 1) AS n_ai_clusters, (SELECT count(*) FROM c WHERE label = 0) AS n_real_clusters"
    return f'{one("tpr")} UNION ALL {one("tnr")} UNION ALL {one("balanced_accuracy")}'


_BY_REPLICATE = "r AS (SELECT b, max(share) FILTER (WHERE label = 1) AS tpr, max(share) FILTER (WHERE label = 0) AS tnr, (max(share) FILTER (WHERE label = 1) + max(share) FILTER (WHERE label = 0)) / 2 AS balanced_accuracy FROM s GROUP BY b)"


def _interval_sql(rows: str, seed: str, point: str = "h") -> str:
    return f"""
WITH {_H}, {_CLUSTERS.format(sums="sum(hit) AS hit", rows=rows)}, {_draws(seed)},
s AS (SELECT b, d.label, sum(hit) / sum(n) AS share FROM d JOIN k USING (label, idx) GROUP BY b, d.label),
{_BY_REPLICATE},
p AS (SELECT {_RATES} FROM {point})
{_rows_sql()}
"""


@query(_interval_sql("h", "20260814"))
def clustered_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return M.clustered_interval(score_rows(spark, sf), T, B)


@query(_interval_sql("(SELECT * REPLACE (CASE WHEN label = 1 THEN image_id ELSE cluster_id END AS cluster_id) FROM h)", "mixed"))
def mixed_unit_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return M.clustered_interval(score_rows(spark, sf), T, B, seed="mixed", unit_of_positives="image_id")


def _poisson_sql(samples: int, seed: str) -> str:
    """Weights are how many of the cumulative probabilities of Poisson(1) a cluster's number reaches."""
    reached = " + ".join(f"(u >= {sum(math.exp(-1) / math.factorial(j) for j in range(k))!r}::DOUBLE)::INT" for k in range(1, 13))
    u = uniform_sql(f"'{seed}|' || b || '|' || label || '|' || cluster_id")
    return f"""
WITH {_H}, c AS (SELECT label, cluster_id, count(*) AS n, sum(hit) AS hit FROM h GROUP BY ALL),
w AS (SELECT b, label, n, hit, {reached} AS w FROM (SELECT *, {u} AS u FROM c, (SELECT unnest(range(0, {samples})) AS b))),
s AS (SELECT b, label, sum(hit * w) / sum(n * w) AS share FROM w WHERE w > 0 GROUP BY ALL), {_BY_REPLICATE}, p AS (SELECT {_RATES} FROM h)
{_rows_sql()}
"""


@query(_poisson_sql(B, "20260814"))
def poisson_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return M.clustered_interval(score_rows(spark, sf), T, B, method="poisson")


@query(f"""WITH {S}, p AS (SELECT avg(label) AS p FROM score_rows)
SELECT 'always_real' AS baseline, 0.0::DOUBLE AS tpr, 1.0::DOUBLE AS tnr, 0.5::DOUBLE AS balanced_accuracy, 0.0::DOUBLE AS positive_rate
UNION ALL SELECT 'always_ai', 1, 0, 0.5, 1 UNION ALL SELECT 'prevalence', p, 1 - p, 0.5, p FROM p""")
def null_baselines(spark: SparkSession, sf: str) -> DataFrame:
    return M.null_baselines(score_rows(spark, sf))


@query(f"WITH {S} SELECT generator, count(*) FILTER (WHERE label = 1 AND score >= {T}) AS tp, count(*) FILTER (WHERE label = 1 AND score < {T}) AS fn, count(*) FILTER (WHERE label = 0 AND score < {T}) AS tn, count(*) FILTER (WHERE label = 0 AND score >= {T}) AS fp FROM score_rows GROUP BY generator")
def confusion_by_generator(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion(score_rows(spark, sf), T, keys=["generator"])


@query(f"""WITH {S}, s AS (SELECT degradation, score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM score_rows GROUP BY ALL),
t AS (SELECT *, sum(q) OVER (PARTITION BY degradation ORDER BY score) - q / 2 AS below FROM s)
SELECT degradation, sum(p * below) / (sum(p) * sum(q)) AS auc, sum(p)::BIGINT AS n_ai, sum(q)::BIGINT AS n_real FROM t GROUP BY degradation""")
def roc_auc_midrank(spark: SparkSession, sf: str) -> DataFrame:
    return M.roc_auc(score_rows(spark, sf), keys=["degradation"])


@query(f"""WITH {S}, h AS (SELECT *, {_HIT} AS hit_a, (CASE WHEN label = 1 THEN score_b >= {T} ELSE score_b < {T} END)::INT AS hit_b FROM score_rows),
{_CLUSTERS.format(sums="sum(hit_a) AS hit_a, sum(hit_b) AS hit_b", rows="h")}, {_draws("20260814")},
s AS (SELECT b, d.label, (sum(hit_a) - sum(hit_b)) / sum(n) AS share FROM d JOIN k USING (label, idx) GROUP BY b, d.label), r AS (SELECT b, avg(share) AS d FROM s GROUP BY b)
SELECT (avg(hit_a - hit_b) FILTER (WHERE label = 1) + avg(hit_a - hit_b) FILTER (WHERE label = 0)) / 2 AS delta, count(*) FILTER (WHERE hit_a = 1 AND hit_b = 1) AS both, count(*) FILTER (WHERE hit_a = 1 AND hit_b = 0) AS only_a,
count(*) FILTER (WHERE hit_a = 0 AND hit_b = 1) AS only_b, count(*) FILTER (WHERE hit_a = 0 AND hit_b = 0) AS neither, (SELECT quantile_cont(d, 0.025::DOUBLE) FROM r) AS ci_lower, (SELECT quantile_cont(d, 0.975::DOUBLE) FROM r) AS ci_upper FROM h""")
def paired_delta_ci(spark: SparkSession, sf: str) -> DataFrame:
    return M.paired_delta(score_rows(spark, sf), T, "score", "score_b", B)


def _sweep_sql(rows: str, key: str, value: str = "score") -> str:
    """Balanced accuracy at each distinct value by key, as ``w(key, s, ba)``."""
    return f"""s AS (SELECT {key} AS key, {value} AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM {rows} GROUP BY ALL),
t AS (SELECT *, sum(p) OVER w - p AS p_lt, sum(q) OVER w - q AS q_lt, sum(p) OVER (PARTITION BY key) AS pa, sum(q) OVER (PARTITION BY key) AS qa FROM s WINDOW w AS (PARTITION BY key ORDER BY s)),
w AS (SELECT key, s, ((pa - p_lt) / pa + q_lt / qa) / 2 AS ba FROM t WHERE pa > 0 AND qa > 0)"""


@query(f"WITH {S}, {_sweep_sql('score_rows', 'degradation')} SELECT key AS degradation, min_by(s, (-ba, s)) AS threshold, max(ba) AS balanced_accuracy FROM w GROUP BY key")
def best_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return M.best_threshold(score_rows(spark, sf), keys=["degradation"])


_TWO = f"{S}, z AS (SELECT generator, label, score, 1 AS polarity FROM score_rows UNION ALL SELECT generator, label, -score, -1 FROM score_rows)"


@query(f"WITH {_TWO}, {_sweep_sql('z', '(generator, polarity)')}, b AS (SELECT key, min_by(s, (-ba, s)) AS threshold, max(ba) AS ba FROM w GROUP BY key) SELECT key[1] AS generator, max_by(key[2], (ba, key[2])) AS polarity, max_by(threshold, (ba, key[2])) AS threshold, max(ba) AS balanced_accuracy FROM b GROUP BY key[1]")
def two_sided_stump(spark: SparkSession, sf: str) -> DataFrame:
    return M.two_sided_stump(score_rows(spark, sf), keys=["generator"])


_ORACLE = "{t} AS (SELECT {key}, (1 + max(abs(p / pa - q / qa))) / 2 AS oracle_ba FROM (SELECT {key}, sum(p) OVER w AS p, sum(q) OVER w AS q, sum(p) OVER (PARTITION BY {key}) AS pa, sum(q) OVER (PARTITION BY {key}) AS qa FROM (SELECT {key}, score, sum(label) AS p, sum(1 - label) AS q FROM {rows} GROUP BY ALL) WINDOW w AS (PARTITION BY {key} ORDER BY score)) GROUP BY {key})"


@query(f"WITH {S}, {_ORACLE.format(t='o', key='degradation', rows='score_rows')} SELECT * FROM o")
def oracle_ba_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return M.oracle_balanced_accuracy(score_rows(spark, sf), keys=["degradation"])


_PERM_U = uniform_sql("'20260813|' || b || '|' || cluster_id")


@query(f"""WITH {S}, e AS (SELECT * FROM score_rows WHERE split = 'eval'), c AS (SELECT DISTINCT cluster_id, label FROM e),
u AS (SELECT b, cluster_id, label, {_PERM_U} AS u FROM c, (SELECT unnest(range(0, 999)) AS b)),
g AS (SELECT b, cluster_id, (count(*) OVER (PARTITION BY b ORDER BY u) <= sum(label) OVER (PARTITION BY b))::INT AS label FROM u),
x AS (SELECT b, score, g.label FROM e JOIN g USING (cluster_id)), y AS (SELECT 0 AS b, score, label FROM e),
{_ORACLE.format(t="n", key="b", rows="x")}, {_ORACLE.format(t="o", key="b", rows="y")},
r AS (SELECT any_value(o.oracle_ba) AS observed, median(n.oracle_ba) AS null_median, (1 + count(*) FILTER (WHERE n.oracle_ba >= o.oracle_ba - 1e-12)) / (1 + count(*)) AS p FROM n, o)
SELECT observed, null_median, observed - null_median AS excess, p AS p_value, least(1.0, p * 5) AS corrected_p, CASE WHEN least(1.0, p * 5) < 0.01 AND observed - null_median >= 0.1 THEN 'fail' WHEN least(1.0, p * 5) < 0.05 THEN 'warn' ELSE 'pass' END AS verdict FROM r""")
def permutation_gate(spark: SparkSession, sf: str) -> DataFrame:
    return M.permutation_gate(score_rows(spark, sf).where("split = 'eval'"), samples=999, tests=5)


@query(f"""WITH {_H}, p AS (SELECT label, generator, count(*) AS n, avg(hit) AS own_rate FROM h GROUP BY ALL), o AS (SELECT 1 - label AS label, avg(hit) AS other_rate FROM h GROUP BY label)
SELECT label, generator, n, own_rate, other_rate, (own_rate + other_rate) / 2 AS balanced_accuracy FROM p JOIN o USING (label)""")
def family_slices(spark: SparkSession, sf: str) -> DataFrame:
    return R.family_slices(score_rows(spark, sf), T)


@query(f"WITH {S} SELECT generator, avg((score >= {T})::INT) FILTER (WHERE degradation = 'F') AS rate_f, avg((score >= {T})::INT) FILTER (WHERE degradation = 'O') AS rate_o, avg((score >= {T})::INT) FILTER (WHERE degradation = 'P') AS rate_p, avg((score >= {T})::INT) AS rate_all FROM score_rows GROUP BY generator")
def pivot_rates(spark: SparkSession, sf: str) -> DataFrame:
    return R.pivot_rates(score_rows(spark, sf), (F.col("score") >= T).cast("int"), "generator", "degradation", ["F", "O", "P"])


@query(f"WITH {S}, c AS (SELECT generator, cluster_id, max((score >= {T})::INT) AS x FROM score_rows WHERE label = 0 GROUP BY ALL) SELECT generator, avg(x) AS cluster_rate, count(*) AS n_clusters FROM c GROUP BY generator")
def cluster_any_rate(spark: SparkSession, sf: str) -> DataFrame:
    return R.cluster_any_rate(score_rows(spark, sf).where("label = 0"), F.col("score") >= T, ["generator"])


@query(f"WITH {S} SELECT coalesce(generator, '*') AS generator, coalesce(degradation, '*') AS degradation, avg((score >= {T})::INT) AS rate, count(*) AS n FROM score_rows GROUP BY GROUPING SETS ((generator), (degradation), (generator, degradation), ())")
def rates_by_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["generator", "degradation"]
    return R.rates_by(score_rows(spark, sf), F.col("score") >= T, [keys[:1], keys[1:], keys, []], keys)


@query(f"""WITH {S}, h AS (SELECT *, abs(score - score_b) AS d, {_HIT} AS ha, (CASE WHEN label = 1 THEN score_b >= {T} ELSE score_b < {T} END)::INT AS hb FROM score_rows)
SELECT avg(d) AS mean_drift, quantile_cont(d, 0.99::DOUBLE) AS p99_drift, max(d) AS max_drift, avg(((score >= {T}) <> (score_b >= {T}))::INT) AS disagreement,
(avg(ha) FILTER (WHERE label = 1) + avg(ha) FILTER (WHERE label = 0)) / 2 - (avg(hb) FILTER (WHERE label = 1) + avg(hb) FILTER (WHERE label = 0)) / 2 AS ba_drop FROM h""")
def drift_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.drift(score_rows(spark, sf), "score", "score_b", T)


@query(f"""WITH {S}, z AS (SELECT label, 'score' AS strategy, score AS v FROM score_rows UNION ALL SELECT label, 'score_b', score_b FROM score_rows UNION ALL SELECT label, 'noise', noise FROM score_rows),
{_sweep_sql("z", "strategy", "v")}, a AS (SELECT key, sum(p * (q_lt + q / 2)) / (sum(p) * sum(q)) AS auc FROM t GROUP BY key)
SELECT w.key AS strategy, min_by(s, (-ba, s)) AS threshold, max(ba) AS balanced_accuracy, any_value(auc) AS auc FROM w JOIN a USING (key) GROUP BY w.key""")
def strategy_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return R.strategy_ranking(score_rows(spark, sf), ["score", "score_b", "noise"])


@query(f"""WITH {_H}, m AS (SELECT degradation, {_RATES}, {_COUNTS} FROM h GROUP BY degradation)
SELECT *, (SELECT count(*) FROM m WHERE balanced_accuracy >= 0.8) AS n_passed, (SELECT degradation FROM m ORDER BY balanced_accuracy, degradation LIMIT 1) AS worst, (SELECT min(balanced_accuracy) FROM m) AS worst_ba, (SELECT avg(balanced_accuracy) FROM m) AS mean_ba FROM m""")
def condition_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.condition_summary(score_rows(spark, sf), T)


@query(f"WITH {S}, p AS (SELECT quantile_cont(abs(score - score_b), 0.95::DOUBLE) AS p95 FROM score_rows) SELECT p95, count(*) FILTER (WHERE abs(score - {T}) <= p95) AS at_risk, count(*) AS n FROM score_rows, p GROUP BY p95")
def boundary_at_risk(spark: SparkSession, sf: str) -> DataFrame:
    return R.boundary_at_risk(score_rows(spark, sf), "score", "score_b", T)


@query(f"""WITH {S}, h AS (SELECT *, noise < 0.2 AS g, {_HIT} AS x, CASE WHEN noise < 0.2 THEN least(score, 0.35) ELSE score END AS s2 FROM score_rows), i AS (SELECT *, (CASE WHEN label = 1 THEN s2 >= {T} ELSE s2 < {T} END)::INT AS y FROM h)
SELECT (avg(x) FILTER (WHERE label = 1) + avg(x) FILTER (WHERE label = 0)) / 2 AS ba_before, (avg(y) FILTER (WHERE label = 1) + avg(y) FILTER (WHERE label = 0)) / 2 AS ba_after,
count(*) FILTER (WHERE label = 0 AND x = 0 AND y = 1) AS rescued, count(*) FILTER (WHERE label = 1 AND x = 1 AND y = 0) AS lost, count(*) FILTER (WHERE g) AS n_gated FROM i""")
def gate_effect(spark: SparkSession, sf: str) -> DataFrame:
    return R.gate_effect(score_rows(spark, sf), F.col("noise") < 0.2, T)


_GRID = [(i * 6 + j, 0.05 + 0.05 * i, 0.3 + 0.1 * j) for i in range(5) for j in range(6)]


@query(f"""WITH {S}, g(grid_id, most_noise, least_score) AS (VALUES {", ".join(f"({a}, {b!r}::DOUBLE, {c!r}::DOUBLE)" for a, b, c in _GRID)}),
x AS (SELECT g.*, count(*) FILTER (WHERE noise <= most_noise AND score >= least_score AND label = 0) AS caught, count(*) FILTER (WHERE noise <= most_noise AND score >= least_score AND label = 1) AS lost, count(*) FILTER (WHERE label = 1) AS n_ai FROM score_rows, g GROUP BY ALL)
SELECT grid_id, most_noise, least_score, caught, lost FROM x WHERE lost <= 0.1 * n_ai ORDER BY caught DESC, lost, grid_id LIMIT 1""")
def gate_grid_search(spark: SparkSession, sf: str) -> DataFrame:
    grid = spark.createDataFrame(_GRID, "grid_id int, most_noise double, least_score double")
    return R.grid_search(score_rows(spark, sf), grid, {"most_noise": ("noise", "<="), "least_score": ("score", ">=")}, 0.1)


@query(f"""WITH {S}, t AS (SELECT image_id, [score, score_b, noise, abs(score - noise)] AS t FROM score_rows), u AS (SELECT image_id, t, list_sort(t) AS a, list_reverse_sort(t) AS d FROM t)
SELECT image_id, list_avg(t) AS tile_mean, list_max(t) AS tile_max, (a[2] + a[3]) / 2 AS tile_median, a[3] AS tile_upper_middle, (d[1] + d[2]) / 2 AS tile_top2, (d[1] + d[2] + d[3]) / 3 AS tile_top3, 1 - (1 - t[1]) * (1 - t[2]) * (1 - t[3]) * (1 - t[4]) AS tile_noisy_or FROM u""")
def tile_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    rows = score_rows(spark, sf)
    return R.tile_aggregates(rows.select("image_id", F.array("score", "score_b", "noise", F.abs(F.col("score") - F.col("noise"))).alias("tiles")))


@query(f"""WITH {S}, r AS (SELECT *, abs(score - score_b) AS d, row_number() OVER (PARTITION BY label, degradation ORDER BY md5(image_id), image_id) AS r FROM score_rows)
SELECT quantile_cont(d, 0.5::DOUBLE) AS median_diff, quantile_cont(d, 0.95::DOUBLE) AS p95_diff, max(d) AS max_diff, count(*) FILTER (WHERE (score >= {T}) <> (score_b >= {T})) AS flips, count(*) AS n FROM r WHERE r <= 50""")
def stratified_parity(spark: SparkSession, sf: str) -> DataFrame:
    return R.stratified_parity(score_rows(spark, sf), "score", "score_b", T, 50, ["label", "degradation"])


@query(f"""WITH {S}, g AS (SELECT DISTINCT generator FROM score_rows), c AS (SELECT generator, label, count(*) AS n FROM score_rows WHERE split = 'eval' GROUP BY ALL), e AS (SELECT DISTINCT generator FROM score_rows WHERE split = 'eval')
SELECT e.generator, l.label, coalesce(n, 0) AS n, coalesce(n, 0) >= 100 AS passed FROM e CROSS JOIN (VALUES (0), (1)) l(label) LEFT JOIN c ON c.generator = e.generator AND c.label = l.label""")
def minimum_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.minimum_counts(score_rows(spark, sf).where("split = 'eval'"), "generator", 100)
