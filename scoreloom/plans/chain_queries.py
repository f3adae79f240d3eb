"""The decision chain over score rows: curves, fusion, overrides, caps, vetoes, display, tiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import scalars as C
from scoreloom.plans.decision import decide, fuse
from scoreloom.plans.fixtures import SCORE_ROWS, score_rows, table
from scoreloom.registry import query

S = SCORE_ROWS
CURVE = ([0.0, 0.2, 0.45, 0.5, 0.7, 0.9, 1.0], [0.02, 0.1, 0.4, 0.65, 0.8, 0.95, 0.99])
SECOND = ([0.1, 0.3, 0.6, 0.8], [0.05, 0.3, 0.7, 0.9])


def curve_sql(x: str, xs: list[float], ys: list[float]) -> str:
    parts = [f"WHEN {x} <= {xs[0]!r} THEN {ys[0]!r}::DOUBLE"]
    for a, b, c, d in zip(xs, xs[1:], ys, ys[1:], strict=False):
        parts.append(f"WHEN {x} < {b!r} THEN {c!r}::DOUBLE + ({x} - {a!r}::DOUBLE) / ({b!r}::DOUBLE - {a!r}::DOUBLE) * ({d!r}::DOUBLE - {c!r}::DOUBLE)")
    return f"(CASE {' '.join(parts)} ELSE {ys[-1]!r}::DOUBLE END)"


_CL = "least(greatest({0}, 0.000001::DOUBLE), 0.999999::DOUBLE)"


def _logit_sql(p: str) -> str:
    c = _CL.format(p)
    return f"ln({c} / (1 - {c}))"


_SIG = "(CASE WHEN {0} >= 0 THEN 1 / (1 + exp(-{0})) ELSE exp({0}) / (1 + exp({0})) END)"
_FUSE_CTE = f"""t AS (SELECT *, 0.7::DOUBLE * {_logit_sql(curve_sql("score", *CURVE))} AS t1, CASE WHEN noise < 0.5 THEN 0.4::DOUBLE * {_logit_sql(curve_sql("score_b", *SECOND))} END AS t2 FROM score_rows),
l AS (SELECT *, least(8, greatest(-8, coalesce(t1, 0) + coalesce(t2, 0))) AS l FROM t), f AS (SELECT *, {_CL.format(curve_sql(_SIG.format("l"), *CURVE))} AS p FROM l)"""


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    rows = score_rows(spark, sf)
    second = F.when(F.col("noise") < 0.5, F.col("score_b"))
    return fuse(rows, {"detector": (F.col("score"), 0.7, CURVE), "second": (second, 0.4, SECOND)}, CURVE)


@query(f"WITH {S} SELECT image_id, {curve_sql('score', *CURVE)} AS calibrated, {_logit_sql('score')} AS logit, {_SIG.format('(score * 10 - 5)')} AS sigmoid FROM score_rows")
def curve_apply(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("score")
    return score_rows(spark, sf).select("image_id", C.apply_curve(s, *CURVE).alias("calibrated"), C.logit(s).alias("logit"), C.sigmoid(s * 10 - 5).alias("sigmoid"))


_KNOT_X, _KNOT_Y = "CASE WHEN o_custkey % 3 = 0 THEN o_orderkey // 50 ELSE o_orderkey END", "CASE WHEN o_custkey % 3 = 1 THEN o_totalprice ELSE o_orderkey // 100 END"


@query(f"""WITH k AS (SELECT o_custkey, o_orderkey, {_KNOT_X} AS x, {_KNOT_Y} AS y FROM orders), s AS (SELECT o_custkey, x > lag(x) OVER w AND y >= lag(y) OVER w AS ok FROM k WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey AS curve, count(*) >= 2 AND bool_and(coalesce(ok, true)) AS valid FROM s GROUP BY o_custkey""")
def curve_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as the knots of their customer's curve: x strictly up, y never down, two or more of them."""
    orders = table(spark, sf, "orders")
    x, y = (F.expr(e.replace("//", "div")) for e in (_KNOT_X, _KNOT_Y))
    return C.valid_curves(orders.select(F.col("o_custkey").alias("curve"), F.col("o_orderkey").alias("i"), x.alias("x"), y.alias("y")))


@query(f"WITH {S} SELECT image_id, least(greatest(CASE WHEN score <= 0.4::DOUBLE THEN score / 0.4::DOUBLE * 0.65::DOUBLE ELSE 0.65::DOUBLE + (score - 0.4::DOUBLE) / 0.6::DOUBLE * 0.35::DOUBLE END, 0), 1) AS shifted FROM score_rows")
def shift_curve(spark: SparkSession, sf: str) -> DataFrame:
    return score_rows(spark, sf).select("image_id", C.shift_to_target(F.col("score"), 0.4).alias("shifted"))


@query(f"WITH {S}, {_FUSE_CTE} SELECT image_id, p AS probability, p >= 0.65 AS is_ai, t1 / ln(2) AS bits_detector, t2 / ln(2) AS bits_second FROM f")
def logodds_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("image_id", "probability", "is_ai", "bits_detector", "bits_second")


@query(f"WITH {S} SELECT image_id, least(8, greatest(-8, {math.log(0.3 / 0.7)!r}::DOUBLE + 0.7::DOUBLE * {_logit_sql('score')} + CASE WHEN noise < 0.5 THEN 0.4::DOUBLE * {_logit_sql('score_b')} ELSE 0 END)) AS log_odds FROM score_rows")
def fusion_over_array(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("calibrated"))
    signals = F.array(one("a", F.col("score")), one("b", F.when(F.col("noise") < 0.5, F.col("score_b"))))
    return score_rows(spark, sf).select("image_id", C.fuse_array(signals, {"a": 0.7, "b": 0.4}, 0.3).alias("log_odds"))


@query(f"WITH {S} SELECT image_id, CASE WHEN noise < 0.1 THEN {_CL.format('score_b')} WHEN noise < 0.2 THEN 0.999999::DOUBLE END AS probability FROM score_rows")
def override_path(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("noise")
    signals = F.array(F.struct(F.lit(False).alias("override"), F.lit(0.5).alias("override_p")), F.struct((n < 0.2).alias("override"), F.when(n < 0.1, F.col("score_b")).alias("override_p")))
    return score_rows(spark, sf).select("image_id", C.override(signals).alias("probability"))


@query(f"WITH {S}, g AS (SELECT *, noise >= 0.7 AND score <= 0.5 AS gated FROM score_rows) SELECT image_id, gated, CASE WHEN gated THEN least(score, 0.35) ELSE score END AS capped FROM g")
def graphic_cap(spark: SparkSession, sf: str) -> DataFrame:
    gated = C.graphic_gate(F.col("noise"), F.col("score"), F.lit(0.01), F.lit(0.9), F.lit(0.1), F.lit(5000), {"soft": 0.5})
    return score_rows(spark, sf).select("image_id", gated.alias("gated"), C.graphic_cap(F.col("score"), gated).alias("capped"))


_VETO = f"CASE WHEN p >= 0.65 AND m < 0.1 THEN least(p, {_CL.format(curve_sql('coalesce(md, m)', *CURVE))}, 0.649999::DOUBLE) ELSE p END"


@query(f"WITH {S}, v AS (SELECT image_id, score AS p, noise AS m, CASE WHEN label = 1 THEN noise / 2 END AS md FROM score_rows) SELECT image_id, {_VETO} AS probability FROM v")
def native_veto(spark: SparkSession, sf: str) -> DataFrame:
    median = F.when(F.col("label") == 1, F.col("noise") / 2)
    return score_rows(spark, sf).select("image_id", C.native_veto(F.col("score"), F.col("noise"), median, CURVE).alias("probability"))


def _display_sql(p: str, ai: str) -> str:
    s = lambda v: 1 / (1 + math.exp(-v))
    low, high = min(C.curve_at(s(-8), *CURVE), 0.65), max(C.curve_at(s(8), *CURVE), 0.65)
    pct = f"(CASE WHEN {p} <= 0.65 THEN 2 + ({p} - {low!r}::DOUBLE) / (0.65::DOUBLE - {low!r}::DOUBLE) * 63 ELSE 65 + ({p} - 0.65::DOUBLE) / ({high!r}::DOUBLE - 0.65::DOUBLE) * 33 END)"
    shown = f"floor(least(greatest({pct}, 2), 98) + 0.5)::INT"
    return f"CASE WHEN {ai} THEN greatest({shown}, 65) ELSE least({shown}, 64) END"


@query(f"WITH {S} SELECT image_id, {_display_sql('score', 'score >= 0.65')} AS display FROM score_rows")
def display_percent(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("score")
    return score_rows(spark, sf).select("image_id", C.display_percent(s, s >= C.THRESHOLD, CURVE).alias("display"))


@query(f"""WITH {S}, {_FUSE_CTE}, g AS (SELECT *, CASE WHEN noise >= 0.9 THEN least(p, 0.35::DOUBLE) ELSE p END AS q FROM f), v AS (SELECT image_id, q AS p, noise AS m, NULL::DOUBLE AS md, noise >= 0.9 AS gated FROM g), w AS (SELECT *, {_VETO} AS r FROM v)
SELECT image_id, r AS probability, r >= 0.65 AS is_ai, gated, r < p AS vetoed, {_display_sql("r", "r >= 0.65")} AS display FROM w""")
def decision_chain_full(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrate, sum, squash, calibrate, cap, veto, decide, display, in this order, in one projection chain."""
    rows = decide(_fused(spark, sf), F.col("noise") >= 0.9, F.col("noise"), F.lit(None).cast("double"), CURVE)
    return rows.select("image_id", "probability", "is_ai", "gated", "vetoed", "display")


@query(f"WITH {S} SELECT image_id, NOT (degradation = 'P') AND (source_key::BIGINT % 900) > 440 AND score >= 0.05 AS probe FROM score_rows")
def probe_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    return score_rows(spark, sf).select("image_id", C.wants_probe(F.col("source_key").cast("long") % 900, F.col("score"), F.col("degradation") == "P").alias("probe"))


_SIZES = "SELECT p_partkey AS id, (100 + p_partkey * 7 % 1500)::INT AS w, (90 + p_partkey * 13 % 1100)::INT AS h FROM part"
_O = "CASE WHEN {0} <= 384 THEN [floor(({0} - 384) / 2)::INT] ELSE list_transform(range(0, least(3, ceil({0} / 384))::BIGINT), lambda i: floor(({0} - 384) * i / (least(3, ceil({0} / 384)) - 1) + 0.5)::INT) END"


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf}/part.parquet").select(k.alias("id"), (100 + k * 7 % 1500).cast("int").alias("w"), (90 + k * 13 % 1100).cast("int").alias("h"))


@query(f"WITH s AS ({_SIZES}), o AS (SELECT id, {_O.format('w')} AS xs, {_O.format('h')} AS ys FROM s), y AS (SELECT id, xs, unnest(ys) AS y FROM o) SELECT id, unnest(xs) AS x, y FROM y")
def tile_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(spark, sf).select("id", F.inline(C.tile_grid(F.col("w"), F.col("h"), 384)))


@query(f"""WITH s AS ({_SIZES}), r AS (SELECT id, CASE WHEN w <= h THEN 440 ELSE greatest(440, floor(w * 440 / h)) END AS rw, CASE WHEN w <= h THEN greatest(440, floor(h * 440 / w)) ELSE 440 END AS rh FROM s)
SELECT id, rw::INT AS width, rh::INT AS height, floor((rw - 384) / 2)::INT AS x, floor((rh - 384) / 2)::INT AS y FROM r""")
def crop_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(spark, sf).select("id", C.crop_plan(F.col("w"), F.col("h")).alias("c")).select("id", "c.*")


@query(f"WITH {S}, t AS (SELECT image_id, [score / 8, score_b / 9, noise / 7] AS t FROM score_rows), f AS (SELECT image_id, t, list_filter(t, lambda p: p >= 0.1)[1] AS hit FROM t) SELECT image_id, coalesce(hit, list_max(t)) AS native_max, CASE WHEN hit IS NULL THEN list_sort(t)[2] END AS native_median FROM f")
def early_stop_tiles(spark: SparkSession, sf: str) -> DataFrame:
    tiles = F.array(F.col("score") / 8, F.col("score_b") / 9, F.col("noise") / 7)
    return score_rows(spark, sf).select("image_id", C.stop_at(tiles).alias("n")).select("image_id", "n.*")
