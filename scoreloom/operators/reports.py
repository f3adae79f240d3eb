"""Slices, pivots, rankings and comparisons of scored rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.metrics import best_threshold, hit, point_metrics, roc_auc
from scoreloom.operators.quantiles import exact_quantiles
from scoreloom.operators.staging import stage


def family_slices(rows: DataFrame, threshold: float, family: str = "generator", score: str = "score") -> DataFrame:
    """Each positive family against all negatives, and each negative source against all positives."""
    rows = rows.withColumn("hit", hit(F.col(score), F.col("label"), threshold))
    part = rows.groupBy("label", family).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    total = part.groupBy("label").agg(F.sum("n").alias("n_all"), F.sum("hits").alias("hits_all")).select((1 - F.col("label")).alias("label"), "n_all", "hits_all")
    own, other = F.col("hits") / F.col("n"), F.col("hits_all") / F.col("n_all")
    return part.join(F.broadcast(total), "label").select("label", family, "n", own.alias("own_rate"), other.alias("other_rate"), ((own + other) / 2).alias("balanced_accuracy"))


def pivot_rates(rows: DataFrame, value: Column, row_key: str, column_key: str, columns: Sequence[str]) -> DataFrame:
    """Mean of ``value`` by row, one column for each of ``columns``, and overall; the columns are named, so one pass does."""
    cells = [F.avg(F.when(F.col(column_key) == c, value)).alias(f"rate_{c.lower()}") for c in columns]
    return rows.groupBy(row_key).agg(*cells, F.avg(value).alias("rate_all"))


def cluster_any_rate(rows: DataFrame, fired: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Share of clusters of which any row fired."""
    return rows.groupBy(*keys, "cluster_id").agg(F.max(fired.cast("int")).alias("any")).groupBy(*keys).agg(F.avg("any").alias("cluster_rate"), F.count("*").alias("n_clusters"))


def rates_by(rows: DataFrame, fired: Column, sets: Sequence[Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """Rate of ``fired`` for several groupings at once (one expand, one shuffle); absent keys are ``*``."""
    rows = rows.withColumn("fired", fired.cast("int"))
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.avg("fired").alias("rate"), F.count("*").alias("n"))
    return out.select(*(F.coalesce(F.col(c), F.lit("*")).alias(c) for c in keys), "rate", "n")


def drift(rows: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """How far scorer ``b`` is from ``a``: mean, p99 and largest distance, disagreement, loss of accuracy."""
    d = F.abs(F.col(a) - F.col(b))
    label = F.col("label")
    ba = lambda c: sum(F.avg(F.when(label == k, hit(F.col(c), label, threshold))) for k in (1, 0)) / 2
    differ = (F.col(a) >= threshold) != (F.col(b) >= threshold)
    p99 = F.lit(exact_quantiles(rows, {"d": d}, [0.99])["d"][0]).cast("double")
    return rows.agg(F.avg(d).alias("mean_drift"), F.first(p99).alias("p99_drift"), F.max(d).alias("max_drift"), F.avg(differ.cast("int")).alias("disagreement"), (ba(a) - ba(b)).alias("ba_drop"))


def strategy_ranking(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Score columns ranked by the accuracy of their best threshold, then AUC; read as one long table."""
    long = rows.select("label", F.inline(F.array(*(F.struct(F.lit(c).alias("strategy"), F.col(c).alias("value")) for c in columns))))
    best = best_threshold(long, "value", ["strategy"])
    return best.join(roc_auc(long, "value", ["strategy"]).select("strategy", "auc"), "strategy").orderBy(F.desc("balanced_accuracy"), F.desc("auc"), "strategy")


def condition_summary(rows: DataFrame, threshold: float, condition: str = "degradation", floor: float = 0.8) -> DataFrame:
    """Metrics by condition with the number that reach ``floor`` and the worst condition beside each."""
    by = point_metrics(rows, threshold, keys=[condition])
    total = by.agg(F.count_if(F.col("balanced_accuracy") >= floor).alias("n_passed"), F.min_by(condition, F.struct("balanced_accuracy", condition)).alias("worst"), F.min("balanced_accuracy").alias("worst_ba"), F.avg("balanced_accuracy").alias("mean_ba"))
    return by.crossJoin(F.broadcast(total))


def boundary_at_risk(rows: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """Rows so near the threshold that the 95th percentile of drift could flip them."""
    p95 = F.lit(exact_quantiles(rows, {"d": F.abs(F.col(a) - F.col(b))}, [0.95])["d"][0]).cast("double")
    return rows.agg(F.count_if(F.abs(F.col(a) - threshold) <= p95).alias("at_risk"), F.count("*").alias("n")).select(p95.alias("p95"), "at_risk", "n")


def gate_effect(rows: DataFrame, gated: Column, threshold: float, cap: float = 0.35, score: str = "score") -> DataFrame:
    """Metrics before and after capping gated rows, with false positives rescued and true positives lost."""
    after = F.when(gated, F.least(F.col(score), F.lit(cap))).otherwise(F.col(score))
    rows = rows.withColumn("before", hit(F.col(score), F.col("label"), threshold)).withColumn("after", hit(after, F.col("label"), threshold))
    rate = lambda c, k: F.avg(F.when(F.col("label") == k, F.col(c)))
    ba = lambda c: ((rate(c, 1) + rate(c, 0)) / 2).alias(f"ba_{c}")
    rescued = F.count_if((F.col("label") == 0) & (F.col("before") == 0) & (F.col("after") == 1))
    lost = F.count_if((F.col("label") == 1) & (F.col("before") == 1) & (F.col("after") == 0))
    return rows.agg(ba("before"), ba("after"), rescued.alias("rescued"), lost.alias("lost"), F.count_if(gated).alias("n_gated"))


def grid_search(rows: DataFrame, grid: DataFrame, limits: dict[str, tuple[str, str]], most_lost: float) -> DataFrame:
    """The grid row that fires on most negatives while firing on at most ``most_lost`` of the positives; ties go to the least id.

    ``limits`` has a grid column's measure and side, ``<=`` or ``>=``; a grid row
    fires where all of its limits hold. Rows are first counted by the steps of
    each limit that they pass, so they meet as many counts as there are
    combinations of steps, never the grid; unknown values pass none.
    """
    steps = {c: sorted({r[0] for r in grid.select(c).distinct().collect()}, reverse=side == ">=") for c, (_, side) in limits.items()}
    level = lambda c: sum(F.coalesce(F.col(limits[c][0]) <= v if limits[c][1] == "<=" else F.col(limits[c][0]) >= v, F.lit(False)).cast("int") for v in steps[c])
    cells = rows.groupBy("label", *(level(c).alias(f"_{c}") for c in limits)).agg(F.count("*").alias("n"))
    reach = lambda c: F.lit(len(steps[c])) - F.array_position(F.array(*map(F.lit, steps[c])), F.col(c)) + 1
    fires = reduce(lambda a, b: a & b, (F.col(f"_{c}") >= reach(c) for c in limits))
    part = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    hits = cells.crossJoin(F.broadcast(grid)).groupBy(*grid.columns).agg(part(fires & (F.col("label") == 0)).alias("caught"), part(fires & (F.col("label") == 1)).alias("lost"), part(F.col("label") == 1).alias("n_ai"))
    allowed = hits.where(F.col("lost") <= most_lost * F.col("n_ai"))
    return allowed.groupBy().agg(F.max(F.struct("caught", (-F.col("lost")).alias("neg_lost"), (-F.col("grid_id")).alias("neg_id"), F.struct(*grid.columns).alias("g"))).alias("m")).select("m.g.*", "m.caught", (-F.col("m.neg_lost")).alias("lost"))


def tile_aggregates(rows: DataFrame, tiles: str = "tiles") -> DataFrame:
    """Mean, max, median, upper middle, top-2 and top-3 means and noisy-or of an array of tile probabilities; nulls for an empty one."""
    t, n = F.col(tiles), F.size(tiles)
    down = F.sort_array(t, asc=False)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size(a), F.lit(0))
    up = F.sort_array(t)
    mid = (F.get(up, F.floor((n - 1) / 2).cast("int")) + F.get(up, F.floor(n / 2).cast("int"))) / 2
    made = {"mean": mean(t), "max": F.array_max(t), "median": mid, "upper_middle": F.get(up, F.floor(n / 2).cast("int")), "top2": mean(F.slice(down, 1, 2)), "top3": mean(F.slice(down, 1, 3)), "noisy_or": F.when(n > 0, 1 - F.aggregate(t, F.lit(1.0), lambda x, y: x * (1 - y)))}
    return rows.select(*(c for c in rows.columns if c != tiles), *(c.alias(f"tile_{k}") for k, c in made.items()))


def stratified_parity(rows: DataFrame, a: str, b: str, threshold: float, per_stratum: int, strata: Sequence[str]) -> DataFrame:
    """Median, p95 and greatest distance of two scorers on the rows of least id hash in each stratum, and flipped decisions."""
    from pyspark.sql import Window

    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5("image_id"), "image_id"))).where(F.col("r") <= per_stratum)
    d, ranked = F.abs(F.col(a) - F.col(b)), stage(ranked.select(a, b), "parity")
    middle, high = (F.lit(x).cast("double") for x in exact_quantiles(ranked, {"d": d}, [0.5, 0.95])["d"])
    return ranked.agg(F.first(middle).alias("median_diff"), F.first(high).alias("p95_diff"), F.max(d).alias("max_diff"), F.count_if((F.col(a) >= threshold) != (F.col(b) >= threshold)).alias("flips"), F.count("*").alias("n"))


def minimum_counts(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Rows by ``key`` and label on the complete grid of both, absent cells as 0, with whether ``least`` is reached."""
    grid = rows.select(key).distinct().crossJoin(rows.sparkSession.createDataFrame([(0,), (1,)], "label int"))
    counts = rows.groupBy(key, "label").agg(F.count("*").alias("n"))
    return grid.join(counts, [key, "label"], "left").select(key, "label", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= least).alias("passed"))
