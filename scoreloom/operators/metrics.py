"""Fixed-threshold metrics and their source-clustered intervals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.ordering import finite, running_totals
from scoreloom.operators.resampling import intervals, null_accuracies, per_cluster, replicates, statistics_of


def cluster_id(df: DataFrame) -> Column:
    """The first of cluster_id, source_sha256, source_key, image_id that is not blank, of those present."""
    have = [c for c in ("cluster_id", "source_sha256", "source_key", "image_id") if c in df.columns]
    return F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in have))


def hit(score: Column, label: Column, threshold: Column | float) -> Column:
    """1 where the side of the threshold agrees with the label; scores at the threshold are positive, others than finite ones never agree."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (finite(score) & F.when(label == 1, score >= t).otherwise(score < t)).cast("int")


def rates(hits: str = "hit", label: str = "label") -> list[Column]:
    """tpr, tnr and balanced accuracy as aggregates; null without rows of a class."""
    tpr, tnr = (F.avg(F.when(F.col(label) == k, F.col(hits))) for k in (1, 0))
    return [tpr.alias("tpr"), tnr.alias("tnr"), ((tpr + tnr) / 2).alias("balanced_accuracy")]


def point_metrics(rows: DataFrame, threshold: float, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    counts = [F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_ai"), F.count_if(F.col("label") == 0).alias("n_real")]
    return rows.withColumn("hit", hit(F.col(score), F.col("label"), threshold)).groupBy(*keys).agg(*rates(), *counts)


def confusion(rows: DataFrame, threshold: float, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    over = finite(F.col(score)) & (F.col(score) >= threshold)
    cell = lambda predicted, label: F.count_if(predicted & (F.col("label") == label))
    return rows.groupBy(*keys).agg(cell(over, 1).alias("tp"), cell(~over, 1).alias("fn"), cell(~over, 0).alias("tn"), cell(over, 0).alias("fp"))


def null_baselines(rows: DataFrame) -> DataFrame:
    """What no information achieves: always one class, or the positive rate of the prevalence."""
    share = rows.agg(F.avg("label").alias("positive_rate"), F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).where("p > 0 and q > 0")
    one = lambda name, tpr, tnr, rate: F.struct(F.lit(name).alias("baseline"), tpr.alias("tpr"), tnr.alias("tnr"), F.lit(0.5).alias("balanced_accuracy"), rate.alias("positive_rate"))
    zero, full, p = F.lit(0.0), F.lit(1.0), F.col("positive_rate")
    return share.select(F.inline(F.array(one("always_real", zero, full, zero), one("always_ai", full, zero, full), one("prevalence", p, 1 - p, p))))


def _sides(name: str = "hit") -> Callable[[Callable[[str, int], Column]], Mapping[str, Column]]:
    """tpr, tnr and balanced accuracy from sums of hits by label."""

    def make(of: Callable[[str, int], Column]) -> Mapping[str, Column]:
        tpr, tnr = (of(name, k) / of("n", k) for k in (1, 0))
        return {"tpr": tpr, "tnr": tnr, "balanced_accuracy": (tpr + tnr) / 2}

    return make


def clustered_interval(rows: DataFrame, threshold: float, samples: int = 200, confidence: float = 0.95, seed: str = "20260814", score: str = "score", unit_of_positives: str | None = None, method: str = "draws") -> DataFrame:
    """Metrics of all rows and percentile intervals from resampling sources within each class, one row for each metric.

    ``unit_of_positives`` names a column that is resampled instead of the
    cluster on the positive side.
    """
    if samples < 200 or not 0.5 < confidence < 1:
        raise ValueError("at least 200 samples and a confidence in (0.5, 1)")
    unit = F.col("cluster_id") if unit_of_positives is None else F.when(F.col("label") == 1, F.col(unit_of_positives)).otherwise(F.col("cluster_id"))
    rows = rows.withColumn("hit", hit(F.col(score), F.col("label"), threshold)).withColumn("cluster_id", unit)
    sums, names = {"hit": F.col("hit")}, ("tpr", "tnr", "balanced_accuracy")
    bounds = intervals(replicates(rows, sums, _sides(), samples, seed, method), names, confidence)
    counts = per_cluster(rows, sums).agg(F.count_if(F.col("label") == 1).alias("n_ai_clusters"), F.count_if(F.col("label") == 0).alias("n_real_clusters"))
    point = statistics_of(rows, sums, _sides()).select(*(F.col(c).alias(f"p_{c}") for c in names)).crossJoin(F.broadcast(counts))
    one = lambda c: F.struct(F.lit(c).alias("metric"), F.col(f"p_{c}").alias("value"), F.get(c, 0).alias("ci_lower"), F.get(c, 1).alias("ci_upper"), "n_ai_clusters", "n_real_clusters")
    return point.crossJoin(F.broadcast(bounds)).select(F.inline(F.array(*map(one, names))))


def _paired_hits(rows: DataFrame, threshold: float, a: str, b: str) -> DataFrame:
    return rows.withColumn("hit_a", hit(F.col(a), F.col("label"), threshold)).withColumn("hit_b", hit(F.col(b), F.col("label"), threshold))


def paired_point(rows: DataFrame, threshold: float, a: str, b: str) -> DataFrame:
    """Balanced accuracy of scorer ``a`` less that of ``b``, with the 2 x 2 table of agreement: one scan, no resamples."""
    rows = _paired_hits(rows, threshold, a, b)
    side = lambda k: F.avg(F.when(F.col("label") == k, F.col("hit_a") - F.col("hit_b")))
    cell = lambda x, y: F.count_if((F.col("hit_a") == x) & (F.col("hit_b") == y))
    return rows.agg(((side(1) + side(0)) / 2).alias("delta"), cell(1, 1).alias("both"), cell(1, 0).alias("only_a"), cell(0, 1).alias("only_b"), cell(0, 0).alias("neither"))


def paired_delta(rows: DataFrame, threshold: float, a: str, b: str, samples: int = 200, seed: str = "20260814") -> DataFrame:
    """:func:`paired_point` with an interval of the difference on shared resamples."""
    hits = _paired_hits(rows, threshold, a, b)
    delta = lambda of: {"delta": sum((of("hit_a", k) - of("hit_b", k)) / of("n", k) for k in (1, 0)) / 2}
    bounds = intervals(replicates(hits, {"hit_a": F.col("hit_a"), "hit_b": F.col("hit_b")}, delta, samples, seed), ["delta"], 0.95)
    bounds = bounds.select(F.get("delta", 0).alias("ci_lower"), F.get("delta", 1).alias("ci_upper"))
    return paired_point(rows, threshold, a, b).crossJoin(F.broadcast(bounds))


def roc_auc(rows: DataFrame, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive outscores a negative, ties half; from counts by distinct score instead of all pairs."""
    p, q = F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")
    by_score = rows.where(finite(F.col(score))).groupBy(*keys, F.col(score).alias("s")).agg(p, q)
    total = running_totals(by_score, "s", ["p", "q"], keys)
    wins = F.sum(F.col("p") * (F.col("q_to") - F.col("q") / 2))
    return total.groupBy(*keys).agg((wins / F.nullif(F.max("p_all") * F.max("q_all"), F.lit(0))).alias("auc"), F.max("p_all").alias("n_ai"), F.max("q_all").alias("n_real"))


def best_threshold(rows: DataFrame, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """The least distinct score of greatest balanced accuracy, in one pass over counts by score; keys with one class give no row."""
    p, q = F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")
    by_score = rows.where(finite(F.col(score))).groupBy(*keys, F.col(score).alias("s")).agg(p, q)
    total = running_totals(by_score, "s", ["p", "q"], keys).where("p_all > 0 and q_all > 0")
    tpr = (F.col("p_all") - F.col("p_to") + F.col("p")) / F.col("p_all")
    total = total.withColumn("ba", (tpr + (F.col("q_to") - F.col("q")) / F.col("q_all")) / 2)
    best = F.max(F.struct(F.col("ba"), -F.col("s")))
    return total.groupBy(*keys).agg(best.alias("m")).where("m is not null").select(*keys, (-F.col("m.col2")).alias("threshold"), F.col("m.ba").alias("balanced_accuracy"))


def two_sided_stump(rows: DataFrame, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """The better of a threshold on the score and one on its negative; a tie keeps the score."""
    up = best_threshold(rows, score, keys).withColumn("polarity", F.lit(1))
    down = best_threshold(rows.withColumn(score, -F.col(score)), score, keys).withColumn("polarity", F.lit(-1))
    best = F.max_by(F.struct("polarity", "threshold", "balanced_accuracy"), F.struct("balanced_accuracy", "polarity"))
    return up.unionByName(down).groupBy(*keys).agg(best.alias("m")).where("m is not null").select(*keys, "m.polarity", "m.threshold", "m.balanced_accuracy")


def oracle_balanced_accuracy(rows: DataFrame, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Balanced accuracy of the best two-sided threshold fitted on the rows themselves: half of 1 + the largest gap of the class distributions."""
    p, q = F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")
    by_score = rows.where(finite(F.col(score))).groupBy(*keys, F.col(score).alias("s")).agg(p, q)
    total = running_totals(by_score, "s", ["p", "q"], keys).where("p_all > 0 and q_all > 0")
    gap = F.abs(F.col("p_to") / F.col("p_all") - F.col("q_to") / F.col("q_all"))
    return total.groupBy(*keys).agg(((1 + F.max(gap)) / 2).alias("oracle_ba")).where("oracle_ba is not null")


def permutation_gate(rows: DataFrame, score: str = "score", samples: int = 999, seed: str = "20260813", tests: int = 1) -> DataFrame:
    """Is the oracle accuracy of a feature more than shuffled cluster labels give?

    In each replicate the clusters of least keyed number become positive, as
    many as really are. The p-value counts the real one in and is corrected for
    ``tests`` probes; the verdict fails below 0.01 with an excess over the
    null's median of 0.1 or more, and warns below 0.05.
    """
    clusters = rows.select("cluster_id", "label").distinct()
    null = null_accuracies(rows.select("cluster_id", F.col(score).alias("score")), clusters, samples, seed)
    seen = oracle_balanced_accuracy(rows, score)
    both = null.crossJoin(F.broadcast(seen.withColumnRenamed("oracle_ba", "observed")))
    out = both.groupBy("observed").agg(F.count_if(F.col("oracle_ba") >= F.col("observed") - 1e-12).alias("n_ge"), F.percentile("oracle_ba", F.lit(0.5)).alias("null_median"), F.count("*").alias("samples"))
    p, excess = (1 + F.col("n_ge")) / (1 + F.col("samples")), F.col("observed") - F.col("null_median")
    corrected = F.least(F.lit(1.0), p * tests)
    verdict = F.when((corrected < 0.01) & (excess >= 0.1), "fail").when(corrected < 0.05, "warn").otherwise("pass")
    return out.select("observed", "null_median", excess.alias("excess"), p.alias("p_value"), corrected.alias("corrected_p"), verdict.alias("verdict"))
