"""Fitted parts: calibration curves, balanced logistic models, grouped out-of-fold probabilities, leakage verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.scalars import EPSILON, THRESHOLD
from scoreloom.operators.metrics import best_threshold, oracle_balanced_accuracy, point_metrics, roc_auc
from scoreloom.operators.ordering import dense_index, finite
from scoreloom.operators.quantiles import exact_quantiles
from scoreloom.operators.staging import stage


def impute_medians(rows: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Non-finite values of ``columns`` replaced by the exact median of the rows to fit on, 0 where there is none."""
    good = {c: F.when(finite(F.col(c)), F.col(c)) for c in columns}
    medians = exact_quantiles(rows if fit_on is None else rows.where(fit_on), good, [0.5])
    return rows.withColumns({c: F.coalesce(good[c], F.lit(medians[c][0] or 0.0)) for c in columns})


class Logistic:
    """Standardised logistic regression with balanced classes; probabilities as a column expression."""

    def __init__(self, columns: Sequence[str], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.columns, self.mean, self.scale, self.weights, self.bias = list(columns), mean, scale, weights, bias

    def margin(self) -> Column:
        out = F.lit(float(self.bias))
        for c, m, s, w in zip(self.columns, self.mean, self.scale, self.weights, strict=True):
            out = out + (F.col(c) - F.lit(float(m))) * F.lit(float(w / s))
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def _counted_stats(rows: DataFrame, columns: Sequence[str], label: str, count: str) -> dict:
    """Rows, positives, means and population deviations of rows that stand for ``count`` equal ones; 0 for a column that does not vary."""
    n = F.col(count)
    first = rows.agg(F.sum(n).alias("n"), F.sum(F.col(label) * n).alias("p"), *(F.sum(F.col(x) * n).alias(f"m_{x}") for x in columns), *(F.min(x).alias(f"lo_{x}") for x in columns), *(F.max(x).alias(f"hi_{x}") for x in columns)).first().asDict()
    total = first["n"] or 0
    varies = {x: first[f"lo_{x}"] != first[f"hi_{x}"] for x in columns}
    mean = {x: first[f"m_{x}"] / total if varies[x] else first[f"lo_{x}"] for x in columns}
    out = {"n": total, "p": first["p"]} | {f"m_{x}": mean[x] for x in columns} | {f"s_{x}": 0.0 for x in columns}
    if moving := [x for x in columns if varies[x]]:
        square = rows.agg(*(F.sum(n * (F.col(x) - F.lit(float(mean[x]))) ** 2).alias(x) for x in moving)).first()
        out |= {f"s_{x}": (square[x] / total) ** 0.5 for x in moving}
    return out


def fit_logistic(rows: DataFrame, columns: Sequence[str], label: str = "label", c: float = 1.0, standardise: bool = True, balanced: bool = True, count: str | None = None) -> Logistic | None:
    """None for fewer than 8 rows, one class, or columns that do not vary. Classes weigh alike if ``balanced``, and else each row.

    Population deviations; the penalty is that of a regularised sum over rows
    with weight ``c`` on the loss. ``count`` names a column that tells for how
    many equal rows a row stands.
    """
    stats = _counted_stats(rows, columns, label, count) if count else rows.agg(F.count("*").alias("n"), F.sum(label).alias("p"), *(F.avg(x).alias(f"m_{x}") for x in columns), *(F.stddev_pop(x).alias(f"s_{x}") for x in columns)).first().asDict()
    n, p = stats["n"], stats["p"] or 0
    if n < 8 or not 0 < p < n:
        return None
    mean, scale = (np.array([float(stats[f"{k}_{x}"] or 0.0) for x in columns]) for k in "ms")
    if scale.sum() == 0:
        return None
    moving = np.flatnonzero(scale > 0) if standardise else np.arange(len(columns))  # a standardised constant is 0 and has no weight
    mean, scale = (mean, np.where(scale > 0, scale, 1.0)) if standardise else (np.zeros(len(columns)), np.ones(len(columns)))
    z = {f"_z{i}": (F.col(columns[i]) - float(mean[i])) / float(scale[i]) for i in moving.tolist()}
    weight = F.when(F.col(label) == 1, F.lit(n / (2 * p))).otherwise(F.lit(n / (2 * (n - p)))) if balanced else F.lit(1.0)
    if count:
        weight = weight * F.col(count)
    data = rows.select(F.col(label).cast("double").alias("label"), weight.alias("w"), *(v.alias(k) for k, v in z.items()))
    data = VectorAssembler(inputCols=list(z), outputCol="features").transform(data).select("label", "w", "features")
    fit = LogisticRegression(weightCol="w", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8).fit(data)
    weights = np.zeros(len(columns))
    weights[moving] = np.array(fit.coefficients)
    return Logistic(columns, mean, scale, weights, float(fit.intercept))


def group_folds(rows: DataFrame, group: str, k: int, label: str = "label", name: str = "fold") -> DataFrame:
    """Whole groups dealt to ``k`` folds in turn, by label, in the order of their hash; a group has one label."""
    groups = rows.select(group, label).distinct()
    return rows.join(dense_index(groups, group, [label]).select(group, label, F.pmod("idx", F.lit(k)).alias(name)), [group, label])


def out_of_fold(rows: DataFrame, columns: Sequence[str], group: str, label: str = "label", most_folds: int = 5, balanced: bool = True, alike: bool = False) -> DataFrame:
    """``rows`` with ``fold`` and the ``probability`` by a model that saw no row of the group's fold.

    As many folds as the smaller class has groups, 2 to ``most_folds``. If many
    rows are ``alike``, the models are fitted on distinct rows of a fold that
    weigh as often as they occur, which is the same sum.
    """
    few = rows.groupBy(label).agg(F.countDistinct(group).alias("n")).agg(F.min("n"), F.count("*")).first()
    k = min(most_folds, few[0] or 0)
    if k < 2 or few[1] < 2:
        raise ValueError("out-of-fold needs two groups or more of both labels")
    rows = stage(group_folds(rows, group, k, label), "folds")
    fitted, count = rows, None
    if alike:
        count = "_count"
        fitted = stage(rows.groupBy("fold", label, *columns).agg(F.count("*").alias(count)), "alike")
    p = F.lit(None).cast("double")
    for f in range(k):
        model = fit_logistic(fitted.where(F.col("fold") != f), columns, label, balanced=balanced, count=count)
        p = F.when(F.col("fold") == f, model.probability() if model else F.lit(0.5)).otherwise(p)
    return rows.withColumn("probability", p)


def pack_nulls(rows: DataFrame, packs: dict[str, Sequence[str]], label: str = "label") -> DataFrame:
    """``(pack, threshold, fit_ba, fair_ba, oracle_ba)``: how well a balanced logistic model of each set of columns tells the label.

    Models, medians of missing values and thresholds are of the split ``fit``
    and judged on ``eval``; packs that cannot be fitted have no row.
    """
    out, rows = [], stage(rows, "packs")
    for pack, columns in packs.items():
        filled = stage(impute_medians(rows, columns, F.col("split") == "fit").select("split", label, *columns), "pack")
        model = fit_logistic(filled.where("split = 'fit'"), columns, label)
        if model is None:
            continue
        scored = filled.select("split", label, model.probability().alias("score"))
        best = best_threshold(scored.where("split = 'fit'")).first()
        judged = point_metrics(scored.where("split = 'eval'"), best.threshold).select("balanced_accuracy").crossJoin(F.broadcast(oracle_balanced_accuracy(scored.where("split = 'eval'"))))
        out.append(judged.select(F.lit(pack).alias("pack"), F.lit(best.threshold).alias("threshold"), F.lit(best.balanced_accuracy).alias("fit_ba"), F.col("balanced_accuracy").alias("fair_ba"), "oracle_ba"))
    return reduce(DataFrame.union, out) if out else rows.sparkSession.createDataFrame([], "pack string, threshold double, fit_ba double, fair_ba double, oracle_ba double")


def leakage_verdict(scored: DataFrame, warn: float = 0.6, fail: float = 0.7) -> DataFrame:
    """AUC of out-of-fold probabilities of the label from metadata alone, and what it means."""
    auc = F.col("auc")
    return roc_auc(scored, "probability").select("auc", F.when(auc >= fail, "fail").when(auc >= warn, "warn").otherwise("pass").alias("verdict"))


def fit_platt(rows: DataFrame, score: str = "score", label: str = "label") -> tuple[float, float]:
    """Slope and intercept of the balanced logistic fit on the score's log-odds; the slope must be positive."""
    p = F.least(F.greatest(F.col(score), F.lit(EPSILON)), F.lit(1 - EPSILON))
    fit = fit_logistic(rows.select(F.ln(p / (1 - p)).alias("x"), F.col(label).alias("label")), ["x"], standardise=False)
    if fit is None or fit.weights[0] <= 0:
        raise ValueError("the score does not rank the classes")
    return float(fit.weights[0]), fit.bias


def fit_curve(rows: DataFrame, most_knots: int = 64, score: str = "score", label: str = "label") -> dict:
    """A monotone calibration curve that takes the best raw threshold to 0.65.

    The fit and the threshold sweep run on all rows; only the grid of some 800
    points that draws the curve is computed on the driver.
    """
    slope, bias = fit_platt(rows, score, label)
    squash = lambda x: 1 / (1 + np.exp(-(slope * np.log(np.clip(x, EPSILON, 1 - EPSILON) / (1 - np.clip(x, EPSILON, 1 - EPSILON))) + bias)))
    p = F.least(F.greatest(F.col(score), F.lit(EPSILON)), F.lit(1 - EPSILON))
    calibrated = rows.select(F.col(label).alias("label"), (1 / (1 + F.exp(-(F.lit(slope) * F.ln(p / (1 - p)) + F.lit(bias))))).alias("score"))
    best = best_threshold(calibrated).first()
    at = min(max(best.threshold, 1e-9), 1 - 1e-9)
    logit = (np.log(at / (1 - at)) - bias) / slope
    anchor = float(1 / (1 + np.exp(-logit)))
    dense = np.geomspace(EPSILON, 0.1, 160)
    xs = np.unique(np.concatenate([[0.0, anchor, 1.0], dense, 1 - dense, np.linspace(0, 1, 512)]))
    y = squash(xs)
    ys = np.clip(np.where(y <= at, y / at * THRESHOLD, THRESHOLD + (y - at) / (1 - at) * (1 - THRESHOLD)), 0, 1)
    moving = np.concatenate([[True], (np.abs(np.diff(ys))[:-1] > 1e-9) | (np.abs(np.diff(ys))[1:] > 1e-9), [True]])
    keep = np.flatnonzero(moving)
    if len(keep) > most_knots - 1:
        keep = keep[np.unique(np.linspace(0, len(keep) - 1, max(2, most_knots - 1)).round().astype(int))]
    knots = dict(zip(xs[keep].tolist(), ys[keep].tolist(), strict=True)) | {anchor: THRESHOLD}
    xs, ys = zip(*sorted(knots.items()), strict=True)
    return {"xs": list(xs), "ys": np.maximum.accumulate(ys).tolist(), "tStar": best.threshold, "fitBalancedAccuracy": best.balanced_accuracy, "target": THRESHOLD}


def one_hot(rows: DataFrame, column: str, values: Sequence[str]) -> dict[str, Column]:
    return {f"{column}={v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("double") for v in values}


def manifest_features(rows: DataFrame, construction: bool = False) -> tuple[DataFrame, list[str]]:
    """Numeric columns of a degradation manifest: what a chain, its steps and its sizes tell without looking at pixels.

    ``construction`` leaves out byte counts. Categories are few and read once.
    """
    values = {c: sorted(r[0] for r in rows.select(F.coalesce(F.col(c), F.lit("unknown"))).distinct().collect()) for c in ("chain", "source_format", "output_format")}
    rows = rows.fillna("unknown", list(values))
    step = lambda *codecs: F.filter("steps", lambda s: s["op"].isin(*codecs) | ((s["op"] == "social_pipeline") & s["codec"].isin(*codecs)))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, s: t + F.coalesce(s["quality"].cast("double"), F.lit(0.0))) / F.size(a)).otherwise(0.0)
    last = lambda op, field, default: F.coalesce(F.get(F.slice(F.filter("steps", lambda s: (s["op"] == op) & s[field].isNotNull()), -1, 1), 0)[field].cast("double"), F.lit(default))
    size = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    one = lambda c: F.greatest(size(c), F.lit(1.0))
    jpeg, webp = step("jpeg"), step("webp")
    made = {k: v for c, vs in values.items() for k, v in one_hot(rows, c, vs).items()} | {
        "jpeg_quality": mean(jpeg), "jpeg_count": F.size(jpeg).cast("double"), "webp_quality": mean(webp), "webp_count": F.size(webp).cast("double"),
        "rescale_target": last("rescale", "target", 0.0), "upscale_factor": last("upscale", "factor", 1.0), "device_pixel_ratio": last("screen_capture", "device_pixel_ratio", 1.0),
        "lossy_encode_count": F.coalesce(F.col("lossy_encode_count").cast("double"), (F.size(jpeg) + F.size(webp)).cast("double")), "n_steps": F.size("steps").cast("double"),
    }
    for side in ("source", "output"):
        w, h = f"{side}_width", f"{side}_height"
        made |= {f"{side}_w": size(w), f"{side}_h": size(h), f"{side}_log_pixels": F.log1p(size(w) * size(h)), f"{side}_log_aspect": F.ln(one(w) / one(h))}
        if not construction:
            made[f"{side}_log_bytes"] = F.log1p(size(f"{side}_bytes"))
    names = {f"f{i}": k for i, k in enumerate(made)}
    return rows.withColumns({f: made[k] for f, k in names.items()}), list(names)


def top_coefficients(model: Logistic, names: dict[str, str] | None = None, most: int = 10) -> list[tuple[str, float]]:
    pairs = [((names or {}).get(c, c), float(w)) for c, w in zip(model.columns, model.weights, strict=True)]
    return sorted(pairs, key=lambda x: (-abs(x[1]), x[0]))[:most]


def vectors(rows: DataFrame, column: str) -> DataFrame:
    """An ML vector column as an array."""
    return rows.withColumn(column, vector_to_array(column))
