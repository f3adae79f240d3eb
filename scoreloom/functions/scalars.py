"""Calibration curves, log-odds fusion and the decision chain as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decision rules (fixed values).
THRESHOLD, EPSILON, MOST_LOG_ODDS = 0.65, 1e-6, 8.0
GRAPHIC_CAP, VETO_BELOW, PROBE_FLOOR, PROBE_EDGE = 0.35, 0.1, 0.05, 440
SHOWN_LEAST, SHOWN_THRESHOLD, SHOWN_MOST = 2, 65, 98


def must_be_finite(x: Column) -> Column:
    """``x``, or an error for null, NaN and the infinities."""
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(good, x).otherwise(F.raise_error(F.lit("non-finite probability")).cast("double"))


def clamp(p: Column, epsilon: float = EPSILON) -> Column:
    return F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))


def logit(p: Column) -> Column:
    c = clamp(p)
    return F.ln(c / (1 - c))


def sigmoid(x: Column) -> Column:
    """Stable on both sides: only exponentials of nonpositive numbers."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def check_curve(xs: Sequence[float], ys: Sequence[float]) -> None:
    if len(xs) != len(ys) or len(xs) < 2:
        raise ValueError("a curve needs two or more knots and as many values")
    if not all(map(math.isfinite, [*xs, *ys])):
        raise ValueError("knots must be finite")
    if any(b <= a for a, b in zip(xs, xs[1:], strict=False)) or any(b < a for a, b in zip(ys, ys[1:], strict=False)):
        raise ValueError("knots must rise, and values must not fall")


def apply_curve(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear interpolation between knots, constant beyond them.

    Knots are literals, found by halving: a tree of conditions that code
    generation compiles, with a depth of the logarithm of the knots.
    """
    check_curve(xs, ys)

    def between(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(ys[lo]) + (x - F.lit(xs[lo])) / F.lit(xs[hi] - xs[lo]) * F.lit(ys[hi] - ys[lo])
        mid = (lo + hi) // 2
        return F.when(x < xs[mid], between(lo, mid)).otherwise(between(mid, hi))

    return F.when(x <= xs[0], F.lit(float(ys[0]))).when(x >= xs[-1], F.lit(float(ys[-1]))).otherwise(between(0, len(xs) - 1))


def curve_at(x: float, xs: Sequence[float], ys: Sequence[float]) -> float:
    """The curve's value on the driver."""
    import numpy as np

    return float(np.interp(x, xs, ys))


def shift_to_target(y: Column, at: float, target: float = THRESHOLD) -> Column:
    """The piecewise-linear rising map of [0, 1] that takes ``at`` to ``target``."""
    t = min(max(at, 1e-9), 1 - 1e-9)
    return F.least(F.greatest(F.when(y <= t, y / t * target).otherwise(target + (y - t) / (1 - t) * (1 - target)), F.lit(0.0)), F.lit(1.0))


def fuse_array(signals: Column, weights: dict[str, float], prior: float = 0.5) -> Column:
    """Clamped log-odds total of an array of structs (name, calibrated); unknown names are an error."""
    table = F.create_map(*(F.lit(v) for kv in weights.items() for v in kv))

    def term(s: Column) -> Column:
        w = F.coalesce(F.element_at(table, s["name"]), F.raise_error(F.concat(F.lit("no weight for signal "), s["name"])).cast("double"))
        return F.when(s["calibrated"].isNull(), 0.0).otherwise(w * logit(s["calibrated"]))

    total = F.aggregate(signals, F.lit(math.log(prior / (1 - prior))), lambda acc, s: acc + term(s))
    return F.least(F.greatest(total, F.lit(-MOST_LOG_ODDS)), F.lit(MOST_LOG_ODDS))


def override(signals: Column) -> Column:
    """Probability of the first signal that overrides (``1 - EPSILON`` if it has none), null without one."""
    first = F.get(F.filter(signals, lambda s: s["override"]), 0)
    return F.when(first.isNotNull(), clamp(F.coalesce(first["override_p"], F.lit(1 - EPSILON))))


def graphic_gate(flat: Column, soft: Column, hard: Column, top8: Column, patch_soft: Column, pixels: Column, t: dict[str, float] | None = None) -> Column:
    """All six conditions under which an image is a flat graphic."""
    t = {"flat": 0.7, "soft": 0.18, "hard": 0.0005, "top8": 0.68, "patch_soft": 0.16, "pixels": 1024} | (t or {})
    return (pixels >= t["pixels"]) & (flat >= t["flat"]) & (soft <= t["soft"]) & (hard >= t["hard"]) & (top8 >= t["top8"]) & (patch_soft <= t["patch_soft"])


def graphic_cap(p: Column, gated: Column) -> Column:
    return F.when(gated, F.least(p, F.lit(GRAPHIC_CAP))).otherwise(p)


def wants_probe(short_edge: Column, score: Column, gated: Column) -> Column:
    return ~gated & (short_edge > PROBE_EDGE) & (score >= PROBE_FLOOR)


def native_veto(p: Column, most: Column, median: Column, curve: tuple[Sequence[float], Sequence[float]]) -> Column:
    """A positive verdict falls to what the native tiles say if even the greatest of them is low."""
    raw = F.when(median.isNotNull() & ~F.isnan(median), median).otherwise(most)
    capped = F.least(p, clamp(apply_curve(raw, *curve)), F.lit(THRESHOLD - 1e-6))
    return F.when((p >= THRESHOLD) & F.coalesce(most < VETO_BELOW, F.lit(False)), capped).otherwise(p)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def display_percent(p: Column, is_ai: Column, curve: tuple[Sequence[float], Sequence[float]]) -> Column:
    """Whole percent through three anchors (least, threshold, most), on the verdict's side of the threshold."""
    s = lambda v: 1 / (1 + math.exp(-v))
    low, high = min(curve_at(s(-MOST_LOG_ODDS), *curve), THRESHOLD), max(curve_at(s(MOST_LOG_ODDS), *curve), THRESHOLD)
    down = (p - low) / (THRESHOLD - low) if THRESHOLD > low else F.lit(1.0)
    up = (p - THRESHOLD) / (high - THRESHOLD) if high > THRESHOLD else F.lit(0.0)
    pct = F.when(p <= THRESHOLD, SHOWN_LEAST + down * (SHOWN_THRESHOLD - SHOWN_LEAST)).otherwise(SHOWN_THRESHOLD + up * (SHOWN_MOST - SHOWN_THRESHOLD))
    shown = round_half_up(F.least(F.greatest(pct, F.lit(float(SHOWN_LEAST))), F.lit(float(SHOWN_MOST))))
    return F.when(is_ai, F.greatest(shown, F.lit(SHOWN_THRESHOLD))).otherwise(F.least(shown, F.lit(SHOWN_THRESHOLD - 1))).cast("int")


def log10_safe(x: Column, least: float = 1e-12) -> Column:
    return F.log10(F.greatest(x, F.lit(least)))


def origins(length: Column, tile: int, most: int = 3) -> Column:
    """Starts of tiles that cover an edge: one centred if it fits, else spread from 0 to the last."""
    last, count = length - tile, F.least(F.lit(most), F.ceil(length / tile)).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(2)) - 1), lambda i: F.floor(last * i / (count - 1) + 0.5).cast("int"))
    return F.when(length <= tile, F.array(F.floor((length - tile) / 2).cast("int"))).when(count == 1, F.array(F.floor(last / 2 + 0.5).cast("int"))).otherwise(spread)


def tile_grid(width: Column, height: Column, tile: int, most: int = 3) -> Column:
    """Tiles (x, y), row by row."""
    xs = origins(width, tile, most)
    return F.flatten(F.transform(origins(height, tile, most), lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def nearest_tiles_first(tiles: Column, width: Column, height: Column, tile: int) -> Column:
    d = lambda t: F.pow(t["x"] + tile / 2 - width / 2, F.lit(2)) + F.pow(t["y"] + tile / 2 - height / 2, F.lit(2))
    keyed = F.transform(tiles, lambda t, i: F.struct(d(t).alias("d"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda k: k["t"])


def stop_at(tiles: Column, stop: float = VETO_BELOW) -> Column:
    """Struct (native_max, native_median): the first tile that reaches ``stop``, or the greatest and the upper middle of all."""
    first = F.get(F.filter(tiles, lambda p: p >= stop), 0)
    up = F.sort_array(tiles)
    return F.struct(F.coalesce(first, F.array_max(tiles)).alias("native_max"), F.when(first.isNull(), F.get(up, F.floor(F.size(up) / 2).cast("int"))).alias("native_median"))


def crop_plan(width: Column, height: Column, edge: int = 440, crop: int = 384) -> Column:
    """Struct of the resized size (short edge ``edge``, the other floored) and the centre crop's corner."""
    w = F.when(width <= height, F.lit(edge)).otherwise(F.greatest(F.lit(edge), F.floor(width * edge / height)))
    h = F.when(width <= height, F.greatest(F.lit(edge), F.floor(height * edge / width))).otherwise(F.lit(edge))
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"), F.floor((w - crop) / 2).cast("int").alias("x"), F.floor((h - crop) / 2).cast("int").alias("y"))


def valid_curves(knots: DataFrame) -> DataFrame:
    """``(curve, valid)`` of ``knots(curve, i, x, y)``: two or more, finite, x strictly up and y never down in the order of ``i``."""
    step = Window.partitionBy("curve").orderBy("i")
    up = F.coalesce((F.col("x") > F.lag("x").over(step)) & (F.col("y") >= F.lag("y").over(step)), F.lit(True))
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan(F.col("x").cast("double")) & ~F.isnan(F.col("y").cast("double"))
    return knots.select("curve", (up & known).alias("ok")).groupBy("curve").agg((F.bool_and("ok") & (F.count("*") >= 2)).alias("valid"))
