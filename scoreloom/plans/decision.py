"""The decision chain from raw signals to a displayed verdict, stage by stage."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import scalars as C

Curve = tuple[Sequence[float], Sequence[float]]


def fuse(rows: DataFrame, signals: dict[str, tuple[Column, float, Curve]], curve: Curve, prior: float = 0.5) -> DataFrame:
    """``rows`` with ``probability``, ``is_ai`` and ``bits_<signal>`` of weighted log-odds of calibrated signals.

    A null signal did not fire and adds nothing. Each stage is a column of its
    own, so an input that many knots compare is computed once.
    """
    rows = rows.withColumns({f"_raw_{k}": raw for k, (raw, _, _) in signals.items()})
    rows = rows.withColumns({f"_cal_{k}": C.apply_curve(F.col(f"_raw_{k}"), *knots) for k, (_, _, knots) in signals.items()})
    rows = rows.withColumns({f"_term_{k}": F.when(F.col(f"_raw_{k}").isNotNull(), F.lit(w) * C.logit(F.col(f"_cal_{k}"))) for k, (_, w, _) in signals.items()})
    total = F.lit(math.log(prior / (1 - prior)))
    for k in signals:
        total = total + F.coalesce(F.col(f"_term_{k}"), F.lit(0.0))
    rows = rows.withColumn("_total", F.least(F.greatest(total, F.lit(-C.MOST_LOG_ODDS)), F.lit(C.MOST_LOG_ODDS)))
    rows = rows.withColumn("_squashed", C.sigmoid(F.col("_total")))
    rows = rows.withColumn("_curved", C.apply_curve(F.col("_squashed"), *curve)).withColumn("probability", C.clamp(F.col("_curved")))
    rows = rows.withColumns({"is_ai": F.col("probability") >= C.THRESHOLD} | {f"bits_{k}": F.col(f"_term_{k}") / math.log(2) for k in signals})
    return rows.drop("_total", "_squashed", "_curved", *(f"_{s}_{k}" for k in signals for s in ("raw", "cal", "term")))


def decide(rows: DataFrame, gated: Column, native_max: Column, native_median: Column, curve: Curve) -> DataFrame:
    """Cap, veto, decide and display ``rows(probability)``, in this order; adds ``gated``, ``vetoed`` and ``display``."""
    rows = rows.withColumn("gated", gated).withColumn("_capped", C.graphic_cap(F.col("probability"), F.col("gated")))
    rows = rows.withColumn("probability", C.native_veto(F.col("_capped"), native_max, native_median, curve))
    rows = rows.withColumns({"vetoed": F.col("probability") < F.col("_capped"), "is_ai": F.col("probability") >= C.THRESHOLD})
    return rows.withColumn("display", C.display_percent(F.col("probability"), F.col("is_ai"), curve)).drop("_capped")
