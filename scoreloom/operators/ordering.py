"""Running totals and dense ranks without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.staging import stage

def running_totals(df: DataFrame, order: str, sums: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``df`` (one row for each key and ``order`` value) with ``<c>_to`` and ``<c>_all`` for each of ``sums``.

    ``<c>_to`` is the total up to and with the row in ascending order. Rows
    are dealt by ranges that Spark samples, so partitions are alike in size
    whatever the distribution; the partition is written with the rows. A window
    runs inside each, and the totals of the partitions before it are added. No
    task sees all rows of a key.
    """
    keys = list(keys)
    df = stage(df.repartitionByRange(*keys, order).withColumn("_bucket", F.spark_partition_id()), "ranges")
    per = df.groupBy(*keys, "_bucket").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    per = per.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_{c}").over(below), F.lit(0)).alias(f"_{c}_below") for c in sums), *(F.sum(f"_{c}").over(every).alias(f"{c}_all") for c in sums))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(per, [*keys, "_bucket"])
    out = out.withColumns({f"{c}_to": F.sum(c).over(inside) + F.col(f"_{c}_below") for c in sums})
    return out.drop("_bucket", *(f"_{c}_below" for c in sums))


def dense_index(df: DataFrame, key: str, groups: Sequence[str], name: str = "idx") -> DataFrame:
    """``df`` with 0, 1, 2, ... by group in the order of (MD5 of key, key), and the group's size in ``<name>_n``.

    Ranks inside one of 4,096 hash buckets plus the sizes of lower buckets.
    """
    groups = list(groups)
    df = df.withColumn("_hash", F.md5(F.col(key).cast("string"))).withColumn("_bucket", F.substring("_hash", 1, 3))
    per = df.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    below = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"), F.sum("_n").over(Window.partitionBy(*groups)).alias(f"{name}_n"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_hash", key)
    return df.join(per, [*groups, "_bucket"]).withColumn(name, F.row_number().over(inside) - 1 + F.col("_below")).drop("_hash", "_bucket", "_below")


def finite(c: Column) -> Column:
    """True for numbers other than null, NaN and the infinities."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
