"""Validation as frames of violations, isolation checks and release gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.dedupe import hamming_pairs, hash_bits
from scoreloom.operators.ordering import finite
from scoreloom.operators.staging import stage


def row_rules(score: str = "score") -> dict[str, Column]:
    """Conditions under which a score row is invalid, by rule."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    in_range = finite(F.col(score)) & (F.col(score) >= 0) & (F.col(score) <= 1)
    return {
        "label": ~F.coalesce(F.col("label").isin(0, 1), F.lit(False)),
        "score": ~in_range,
        "blank_image_id": blank("image_id"),
        "blank_cluster": blank("cluster_id"),
        "blank_generator": blank("generator"),
        "split": ~F.coalesce(F.col("split").isin("fit", "calibration", "eval"), F.lit(False)),
        "phash": ~F.coalesce(F.col("phash").rlike("^[0-9a-fA-F]{1,16}$"), F.lit(False)),
    }


def row_violations(rows: DataFrame, score: str = "score") -> DataFrame:
    """``(rule, key)`` for each rule that each row breaks: one scan, no shuffle."""
    broken = F.filter(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in row_rules(score).items())), lambda x: x.isNotNull())
    return rows.select(F.explode(broken).alias("rule"), F.col("image_id").alias("key"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def split_violations(rows: DataFrame, distance: int | None = 4, seen_generators: bool = False, more: str | None = None) -> DataFrame:
    """``(rule, key)`` for repeated ids, generators or clusters in several splits, clusters of both labels, and near duplicates across clusters.

    Two hashes within the distance give one pair of rows in different clusters,
    if there is one among all rows that have them: the first rows of two
    clusters stand for each hash. ``more`` is a column of 16 further hex digits,
    with which hashes are of 128 bits (see :func:`hamming_pairs`).
    """
    many = lambda key, value, rule: rows.groupBy(F.col(key).alias("key")).agg(F.countDistinct(value).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "key")
    parts = [duplicate_keys(rows, "image_id").select(F.lit("duplicate_id").alias("rule"), F.col("image_id").alias("key")), many("cluster_id", "split", "cluster_crosses"), many("cluster_id", "label", "cluster_conflict")]
    if not seen_generators:
        parts.append(many("generator", "split", "generator_crosses"))
    if distance is not None:
        words = {"bits": "phash"} | ({"more": more} if more else {})
        bits = rows.select(F.col("image_id").alias("id"), *(hash_bits(F.col(c)).alias(w) for w, c in words.items()), "cluster_id").dropna(subset=list(words))
        held = bits.groupBy(*words, "cluster_id").agg(F.min("id").alias("id"))
        two = held.withColumn("r", F.row_number().over(Window.partitionBy(*words).orderBy("id"))).where("r <= 2")
        two = stage(two.groupBy(*words).agg(F.array_sort(F.collect_list(F.struct("id", "cluster_id"))).alias("held")), "hashes")
        pairs = hamming_pairs(two.select(F.get("held", 0)["id"].alias("id"), *words), distance, "more" if more else None)
        own = two.select(F.get("held", 0)["id"].alias("id"), "held")
        both = pairs.join(own.withColumnsRenamed({"id": "a", "held": "ha"}), "a").join(own.withColumnsRenamed({"id": "b", "held": "hb"}), "b")
        crossing = F.get(F.filter(F.flatten(F.transform("ha", lambda x: F.transform("hb", lambda y: F.struct(x.alias("x"), y.alias("y"))))), lambda p: p["x"]["cluster_id"] != p["y"]["cluster_id"]), 0)
        near = both.withColumn("p", crossing).where("p is not null").select(F.least("p.x.id", "p.y.id").alias("a"), F.greatest("p.x.id", "p.y.id").alias("b"))
        same = two.where(F.size("held") > 1).select(F.get("held", 0)["id"].alias("key"))
        parts += [near.select(F.lit("near_duplicate").alias("rule"), F.concat_ws("/", "a", "b").alias("key")), same.select(F.lit("same_hash").alias("rule"), "key")]
    return reduce(DataFrame.unionByName, parts)


def isolation(rows: DataFrame, left: Column, right: Column, keys: list[str]) -> DataFrame:
    """How many values of each key two selections share; all must be 0 for them to be independent."""
    parts = []
    for key in keys:
        both = rows.groupBy(F.col(key).cast("string").alias("value")).agg(F.max(left.cast("int")).alias("l"), F.max(right.cast("int")).alias("r"))
        parts.append(both.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("shared")).select(F.lit(key).alias("key"), "shared", (F.col("shared") == 0).alias("passed")))
    return reduce(DataFrame.unionByName, parts)


def coverage(selected: DataFrame, audited: DataFrame, key: str) -> DataFrame:
    """How much of the selected keys the audit covers."""
    mark = audited.select(key).distinct().withColumn("seen", F.lit(1))
    return selected.select(key).distinct().join(mark, key, "left").agg(F.count("*").alias("n"), F.count("seen").alias("n_covered"), (F.count("seen") / F.count("*")).alias("coverage"))


def gate_table(observed: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``(gate, observed, least, passed)`` from one row of observed values."""
    one = lambda k, v: F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("observed"), F.lit(float(v)).alias("least"), F.coalesce(F.col(k) >= v, F.lit(False)).alias("passed"))
    return observed.select(F.inline(F.array(*(one(k, v) for k, v in limits.items()))))


def single_value(rows: DataFrame, column: str, expected: str | None = None) -> DataFrame:
    """Whether all rows are bound to one value (the expected one)."""
    out = rows.agg(F.countDistinct(column).alias("n_values"), F.count_if(F.col(column).isNull()).alias("n_null"), F.min(column).alias("value"))
    good = (F.col("n_values") == 1) & (F.col("n_null") == 0)
    return out.withColumn("passed", good if expected is None else good & (F.col("value") == expected))
