"""Score-like inputs derived from the tables at hand, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.keyed import uniform, uniform_sql

THRESHOLD = 0.65


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scored images: priority is the label, the customer the source, the segment the generator."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    key = F.col("o_orderkey").cast("string")
    label = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = joined.select(
        key.alias("image_id"), label.alias("label"), F.col("c_mktsegment").alias("generator"), F.col("o_orderstatus").alias("degradation"), F.col("o_custkey").cast("string").alias("source_key"), F.substring(F.md5(key), 1, 16).alias("phash"),
        (0.35 * label + 0.65 * uniform(F.concat(F.lit("s|"), key))).alias("score"), uniform(F.concat(F.lit("b|"), key)).alias("noise"),
    )
    rows = rows.withColumn("cluster_id", F.concat_ws(":", "source_key", "label")).withColumn("score_b", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") + 0.2 * (F.col("noise") - 0.5))))
    part = uniform(F.concat(F.lit("g|"), F.col("cluster_id")))
    return rows.withColumn("split", F.when(part < 0.6, "fit").when(part < 0.8, "calibration").otherwise("eval"))


_KEY = "o_orderkey::VARCHAR"
#: ``score_rows`` as a common table expression.
SCORE_ROWS = f"""
score_rows_0 AS (
  SELECT {_KEY} AS image_id, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS label, c_mktsegment AS generator, o_orderstatus AS degradation,
         o_custkey::VARCHAR AS source_key, substr(md5({_KEY}), 1, 16) AS phash, {uniform_sql(f"'s|' || {_KEY}")} AS us, {uniform_sql(f"'b|' || {_KEY}")} AS noise
  FROM orders JOIN customer ON o_custkey = c_custkey),
score_rows_1 AS (SELECT *, 0.35::DOUBLE * label + 0.65::DOUBLE * us AS score, source_key || ':' || label AS cluster_id FROM score_rows_0),
score_rows_2 AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, score + 0.2::DOUBLE * (noise - 0.5::DOUBLE))) AS score_b, {uniform_sql("'g|' || cluster_id")} AS part FROM score_rows_1),
score_rows AS (SELECT *, CASE WHEN part < 0.6 THEN 'fit' WHEN part < 0.8 THEN 'calibration' ELSE 'eval' END AS split FROM score_rows_2)
"""


def doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as corpus records: source is the group, the text's hash stands for a perceptual hash."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("source").alias("grp"), F.col("lang"), F.md5("text").alias("digest"))


DOC_ROWS = "doc_rows AS (SELECT doc_id, source AS grp, lang, md5(text) AS digest FROM documents)"


def scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scan requests of pages."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("page"), F.concat_ws("/", F.lit("https://img.example"), "event_type", (F.col("event_id") % 97).cast("string")).alias("url"), F.col("value").alias("priority"), F.col("event_type").alias("phase"), F.col("ts").cast("timestamp").alias("ts"))


SCAN_ROWS = "scan_rows AS (SELECT event_id AS seq, user_id::VARCHAR AS page, 'https://img.example/' || event_type || '/' || (event_id % 97)::VARCHAR AS url, value AS priority, event_type AS phase, ts FROM events)"
