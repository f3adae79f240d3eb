"""Sources, sinks and functions of the library by themselves, each with its DuckDB statement."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import layout as Y
from scoreloom.functions import texts as X
from scoreloom.functions.keyed import uniform, uniform_sql
from scoreloom.functions.scalars import log10_safe
from scoreloom.operators import evidence as E
from scoreloom.operators import metrics as M
from scoreloom.operators.ordering import finite
from scoreloom.operators.staging import shared_dir
from scoreloom.plans.fixtures import SCAN_ROWS, SCORE_ROWS, scan_rows, score_rows, table
from scoreloom.registry import query
from scoreloom.sources import files
from scoreloom.streaming import jobs as J
from scoreloom.streaming import scans as W

S = SCORE_ROWS


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {S} SELECT 'eval' AS part, image_id, label, round(score, 10) AS score FROM score_rows WHERE split = 'eval' UNION ALL SELECT 'fit', image_id, label, round(score, 10) FROM score_rows WHERE split = 'fit'")
def many_score_files(spark: SparkSession, sf: str) -> DataFrame:
    """Score files of two splits read as one frame; each row tells its file."""
    paths = {s: _folder(spark, f"scores-{s}") for s in ("fit", "eval")}
    for split, path in paths.items():
        files.write_score_csv(score_rows(spark, sf).where(F.col("split") == split).withColumn("path", F.col("image_id")), path, ["score"])
    rows = files.read_many(spark, list(paths.values()))
    return rows.select(F.regexp_extract("source_file", "scores-(fit|eval)", 1).alias("part"), "image_id", "label", "score")


@query(f"""WITH {S}, r AS (SELECT split, count(*) AS n, sum(label)::BIGINT AS n_ai FROM score_rows GROUP BY split) SELECT split, '{{"n":' || n || ',"n_ai":' || n_ai || ',"split":"' || split || '"}}' AS report, sha256('{{"n":' || n || ',"n_ai":' || n_ai || ',"split":"' || split || '"}}') AS content_sha256 FROM r""")
def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """A report of each split written as JSON with sorted keys, read back, and its hash."""
    counts, out = score_rows(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("n_ai")), []
    for split in ("fit", "calibration", "eval"):
        path = _folder(spark, "report")
        files.write_report(counts.where(F.col("split") == split), path)
        out.append(spark.read.text(path).select(F.lit(split).alias("split"), F.col("value").alias("report")))
    back = out[0].union(out[1]).union(out[2])
    expected = counts.select("split", E.content_hash({c: F.col(c) for c in ("split", "n", "n_ai")}).alias("content_sha256"))
    return back.join(expected, "split")


@query("SELECT vec_id, i, v::DOUBLE AS value FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings)")
def npy_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as the bytes of ``.npy`` files, read back."""
    header = "{'descr': '<f8', 'fortran_order': False, 'shape': (64,), }".ljust(117) + "\n"
    head = (b"\x93NUMPY\x01\x00" + len(header).to_bytes(2, "little") + header.encode()).hex()

    def packed(v: Column) -> Column:
        def run(v: pd.Series) -> pd.Series:
            return v.map(lambda x: x.astype("<f8").tobytes())

        return F.pandas_udf(run, "binary")(v)

    content = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.concat(F.unhex(F.lit(head)), packed(F.col("embedding").cast("array<double>"))).alias("content"))
    return files.read_npy(spark, content).select(F.col("path").cast("long").alias("vec_id"), "i", "value")


@query("""SELECT doc_id, ['wait-source', 'skip', 'skip', 'scan'][(doc_id % 4 + 1)::INT] AS class FROM documents""")
def painted_class(spark: SparkSession, sf: str) -> DataFrame:
    """Backgrounds without a source, an SVG, one too small and one to scan."""
    k = F.col("doc_id") % 4
    url = F.get(F.array(F.lit(""), F.lit("https://a/b.svg"), F.lit("https://a/b.png"), F.lit("https://a/b.png")), k.cast("int"))
    side = F.when(k == 2, 47).otherwise(48)
    return table(spark, sf, "documents").select("doc_id", X.painted_class(url, side, F.lit(100), 48).alias("class"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN true ELSE false END AS watched FROM pages")
def watched_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Picture and unwatched tags in turn."""
    return table(spark, sf, "pages").select("page_id", Y.is_watched(F.when(F.col("page_id") % 2 == 0, "IMG").otherwise(X.UNWATCHED[0])).alias("watched"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'unknown-artist' WHEN p_partkey % 3 = 1 THEN substr(repeat('ab', 40), 1, 60) ELSE 'Ann ' || p_partkey END AS name FROM part")
def artist_names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    markup = F.when(k % 3 == 0, "<i> </i>").when(k % 3 == 1, F.repeat(F.lit("ab"), 40)).otherwise(F.concat(F.lit("<a href='x'>Ann</a> "), k.cast("string")))
    return table(spark, sf, "part").select("p_partkey", X.short_name(markup).alias("name"))


@query(f"WITH {S} SELECT image_id || '--' || degradation AS variant, image_id FROM score_rows WHERE split = 'eval'")
def prefix_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Variants whose image, the part before the mark, is held out."""
    rows = score_rows(spark, sf)
    variants = rows.select(F.concat_ws("--", "image_id", "degradation").alias("variant")).withColumn("image_id", X.before_mark(F.col("variant")))
    return variants.join(rows.where("split = 'eval'").select("image_id"), "image_id", "left_semi").select("variant", "image_id")


@query(f"WITH {S} SELECT image_id, CASE WHEN label = 1 THEN 'sha' || image_id WHEN degradation = 'F' THEN source_key ELSE image_id END AS cluster FROM score_rows")
def cluster_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The first of several fields that is not blank."""
    rows = score_rows(spark, sf).drop("cluster_id").withColumn("source_sha256", F.when(F.col("label") == 1, F.concat(F.lit("sha"), "image_id")).otherwise(" "))
    rows = rows.withColumn("source_key", F.when(F.col("degradation") == "F", F.col("source_key")))
    return rows.select("image_id", M.cluster_id(rows).alias("cluster"))


@query("SELECT l_orderkey, l_linenumber, round(log10(greatest(l_extendedprice, 1e-12)), 9) AS log_bytes, round(log10(greatest(l_extendedprice / greatest(1.0, l_quantity * 100), 1e-12)), 9) AS log_density, round(ln(1 + greatest(l_discount * 100 - 5, 0)), 9) AS log_rest FROM lineitem")
def safe_logs(spark: SparkSession, sf: str) -> DataFrame:
    price, area = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double") * 100
    rest = F.log1p(F.greatest(F.col("l_discount").cast("double") * 100 - 5, F.lit(0.0)))
    out = {"log_bytes": log10_safe(price), "log_density": log10_safe(price / F.greatest(F.lit(1.0), area)), "log_rest": rest}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(v, 9).alias(k) for k, v in out.items()))


@query(f"WITH {S} SELECT image_id, score FROM score_rows WHERE image_id::BIGINT % 3 = 0")
def finite_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose value is a number; of the others one in two is missing, one not a number."""
    k = F.col("image_id").cast("long") % 3
    rows = score_rows(spark, sf).withColumn("score", F.when(k == 0, F.col("score")).when(k == 1, F.lit(float("inf"))))
    return rows.where(finite(F.col("score"))).select("image_id", "score")


@query(f"SELECT p_partkey, {uniform_sql("'7:' || p_partkey")} AS u FROM part")
def keyed_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", uniform(F.concat(F.lit("7:"), F.col("p_partkey").cast("string"))).alias("u"))


@query(f"""WITH RECURSIVE {SCAN_ROWS}, a AS (SELECT url, seq, epoch_us(ts) // 1000 AS asked, row_number() OVER (PARTITION BY url ORDER BY epoch_us(ts) // 1000, seq) AS r FROM scan_rows),
s AS (SELECT url, seq, asked, r, asked AS last, true AS first FROM a WHERE r = 1 UNION ALL SELECT a.url, a.seq, a.asked, a.r, CASE WHEN a.asked - last > {24 * 3_600_000} THEN a.asked ELSE last END, a.asked - last > {24 * 3_600_000} FROM s JOIN a ON a.url = s.url AND a.r = s.r + 1)
SELECT url, seq FROM s WHERE first""")
def first_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of a stream whose URL had no such request in the day before: each of these goes out, the others wait for it."""
    e = W.read_files(spark, sf, "events.parquet", W.EVENTS)
    url = F.concat_ws("/", F.lit("https://img.example"), "event_type", (F.col("event_id") % 97).cast("string"))
    requests = e.select(url.alias("url"), F.col("event_id").alias("seq"), F.unix_millis("ts").alias("at"), "ts")
    with J.keyed_state(spark):
        return W.finish(J.first_requests(requests, 24 * 3_600_000), "first", "append").select("url", "seq")


@query(f"WITH {SCAN_ROWS}, d AS (SELECT url, min(seq) AS seq FROM scan_rows GROUP BY url) SELECT r.seq, r.page, r.url, d.seq::DOUBLE AS probability FROM scan_rows r JOIN d USING (url)")
def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """Every waiting request of a stream with the one result of its URL, which comes by another stream."""
    e = W.read_files(spark, sf, "events.parquet", W.EVENTS)
    url = F.concat_ws("/", F.lit("https://img.example"), "event_type", (F.col("event_id") % 97).cast("string"))
    requests = e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("page"), url.alias("url"), "ts")
    folder = _folder(spark, "results")
    results = scan_rows(spark, sf).groupBy("url").agg(F.min("seq").cast("double").alias("probability"), F.min("ts").alias("done"))
    results.write.parquet(folder)
    done = spark.readStream.schema(results.schema).parquet(folder)
    return W.finish(W.fan_out(requests, done, "3650 days"), "fan-out", "append").select("seq", "page", "url", "probability")


@query(f"WITH {SCAN_ROWS}, e AS (SELECT *, seq // 1000 AS epoch, max(seq // 1000) OVER (PARTITION BY page) AS latest FROM scan_rows) SELECT page, seq, epoch FROM e WHERE epoch = latest")
def results_of_latest_epoch(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan_rows(spark, sf).withColumn("epoch", F.floor(F.col("seq") / 1000))
    return W.drop_old_epochs(rows.select("page", "seq", "epoch"), rows.select("page", "epoch")).select("page", "seq", "epoch")
