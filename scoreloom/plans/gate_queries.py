"""End-to-end plans: the gated evaluation, the null shootout, and tables that go through files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators import integrity as I
from scoreloom.operators import metrics as M
from scoreloom.operators.evidence import list_hash
from scoreloom.operators.staging import shared_dir
from scoreloom.plans.fixtures import SCORE_ROWS, THRESHOLD, score_rows, table
from scoreloom.plans.metric_queries import _ORACLE, _interval_sql, _sweep_sql
from scoreloom.registry import query
from scoreloom.sources import files

S = SCORE_ROWS


_EVAL = "(SELECT * FROM h WHERE split = 'eval')"


@query(f"""WITH i AS ({_interval_sql(_EVAL, "20260814", _EVAL)}), n AS (WITH {S} SELECT count(*) FILTER (WHERE label = 1) AS ai, count(*) FILTER (WHERE label = 0) AS re FROM score_rows WHERE split = 'eval'),
o AS (SELECT unnest(['n_ai', 'n_real', 'n_ai_clusters', 'n_real_clusters', 'balanced_accuracy', 'ci_lower']) AS gate, unnest([ai::DOUBLE, re::DOUBLE, n_ai_clusters::DOUBLE, n_real_clusters::DOUBLE, value, ci_lower]) AS observed, unnest([100, 100, 100, 100, 0.7, 0.7]::DOUBLE[]) AS least FROM i, n WHERE metric = 'balanced_accuracy')
SELECT *, observed >= least AS passed FROM o""")
def gated_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Validate, select, measure with intervals, and gate: one row for each gate."""
    rows = score_rows(spark, sf)
    chosen = rows.join(I.row_violations(rows).select(F.col("key").alias("image_id")).distinct(), "image_id", "left_anti").where("split = 'eval'")
    measured = M.clustered_interval(chosen, THRESHOLD, 200).where("metric = 'balanced_accuracy'")
    counts = M.point_metrics(chosen, THRESHOLD).select("n_ai", "n_real")
    seen = measured.select(F.col("value").alias("balanced_accuracy"), F.col("ci_lower").alias("ci_lower"), "n_ai_clusters", "n_real_clusters").crossJoin(F.broadcast(counts))
    return I.gate_table(seen, {"n_ai": 100, "n_real": 100, "n_ai_clusters": 100, "n_real_clusters": 100, "balanced_accuracy": 0.7, "ci_lower": 0.7})


_NULLS = ("score_b", "noise")


@query(f"""WITH {S}, z AS ({" UNION ALL ".join(f"SELECT '{c}' AS probe, split, label, {c} AS v FROM score_rows UNION ALL SELECT '-{c}', split, label, -{c} FROM score_rows" for c in _NULLS)}), f AS (SELECT * FROM z WHERE split = 'fit'),
{_sweep_sql("f", "probe", "v")}, b AS (SELECT key, min_by(s, (-ba, s)) AS threshold, max(ba) AS ba FROM w GROUP BY key),
c AS (SELECT ltrim(key, '-') AS probe, max_by(key, (ba, NOT starts_with(key, '-'))) AS key, max_by(threshold, (ba, NOT starts_with(key, '-'))) AS threshold, max(ba) AS fit_ba FROM b GROUP BY 1)
SELECT c.probe, CASE WHEN starts_with(c.key, '-') THEN -1 ELSE 1 END AS polarity, c.threshold, c.fit_ba, (avg((v >= threshold)::INT) FILTER (WHERE label = 1) + avg((v < threshold)::INT) FILTER (WHERE label = 0)) / 2 AS fair_ba FROM c JOIN z ON z.probe = c.key AND z.split = 'eval' GROUP BY ALL""")
def null_shootout(spark: SparkSession, sf: str) -> DataFrame:
    """Each probe's two-sided threshold fitted on one split and judged on another."""
    rows = score_rows(spark, sf)
    long = rows.select("split", "label", F.inline(F.array(*(F.struct(F.lit(c).alias("probe"), F.col(c).alias("v")) for c in _NULLS))))
    stump = M.two_sided_stump(long.where("split = 'fit'"), "v", ["probe"])
    judged = long.where("split = 'eval'").join(F.broadcast(stump), "probe")
    over = F.col("polarity") * F.col("v") >= F.col("threshold")
    side = lambda k, good: F.avg(F.when(F.col("label") == k, good.cast("int")))
    return judged.groupBy("probe", "polarity", "threshold", F.col("balanced_accuracy").alias("fit_ba")).agg(((side(1, over) + side(0, ~over)) / 2).alias("fair_ba"))


@query(f"WITH {S}, {_ORACLE.format(t='o', key='split', rows='score_rows')} SELECT arg_max(split, (oracle_ba, split)) AS best_split, max(oracle_ba) AS oracle_ba FROM o")
def best_null(spark: SparkSession, sf: str) -> DataFrame:
    by = M.oracle_balanced_accuracy(score_rows(spark, sf), keys=["split"])
    return by.agg(F.max_by("split", F.struct("oracle_ba", "split")).alias("best_split"), F.max("oracle_ba").alias("oracle_ba"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {S} SELECT split, count(*) AS n, sum(label)::BIGINT AS n_ai, md5(string_agg(printf('%.10f', score), ',' ORDER BY image_id)) AS scores_md5 FROM score_rows GROUP BY split")
def score_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Scores written as fixed text and read back strictly."""
    path = _folder(spark, "scores")
    files.write_score_csv(score_rows(spark, sf).withColumn("path", F.col("image_id")), path, ["score"])
    back = files.read_score_csv(spark, path)
    counts = back.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("n_ai"))
    return counts.join(list_hash(back, "split", "image_id", "score_text"), "split", "left").select("split", "n", "n_ai", F.col("md5").alias("scores_md5"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS feature FROM documents")
def jsonl_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    docs, paths = table(spark, sf, "documents").select("doc_id"), [_folder(spark, "cache") for _ in range(2)]
    docs.withColumn("feature", F.lit(1.0)).write.json(paths[0])
    docs.where("doc_id % 2 = 0").withColumn("feature", F.lit(2.0)).write.json(paths[1])
    return files.read_cache(spark, paths, "doc_id long, feature double", "doc_id")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'fit' ELSE 'eval' END AS split, doc_id::VARCHAR AS path, source AS grp FROM documents")
def splits_unnest(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a nested splits document as rows; the document is built from the table by split and source."""
    docs = table(spark, sf, "documents").withColumn("split", F.when(F.col("doc_id") % 2 == 0, "fit").otherwise("eval"))
    record = F.struct(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("label"), F.col("source").alias("group"), F.lit("").alias("phash"))
    nested = docs.groupBy("split", "source").agg(F.collect_list(record).alias("r")).select(F.create_map("split", "r").alias("splits"))
    return files.split_records(nested).select("split", "path", F.col("group").alias("grp"))


@query("SELECT 'a' AS origin, count(*) AS n, count(lang) AS n_lang FROM documents UNION ALL SELECT 'b', count(*), 0 FROM pages")
def index_merge(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").select(F.lit("a").alias("origin"), F.col("doc_id").alias("id"), "lang")
    b = table(spark, sf, "pages").select(F.lit("b").alias("origin"), F.col("page_id").alias("id"))
    return files.merge_indexes(a, b).groupBy("origin").agg(F.count("*").alias("n"), F.count("lang").alias("n_lang"))


@query("""WITH RECURSIVE p AS (SELECT event_type || ':' || count(*) || ':' || max(event_id) AS payload, row_number() OVER (ORDER BY event_type) - 1 AS n FROM events GROUP BY event_type),
c AS (SELECT n, payload, '' AS previous_sha256, sha256('|' || payload) AS entry_sha256 FROM p WHERE n = 0 UNION ALL SELECT p.n, p.payload, c.entry_sha256, sha256(c.entry_sha256 || '|' || p.payload) FROM c JOIN p ON p.n = c.n + 1)
SELECT n, payload, previous_sha256, entry_sha256 FROM c""")
def append_log(spark: SparkSession, sf: str) -> DataFrame:
    """A record for each kind of event, appended one after the other to a chained log on files and read back."""
    path = _folder(spark, "log")
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.concat_ws(":", "event_type", F.count("*"), F.max("event_id")).alias("payload"))
    for row in counts.orderBy("event_type").collect():
        files.append_log(spark, path, row.payload)
    return spark.read.json(path, schema="n long, payload string, previous_sha256 string, entry_sha256 string")


@query(f"""WITH {S}, g AS (SELECT generator, count(*) AS n, avg(score) AS mean FROM score_rows GROUP BY generator)
SELECT '## Scores' || chr(10) || chr(10) || '| generator | n | mean |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || generator || ' | ' || n || ' | ' || printf('%.4f', mean) || ' |' || chr(10), '' ORDER BY generator) AS report FROM g""")
def markdown_report(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by generator as a Markdown table."""
    by = score_rows(spark, sf).groupBy("generator").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).orderBy("generator")
    return spark.createDataFrame([(files.markdown(by, "Scores"),)], "report string")
