"""Streams run to their end over the events; results equal the batch twins'."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.plans.fixtures import SCAN_ROWS, scan_rows
from scoreloom.registry import query
from scoreloom.operators.staging import shared_dir
from scoreloom.streaming import jobs as J
from scoreloom.streaming import scans as W


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    e = W.read_files(spark, sf, "events.parquet", W.EVENTS)
    url = F.concat_ws("/", F.lit("https://img.example"), "event_type", (F.col("event_id") % 97).cast("string"))
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("page"), url.alias("url"), F.col("value").alias("priority"), F.col("event_type").alias("phase"), "ts")


@query(f"WITH {SCAN_ROWS} SELECT url, min(seq) AS leader, max(priority) AS priority, count(*) - 1 AS waiters FROM scan_rows GROUP BY url")
def single_flight_stream(spark: SparkSession, sf: str) -> DataFrame:
    return W.finish(W.single_flight(_requests(spark, sf)), "single-flight", "complete")


@query(f"WITH {SCAN_ROWS} SELECT page, count(*) AS n FROM scan_rows GROUP BY page")
def running_scan_count(spark: SparkSession, sf: str) -> DataFrame:
    return W.finish(W.scan_counter(_requests(spark, sf)), "counter").groupBy("page").agg(F.max("n").alias("n"))


@query(f"WITH {SCAN_ROWS} SELECT page, url, seq FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY seq DESC) AS r FROM (SELECT page, url, max(seq) AS seq FROM scan_rows GROUP BY ALL)) WHERE r <= 3")
def lru_memo(spark: SparkSession, sf: str) -> DataFrame:
    return W.finish(W.lru_memo(_requests(spark, sf), 3), "memo", latest=["page"])


@query(f"WITH {SCAN_ROWS} SELECT epoch_us(time_bucket(INTERVAL 10 MINUTES, ts)) // 1000000 AS start, phase, count(*) AS n, avg(priority) AS priority FROM scan_rows GROUP BY ALL")
def windowed_counts_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = W.finish(W.page_counts(_requests(spark, sf)), "windows", "complete")
    return out.select(F.col("window.start").cast("long").alias("start"), "phase", "n", "priority")


@query(f"WITH {SCAN_ROWS}, d AS (SELECT page, url FROM scan_rows GROUP BY ALL) SELECT page, count(*) AS n FROM d GROUP BY page")
def resumable_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Each (page, url) is worked on once, however often it is asked for or the job restarts."""
    work = _requests(spark, sf).select("page", "url")
    return W.finish(work, "resume", "append", ["page", "url"]).groupBy("page").agg(F.count("*").alias("n"))


@query(f"""WITH {SCAN_ROWS}, s AS (SELECT page, seq, CASE WHEN phase <> 'purchase' THEN 'ready' WHEN max((phase <> 'purchase')::INT) OVER (PARTITION BY page ORDER BY seq) = 1 THEN 'lost' ELSE 'missing' END AS state FROM scan_rows),
c AS (SELECT *, lag(state, 1, 'unknown') OVER (PARTITION BY page ORDER BY seq) AS earlier FROM s) SELECT page, arg_max(state, seq) AS state, count(*) FILTER (WHERE state <> earlier) AS changes FROM c GROUP BY page""")
def availability_latch(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose engine is away at purchases."""
    reports = _requests(spark, sf).select("page", "seq", (F.col("phase") != "purchase").alias("available"))
    return W.finish(W.availability(reports), "latch", latest=["page"])


@query()
def admission_simulation(spark: SparkSession, sf: str) -> DataFrame:
    requests = scan_rows(spark, sf).select("page", "seq", "url", "priority", (F.unix_micros("ts") % 3_600_000_000 / 1e6).alias("at"))
    return W.simulate_admission(requests)


@query()
def parked_promotions(spark: SparkSession, sf: str) -> DataFrame:
    """Every third message is a request; the others promote the same few ids."""
    kind = F.when(F.col("seq") % 3 == 0, "request").otherwise("promote")
    messages = _requests(spark, sf).select("page", "seq", kind.alias("kind"), (F.col("seq") % 7).cast("string").alias("id"), "priority")
    return W.finish(W.parked_promotions(messages, 3), "parked", "append")


@query(f"WITH {SCAN_ROWS}, w AS (SELECT page, url, max(seq) AS seq FROM scan_rows WHERE seq % 5 > 0 GROUP BY ALL) SELECT page, url, seq FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY seq DESC) AS r FROM w) WHERE r <= 4")
def session_memo(spark: SparkSession, sf: str) -> DataFrame:
    """What pages' memos hold in the end: the newest web URLs; every fifth write is of a data URL."""
    url = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("data:,"), "url")).otherwise(F.col("url"))
    with J.keyed_state(spark):
        held = J.finish_idle(J.session_memo(_requests(spark, sf).select("page", url.alias("url"), "seq"), 4), "session-memo")
    newest = Window.partitionBy("page")
    return held.withColumn("last", F.max("version").over(newest)).where("version = last").select("page", "url", "seq")


_LIMIT_MS = 4 * 3_600_000


@query(f"""WITH {SCAN_ROWS}, a AS (SELECT page, seq, epoch_us(ts) // 1000 AS asked FROM scan_rows), n AS (SELECT *, lead(asked) OVER (PARTITION BY page ORDER BY asked, seq) AS later, max(asked) OVER () AS watermark FROM a)
SELECT page, seq, CASE WHEN later - asked <= {_LIMIT_MS} THEN 'done' ELSE 'timeout' END AS outcome, least(later, asked + {_LIMIT_MS}) AS ended FROM n WHERE later IS NOT NULL OR asked + {_LIMIT_MS} <= watermark""")
def deadline_stream(spark: SparkSession, sf: str) -> DataFrame:
    """How each request ends: by the page's next one, or by a timer without any."""
    requests = _requests(spark, sf).select("page", "seq", F.unix_millis("ts").alias("at"), "ts")
    with J.keyed_state(spark):
        return W.finish(J.with_deadlines(requests, _LIMIT_MS), "deadlines", "append")


_BOARD = "CASE phase WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'leave' ELSE 'join' END"


@query(f"""WITH RECURSIVE {SCAN_ROWS}, m AS (SELECT seq % 97 AS url, seq, (seq // 97 % 3)::VARCHAR AS waiter, priority, {_BOARD} AS kind, row_number() OVER (PARTITION BY seq % 97 ORDER BY seq) AS r FROM scan_rows),
s AS (SELECT url, 0::BIGINT AS r, []::VARCHAR[] AS waiting, 0::BIGINT AS job, 0::BIGINT AS leader, 0::BIGINT AS joined, 0::DOUBLE AS priority, NULL::VARCHAR AS outcome, 0::BIGINT AS ended FROM (SELECT DISTINCT url FROM m)
UNION ALL SELECT s.url, m.r, CASE kind WHEN 'join' THEN CASE WHEN list_contains(waiting, waiter) THEN waiting ELSE list_append(waiting, waiter) END WHEN 'leave' THEN list_filter(waiting, lambda w: w <> waiter) ELSE [] END,
CASE WHEN kind = 'join' AND len(waiting) = 0 THEN job + 1 ELSE job END, CASE WHEN kind = 'join' AND len(waiting) = 0 THEN m.seq ELSE leader END,
CASE WHEN kind <> 'join' THEN joined WHEN len(waiting) = 0 THEN 1 ELSE joined + (NOT list_contains(waiting, waiter))::INT END, CASE WHEN kind <> 'join' THEN s.priority WHEN len(waiting) = 0 THEN m.priority ELSE greatest(s.priority, m.priority) END,
CASE WHEN kind = 'finish' AND len(waiting) > 0 THEN 'finished' WHEN kind = 'leave' AND waiting = [waiter] THEN 'cancelled' END, m.seq FROM s JOIN m ON m.url = s.url AND m.r = s.r + 1)
SELECT url::VARCHAR AS url, job, leader, joined, priority, outcome, ended FROM s WHERE outcome IS NOT NULL""")
def job_board(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs that several wait for, leave and finish; errors leave, purchases finish."""
    kind = F.when(F.col("phase") == "purchase", "finish").when(F.col("phase") == "error", "leave").otherwise("join")
    messages = _requests(spark, sf).select((F.col("seq") % 97).cast("string").alias("url"), "seq", kind.alias("kind"), (F.floor(F.col("seq") / 97) % 3).cast("string").alias("waiter"), "priority")
    with J.keyed_state(spark):
        return W.finish(J.job_board(messages), "board", "append")


@query(f"WITH {SCAN_ROWS} SELECT page, count(DISTINCT url) AS n FROM scan_rows GROUP BY page")
def time_boxed_run(spark: SparkSession, sf: str) -> DataFrame:
    """Work that stops at its budget after a batch, and goes on from there until all is done: as one run."""
    home = f"{shared_dir(spark)}/boxed-{uuid.uuid4().hex}"
    scan_rows(spark, sf).select("page", "url").repartition(3, "page").write.parquet(f"{home}/in")
    work = spark.readStream.schema("page string, url string").option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    while not J.run_for(work, W.append_new(f"{home}/out", ["page", "url"]), f"{home}/state", 0.0):
        pass
    return spark.read.parquet(f"{home}/out").groupBy("page").agg(F.count("*").alias("n"))
