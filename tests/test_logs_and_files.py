"""Quoted records over block ends, hash chains with faults, keyed streams, the condition table."""

import csv
import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import conditions
from scoreloom.operators import evidence as E
from scoreloom.sources import quoted
from scoreloom.streaming import jobs as J
from scoreloom.streaming import scans as W


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("block", ["64b", "1k", "128m"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_block_ends_equal_the_csv_module(spark, tmp_path, block, end):
    rng = random.Random(4)
    field = lambda: "".join(rng.choice(['"', "\n", ",", "a", "é", " ", "word ", '""', "\n\n"]) for _ in range(rng.randrange(12)))
    rows = [[str(k), f"x{field()}", f"y{field()}"] for k in range(300)] + [["300", "x" + "line\n" * 400, "y"], ["301", "x", "yz"]]
    for name, part in (("a", rows[:120]), ("b", rows[120:])):
        (tmp_path / f"{name}.csv").write_text(written([["id", "x", "y"], *part], end), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        records = quoted.quoted_records(spark, str(tmp_path))
        got = [r.record for r in records.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert sorted(tuple(next(csv.reader(io.StringIO(r)))) for r in got) == sorted(map(tuple, rows))


def test_many_blocks_are_joined_by_shuffle_alike(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("h\n" + "".join(f'"{k}\n{k}"\n' for k in range(200)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(quoted, "LISTED", 0)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
        got = {r.record for r in quoted.quoted_records(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f'"{k}\n{k}"' for k in range(200)}


def test_a_quote_that_is_not_closed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h\n"a\nb\n')
    with pytest.raises(Exception, match="not closed"):
        quoted.quoted_records(spark, str(tmp_path)).collect()


@pytest.fixture(scope="module")
def log(spark):
    return E.chain(spark.range(5000).selectExpr("id", "concat('p', id) as payload"), "id", "payload").repartition(7).cache()


def test_one_long_log_is_checked_by_many_tasks(spark, log):
    assert E.broken_links(log, "id", "payload").count() == 0
    forged = log.withColumn("payload", F.when(F.col("id").isin(0, 77, 4999), "x").otherwise(F.col("payload")))
    assert sorted(r.id for r in E.broken_links(forged, "id", "payload").collect()) == [0, 77, 4999]
    gone = log.where("id not in (10, 11, 2500)")
    assert sorted(r.id for r in E.broken_links(gone, "id", "payload").collect()) == [12, 2501]


def test_changed_segments(spark, log):
    kept = E.segment_roots(log, "id", size=100)
    now = E.segment_roots(log.where("id < 4900").withColumn("entry_sha256", F.when(F.col("id") == 250, "x").otherwise(F.col("entry_sha256"))), "id", size=100)
    assert sorted((r.segment, r.status) for r in E.changed_segments(kept, now).collect()) == [(2, "changed"), (49, "missing")]
    assert kept.agg(F.sum("n")).first()[0] == 5000
    assert spark.createDataFrame([([],), (["a"],)], "h array<string>").select(E.merkle_root(F.col("h")).alias("r")).collect()[0].r == ""


def stream(spark, tmp_path, rows, schema, parts):
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_jobs_over_several_triggers(spark, tmp_path):
    rows = [("u", 1, "join", "a", 1.0), ("u", 2, "join", "b", 5.0), ("u", 3, "leave", "a", 0.0), ("u", 4, "leave", "x", 0.0), ("u", 5, "leave", "b", 0.0), ("u", 6, "finish", "", 0.0), ("u", 7, "join", "c", 2.0), ("u", 8, "join", "c", 9.0), ("u", 9, "finish", "", 0.0), ("v", 10, "join", "d", 1.0)]
    messages = stream(spark, tmp_path, rows, "url string, seq long, kind string, waiter string, priority double", [range(3), range(3, 8), range(8, 10)])
    with J.keyed_state(spark):
        got = sorted(tuple(r) for r in W.finish(J.job_board(messages), "board", "append").collect())
    assert got == [("u", 1, 1, 2, 5.0, "cancelled", 5), ("u", 2, 7, 1, 9.0, "finished", 9)]


def ends_of(rows, limit):
    """Each request's end by the definition, over rows of ``(page, seq, at)``."""
    now, out = max(at for _, _, at in rows), []
    for page in {p for p, _, _ in rows}:
        own = sorted((at, seq) for p, seq, at in rows if p == page)
        for (at, seq), later in zip(own, [x for x, _ in own[1:]] + [None], strict=True):
            if later is not None and later - at <= limit:
                out.append((page, seq, "done", later))
            elif later is not None or at + limit <= now:
                out.append((page, seq, "timeout", at + limit))
    return sorted(out, key=repr)


@pytest.mark.parametrize("buckets", [1, 5])
def test_deadlines_over_several_triggers(spark, tmp_path, buckets):
    rng = random.Random(5)
    rows = [(rng.choice([None, *"abcdefghijkl"]), seq, 1_700_000_000_000 + seq // 2 * 1000 + rng.randrange(2) * 300) for seq in range(300)]
    rows.sort(key=lambda r: (r[2], r[1]))
    requests = stream(spark, tmp_path, rows, "page string, seq long, at long", [range(0, 90), range(90, 91), range(91, 200), range(200, 300)])
    requests = requests.selectExpr("*", "timestamp_millis(at) as ts")
    with J.keyed_state(spark):
        got = W.finish(J.with_deadlines(requests, 9_000, buckets=buckets), "deadlines", "append").collect()
    truth = ends_of(rows, 9_000)
    assert sorted(map(tuple, got), key=repr) == truth and {r[2] for r in truth} == {"done", "timeout"}


class Handle:
    """A processor's handle outside Spark: one value, its timers, and how often either was changed."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.calls = value, self.calls + 1

    def clear(self):
        self.value, self.calls = None, self.calls + 1

    def registerTimer(self, at):
        self.timers.add(at)
        self.calls += 1

    def deleteTimer(self, at):
        self.timers.remove(at)
        self.calls += 1


def test_deadlines_of_many_pages_in_few_calls():
    """The calls to the state do not grow with the pages of a trigger."""
    handle, out, limit = Handle(), [], 500
    rows = [(f"p{k % 400}", k, 1000 + k // 4) for k in range(3000)]
    job = J._Deadline(limit)
    job.init(handle)
    for part in (rows[:1000], rows[1000:]):
        frames = [pd.DataFrame(part[i::3], columns=["page", "seq", "at"]) for i in range(3)]
        out += [tuple(r) for f in job.handleInputRows((7,), iter(frames), None) for r in f.itertuples(index=False)]
    assert handle.calls <= 5 and len(handle.timers) == 1
    assert sorted(out, key=repr) == ends_of(rows, limit) and len(out) == 2600


def test_condition_table(spark):
    conditions.register(spark)
    rows = spark.sql("SELECT c.* FROM VALUES (2000, 1000), (10, 5), (null, 3) AS t(w, h), LATERAL delivery_conditions(w, h, 'width, height') c").collect()
    assert len(rows) == 33 and rows[0].__fields__ == ["condition", "width", "height"]
    assert {tuple(r) for r in rows if r.condition == "cms1024"} == {("cms1024", 1024, 512), ("cms1024", 10, 5), ("cms1024", None, None)}
    with pytest.raises(Exception, match="no such column"):
        spark.sql("SELECT * FROM delivery_conditions(1, 2, 'colour')").collect()
