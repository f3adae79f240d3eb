"""Keyed stream processors with timers, expiring state and cancellation, and runs that stop at a budget."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from scoreloom.operators.staging import shared_dir
from scoreloom.streaming.scans import KEPT

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The store that map states, timers and expiry need, for queries that start inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _rows(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")


def finish_idle(stream: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Run a stream of processing-time state over all that is there now, and return the rows of its triggers.

    Such a query has a trigger without rows after the last one with some, and
    goes on with those for ever: state may expire at any time. It is stopped at
    the first of them.
    """
    home = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("append").parquet(f"{home}/out")).option("checkpointLocation", f"{home}/state").start()
    while not query.awaitTermination(1):
        if query.lastProgress is not None and query.lastProgress.numInputRows == 0:
            query.stop()
            break
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{home}/out")


class _Memo(StatefulProcessor):
    """URL to the place of its last write, forgotten after ``ttl_ms`` or when ``capacity`` newer ones are held."""

    SCHEMA = "page string, version long, url string, seq long"

    def __init__(self, capacity: int, ttl_ms: int) -> None:
        self.capacity, self.ttl_ms = capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "url string", "seq long", self.ttl_ms)
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = {r.url: int(r.seq) for r in _rows(rows, ["seq"]).itertuples(index=False)}
        held = {k[0]: v[0] for k, v in self.held.iterator()}
        kept = dict(sorted((held | last).items(), key=lambda x: -x[1])[: self.capacity])
        for url in held.keys() - kept.keys():
            self.held.removeKey((url,))
        for url in kept.keys() & last.keys():
            self.held.updateValue((url,), (kept[url],))
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        yield pd.DataFrame({"page": key[0], "version": version, "url": list(kept), "seq": list(kept.values())})

    def close(self) -> None:
        pass


def session_memo(writes: DataFrame, capacity: int = KEPT, ttl_ms: int = 24 * 3_600_000) -> DataFrame:
    """What each page's memo holds after every trigger that wrote to it: ``(page, version, url, seq)``.

    Of ``writes(page, url, seq)`` those of http and https URLs are kept, the
    ``capacity`` newest by their last write and none longer than ``ttl_ms`` after
    it; reads do not count. The highest version of a page is what holds now.
    """
    web = writes.where("url like 'http:%' or url like 'https:%'").select("page", "url", "seq")
    return web.groupBy("page").transformWithStateInPandas(_Memo(capacity, ttl_ms), _Memo.SCHEMA, "update", "ProcessingTime")


class _First(StatefulProcessor):
    """Whether a key was asked for, until a timer forgets it."""

    SCHEMA = "url string, seq long, at long"

    def __init__(self, horizon_ms: int) -> None:
        self.horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, last = [], self.last.get()[0] if self.last.exists() else None
        for r in _rows(rows, ["at", "seq"]).itertuples(index=False):
            if last is None or r.at - last > self.horizon_ms:
                out.append((key[0], int(r.seq), int(r.at)))
                last = int(r.at)
        if out:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.last.update((last,))
            self.handle.registerTimer(last + self.horizon_ms)
        yield pd.DataFrame(out, columns=["url", "seq", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([], columns=["url", "seq", "at"])

    def close(self) -> None:
        pass


def first_requests(requests: DataFrame, horizon_ms: int, late: str = "0 seconds") -> DataFrame:
    """``(url, seq, at)``: of ``requests(url, seq, at, ts)`` those whose URL had no such request in the ``horizon_ms`` before.

    In the order of ``at`` (milliseconds of ``ts``), then ``seq``: the first one
    goes out and the others of the horizon wait for it. What is behind the
    watermark is forgotten by a timer.
    """
    timed = requests.withWatermark("ts", late)
    return timed.groupBy("url").transformWithStateInPandas(_First(horizon_ms), _First.SCHEMA, "append", "EventTime")


class _Deadline(StatefulProcessor):
    """The requests that a bucket's pages wait for, and a timer at the first of their deadlines."""

    SCHEMA = "page string, seq long, outcome string, ended long"

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "pages array<string>, seqs array<long>, ats array<long>")

    def _held(self) -> pd.DataFrame:
        pages, seqs, ats = self.open.get() if self.open.exists() else ([], [], [])
        return pd.DataFrame({"page": np.array(pages, object), "seq": np.array(seqs, "int64"), "at": np.array(ats, "int64")})

    def _hold(self, rows: pd.DataFrame) -> None:
        if rows.empty:
            self.open.clear()
        else:
            self.open.update((rows["page"].tolist(), rows["seq"].tolist(), rows["at"].tolist()))
            self.handle.registerTimer(int(rows["at"].min()) + self.limit_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        if not held.empty:
            self.handle.deleteTimer(int(held["at"].min()) + self.limit_ms)
        new = pd.concat([f[["page", "seq", "at"]] for f in rows]).astype({"seq": "int64", "at": "int64"})
        both = pd.concat([held, new], ignore_index=True)
        page, at = pd.factorize(both["page"], use_na_sentinel=False)[0], both["at"].to_numpy()
        order = np.lexsort((both["seq"].to_numpy(), at, np.arange(len(both)) >= len(held), page))  # what a page waits for comes first
        both, page, at = both.iloc[order], page[order], at[order]
        ends = page[1:] == page[:-1]
        late = at[1:][ends] - at[:-1][ends] > self.limit_ms
        out = both[:-1][ends]
        self._hold(both[np.append(~ends, True)])
        yield pd.DataFrame({"page": out["page"].to_numpy(), "seq": out["seq"].to_numpy(), "outcome": np.where(late, "timeout", "done"), "ended": np.where(late, at[:-1][ends] + self.limit_ms, at[1:][ends])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        ended = held["at"] + self.limit_ms
        due = ended <= timerValues.getCurrentWatermarkInMs()
        self._hold(held[~due])
        yield pd.DataFrame({"page": held["page"][due], "seq": held["seq"][due], "outcome": "timeout", "ended": ended[due]})

    def close(self) -> None:
        pass


def with_deadlines(requests: DataFrame, limit_ms: int, late: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """How each of ``requests(page, seq, at, ts)`` ends: ``(page, seq, outcome, ended)``, once.

    The page's next request within ``limit_ms`` of ``at`` (milliseconds of
    ``ts``) ends it as done. Otherwise it times out: when a later request tells,
    or by a timer as soon as the watermark passes the deadline, without any
    further input of the page.

    Pages are dealt to ``buckets`` by their hash; a bucket's rows of a trigger are
    worked on at once, and its state is one row for each page that waits.
    """
    timed = requests.withWatermark("ts", late).withColumn("bucket", F.pmod(F.hash("page"), F.lit(buckets)))
    return timed.groupBy("bucket").transformWithStateInPandas(_Deadline(limit_ms), _Deadline.SCHEMA, "append", "EventTime")


class _Board(StatefulProcessor):
    """One open job a key: who waits for it, and at which priority."""

    SCHEMA = "url string, job long, leader long, joined long, priority double, outcome string, ended long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "waiter string", "seq long")
        self.job = handle.getValueState("job", "job long, leader long, joined long, priority double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.waiting.iterator()}
        waiting = dict(before)
        job, leader, joined, priority = self.job.get() if self.job.exists() else (0, 0, 0, 0.0)
        out = []
        for r in _rows(rows, ["seq"]).itertuples(index=False):
            outcome = None
            if r.kind == "join":
                if not waiting:
                    job, leader, joined, priority = job + 1, int(r.seq), 0, float(r.priority)
                joined += r.waiter not in waiting
                waiting.setdefault(r.waiter, int(r.seq))
                priority = max(priority, float(r.priority))
            elif r.kind == "leave" and waiting.pop(r.waiter, None) is not None and not waiting:
                outcome = "cancelled"
            elif r.kind == "finish" and waiting:
                outcome, waiting = "finished", {}
            if outcome:
                out.append((key[0], job, leader, joined, priority, outcome, int(r.seq)))
        for waiter in before.keys() - waiting.keys():
            self.waiting.removeKey((waiter,))
        for waiter, seq in waiting.items():
            if before.get(waiter) != seq:
                self.waiting.updateValue((waiter,), (seq,))
        self.job.update((job, leader, joined, priority))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in self.SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def job_board(messages: DataFrame) -> DataFrame:
    """Jobs that ended, ``(url, job, leader, joined, priority, outcome, ended)``, from ``messages(url, seq, kind, waiter, priority)`` in the order of ``seq``.

    The first to join opens a job and leads it; others wait for the same one and
    raise its priority. Who leaves no longer waits, and when nobody does, the job
    is cancelled; ``finish`` ends it for all. A new join opens the next job.
    Leaving or finishing what one does not wait for does nothing.
    """
    return messages.groupBy("url").transformWithStateInPandas(_Board(), _Board.SCHEMA, "append", "None")


class _Budget(StreamingQueryListener):
    """Sets ``over`` when a batch ends after the budget."""

    def __init__(self, seconds: float, clock: Callable[[], float]) -> None:
        self.seconds, self.clock, self.began, self.over, self.id = seconds, clock, clock(), False, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.id is None or str(event.progress.id) == self.id:
            self.over |= self.clock() - self.began >= self.seconds

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_for(stream: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str, seconds: float, clock: Callable[[], float] = time.monotonic, mode: str = "append") -> bool:
    """Work off what is there now until a batch ends after ``seconds``; true if all of it is done.

    A listener watches the progress of the query, and the query stops after the
    batch that is over the budget; the next call with the same checkpoint goes on
    behind it. A batch that the stop interrupts is worked on again, so ``writer``
    must take the same rows twice (:func:`scoreloom.streaming.scans.append_new`).
    """
    budget, spark = _Budget(seconds, clock), stream.sparkSession
    spark.streams.addListener(budget)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        budget.id = str(query.id)
        while not query.awaitTermination(1) and not budget.over:
            pass
        done = not query.isActive
        query.stop()
    finally:
        spark.streams.removeListener(budget)
    return done
