"""Content hashes, set hashes, hash chains and drift of frozen artifacts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scoreloom.operators.staging import stage


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON text with sorted keys and no spaces; nulls stay, numbers are to be given as text where digits matter."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def content_hash(columns: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def fixed(c: Column, digits: int = 10) -> Column:
    """A number as text with fixed decimals, the form in which scores are hashed.

    The number's exact value is rounded, half to even, as C does. Java rounds its
    shortest text half up, which gives another last digit for some.
    """

    def texts(numbers: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f"%.{digits}f" % x for x in numbers.to_pylist()], pa.string())

    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.format_string(f"%.{digits}f", x)).otherwise(F.arrow_udf(texts, "string")(x))


def set_hash(rows: DataFrame, value: str, keys: tuple[str, ...] = (), digits: int = 2) -> DataFrame:
    """Hash of the sorted distinct values: independent of order and repetition.

    Values are hashed in sorted parts first, one for each beginning of
    ``digits`` hex digits, and the parts' hashes then, so that no task needs all
    values of a large set. Hashes agree only for the same number of digits:
    2 for up to millions of values, 4 for billions.
    """
    part = F.substring(F.md5(value), 1, digits)
    inner = rows.select(*keys, value).distinct().groupBy(*keys, part.alias("part")).agg(F.sha2(F.to_json(F.array_sort(F.collect_set(value))), 256).alias("h"), F.count("*").alias("n"))
    return inner.groupBy(*keys).agg(F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])), 256).alias("set_sha256"), F.sum("n").alias("n"))


def row_digest(rows: DataFrame, columns: list[str], keys: tuple[str, ...] = (), digits: int = 2) -> DataFrame:
    """Order-independent digest of rows: sorted hashes of each row, hashed in parts by ``digits`` as in :func:`set_hash`."""
    hashed = rows.select(*keys, F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in columns))), 256).alias("h"))
    parts = hashed.groupBy(*keys, F.substring("h", 1, digits).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("p"), F.count("*").alias("n"))
    return parts.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "p"))), lambda x: x["p"]), ""), 256).alias("digest"), F.sum("n").alias("n"))


def chain(entries: DataFrame, order: str, payload: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Entries with the previous one's hash and their own, which covers it.

    A log is one sequence by nature: each is dealt to one partition, sorted
    there, and read as a stream with the last hash carried from row to row and
    batch to batch. No log is ever held as a whole. A null payload hashes as the
    empty text.
    """
    rows = entries.select(*keys, F.col(order).cast("long").alias(order), F.col(payload).cast("string").alias(payload))
    rows = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, order, payload)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, before = None, ""
        for batch in batches:
            logs = list(zip(*(c.to_pylist() for c in batch.columns[:width]), strict=True)) if width else [()] * batch.num_rows
            previous, own = [], []
            for key, text in zip(logs, batch.column(width + 1).to_pylist(), strict=True):
                if key != log:
                    log, before = key, ""
                previous.append(before)
                before = hashlib.sha256(f"{before}|{text or ''}".encode()).hexdigest()
                own.append(before)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(previous, pa.string()), pa.array(own, pa.string())], [*batch.schema.names, "previous_sha256", "entry_sha256"])

    schema = StructType([*rows.schema.fields, StructField("previous_sha256", StringType()), StructField("entry_sha256", StringType())])
    return rows.mapInArrow(run, schema)


def list_hash(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``(<key>, md5)``: the MD5 hash of each key's texts, joined by commas in the order of ``order``.

    Such a hash is one sequence by nature: each key's rows are sorted and read as
    a stream, with the hash carried from batch to batch; no list is ever whole.
    """
    rows = rows.select(F.col(key).cast("string").alias(key), order, F.col(value).cast("string").alias(value)).where(F.col(value).isNotNull())
    rows = rows.repartition(key).sortWithinPartitions(key, order, value).select(key, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([hashed.hexdigest()])], [key, "md5"])
        for batch in batches:
            for k, own in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), itemgetter(0)):
                part = ",".join(text for _, text in own).encode()
                if hashed is not None and k == now:
                    hashed.update(b"," + part)
                    continue
                if hashed is not None:
                    yield row()
                now, hashed = k, hashlib.md5(part)
        if hashed is not None:
            yield row()

    return rows.mapInArrow(run, f"`{key}` string, md5 string")


def broken_links(chained: DataFrame, order: str, payload: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Entries that do not match their own hash or the hash before; ``chained`` has one row for each place of a log.

    One long log is checked by many tasks: rows are dealt by ranges of log and
    place and written with the range's number. Inside a range the row before is
    at hand; the first rows of ranges are compared with the last row of their
    log in the ranges before, which are as many rows as there are ranges and
    logs that go over them.
    """
    marked = chained.withColumns({"_own": F.sha2(F.concat(F.col("previous_sha256"), F.lit("|"), F.coalesce(F.col(payload).cast("string"), F.lit(""))), 256)})
    placed = stage(marked.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()), "log")
    inside = Window.partitionBy("_part", *keys).orderBy(order)
    rows = placed.withColumn("_before", F.lag("entry_sha256").over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    last = placed.groupBy(*keys, "_part").agg(F.max_by("entry_sha256", F.col(order)).alias("_last"))
    parts = Window.partitionBy(*keys).orderBy("_part")
    last = last.select(*keys, F.col("_part"), F.coalesce(F.lag("_last").over(parts), F.lit("")).alias("_carried"))
    rows = rows.join(last.withColumn("_first", F.lit(True)), [*keys, "_part", "_first"], "left")
    broken = (F.col("previous_sha256") != F.coalesce("_before", "_carried", F.lit(""))) | (F.col("entry_sha256") != F.col("_own"))
    return rows.where(broken).select(*(F.col(f"`{c}`") for c in chained.columns))


def merkle_root(hashes: Column) -> Column:
    """The root of the tree over an array of hashes: neighbours are hashed together level by level, an odd one goes up as it is; '' for none."""

    def roots(lists: pa.Array) -> pa.Array:
        out = []
        for level in lists.to_pylist():
            level = level or [""]
            while len(level) > 1:
                level = [hashlib.sha256("".join(level[k : k + 2]).encode()).hexdigest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            out.append(level[0])
        return pa.array(out, pa.string())

    return F.arrow_udf(roots, "string")(hashes)


def segment_roots(chained: DataFrame, order: str, keys: tuple[str, ...] = (), size: int = 1024) -> DataFrame:
    """``(<keys>, segment, n, root)``: the Merkle root of each ``size`` places of a log.

    Roots that were kept tell which segments of a log have changed, each on its
    own: :func:`changed_segments`.
    """
    segment = F.floor(F.col(order) / size).cast("long").alias("segment")
    hashes = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("entry_sha256").alias("h")))), lambda x: x["h"])
    by = chained.groupBy(*keys, segment).agg(hashes.alias("h"))
    return by.select(*keys, "segment", F.size("h").cast("long").alias("n"), merkle_root(F.col("h")).alias("root"))


def changed_segments(kept: DataFrame, now: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(<keys>, segment, status)``: segments whose roots differ from the kept ones, or that are missing or new."""
    on = [*keys, "segment"]
    both = kept.select(*on, F.col("root").alias("a")).join(now.select(*on, F.col("root").alias("b")), on, "full")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.col("a") != F.col("b"), "changed")
    return both.select(*on, status.alias("status")).where("status is not null")


def freeze_drift(frozen: DataFrame, now: DataFrame, critical: Column) -> DataFrame:
    """``(path, status, fatal)`` of artifacts that changed, went or are new; frames have ``path`` and ``sha256``."""
    both = frozen.select("path", F.col("sha256").alias("a")).join(now.select("path", F.col("sha256").alias("b")), "path", "full")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.col("a") != F.col("b"), "changed")
    return both.withColumn("status", status).where(F.col("status").isNotNull()).select("path", "status", (critical & (F.col("status") != "new")).alias("fatal"))
