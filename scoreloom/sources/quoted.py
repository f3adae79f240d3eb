"""Records of delimited text with quoted line breaks, read by several tasks from one file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks that begin inside quotes up to which their list is broadcast (some 200 bytes each); more are joined by shuffle.
LISTED = 200_000

_PIECE = "file string, block long, kind int, nr long, record string"
#: A whole record; the end of one that began in an earlier block; the beginning of one that goes on in a later block.
WHOLE, END, BEGIN = 0, 1, 2


class _Block:
    """The lines of one block as they come, and the record that is still open."""

    def __init__(self, file: str, block: int, inside: bool) -> None:
        self.file, self.block, self.inside = file, block, inside
        self.head, self.nr = inside, 0
        self.open: list[str] = []

    def add(self, lines: pa.Array, quote: str) -> list[tuple[int, int, pa.Array]]:
        """Kind, first number and texts of the records that these lines complete."""
        quotes = pc.count_substring(lines, quote).to_numpy(zero_copy_only=False)
        after = (np.cumsum(quotes) + self.inside) % 2 == 1  # inside quotes at a line's end
        ends = np.flatnonzero(~after)
        out = []
        done = int(ends[-1]) + 1 if len(ends) else 0
        if done:
            self.inside = False
            if self.open or self.head:  # the first record here began before these lines
                first = int(ends[0]) + 1
                text = pa.array(["\n".join([*self.open, *lines.slice(0, first).to_pylist()])])
                out.append((END if self.head else WHOLE, self.nr, text))
                self.nr += not self.head
                self.open, self.head = [], False
                ends = ends[1:]
            else:
                first = 0
            if len(ends):
                cuts = np.concatenate([[first], ends + 1]).astype(np.int32)
                texts = lines.slice(first, done - first) if (np.diff(cuts) == 1).all() else pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), lines), "\n")
                out.append((WHOLE, self.nr, texts))
                self.nr += len(ends)
        rest = lines.slice(done).to_pylist()
        self.open += rest
        self.inside = bool(after[-1]) if len(after) else self.inside
        return out

    def left(self) -> list[tuple[int, int, pa.Array]]:
        """What is open at the block's end; a block inside one record altogether is a part of it."""
        return [(END if self.head else BEGIN, self.nr, pa.array(["\n".join(self.open)]))] if self.open else []


def _pieces(quote: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Block | None = None

        def made(found: list[tuple[int, int, pa.Array]]) -> Iterator[pa.RecordBatch]:
            for kind, nr, texts in found:
                n = len(texts)
                columns = [pa.array([now.file] * n), pa.array([now.block] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(np.arange(nr, nr + n)), texts.cast(pa.string())]
                yield pa.record_batch(columns, [x.split()[0] for x in _PIECE.split(", ")])

        for batch in batches:
            files, blocks, lines = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(3)
            begins = [k for k in range(len(files)) if not k or blocks[k] != blocks[k - 1] or files[k] != files[k - 1]]
            for lo, hi in zip(begins, [*begins[1:], len(files)], strict=True):
                if now is None or (now.file, now.block) != (files[lo], blocks[lo]):
                    if now is not None:
                        yield from made(now.left())
                    now = _Block(files[lo], int(blocks[lo]), bool(batch.column(2)[lo].as_py()))
                yield from made(now.add(lines.slice(lo, hi - lo), quote))
        if now is not None:
            yield from made(now.left())

    return run


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``(file, record)`` of text files whose records may have line breaks between quotes; each file's first record is left out as its header.

    Files are read in blocks by many tasks, as lines. Whether a block begins
    between quotes is the parity of the quotes in all blocks before it, so one
    pass counts quotes by block, and prefix sums over blocks, one row for each,
    give that. The second pass makes a block's lines records; what crosses its
    ends is put together by file, a few rows for each block. Doubled quotes stand
    for themselves and do not change a parity. A file that ends between quotes is
    an error. Blank records and a carriage return at a record's end are left out.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    count = F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit("")))
    blocks = lines.groupBy("file", "block").agg((F.sum(count) % 2).alias("odd"))
    order = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    open_end = F.sum("odd").over(Window.partitionBy("file")) % 2 == 1
    fail = F.raise_error(F.concat(F.lit("a quote is not closed in "), "file")).cast("boolean")
    inside = blocks.select("file", "block", F.when(open_end, fail).otherwise(before).alias("inside")).where("inside")
    few = inside.limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        placed = lines.join(F.broadcast(spark.createDataFrame(few, "file string, block long, inside boolean")), ["file", "block"], "left")
    else:  # the order of lines is kept through the shuffle
        placed = lines.withColumn("at", F.monotonically_increasing_id()).join(inside, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "at")
    pieces = placed.select("file", "block", F.coalesce("inside", F.lit(False)).alias("inside"), "line").mapInArrow(_pieces(quote), _PIECE)
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "block", "nr", "record")
    ends = pieces.where(F.col("kind") != WHOLE)
    records = Window.partitionBy("file").orderBy("block", "kind")
    ends = ends.withColumn("id", F.sum((F.col("kind") == BEGIN).cast("int")).over(records))
    parts = F.array_sort(F.collect_list(F.struct("block", "kind", "nr", "record")))
    joined = ends.groupBy("file", "id").agg(parts.alias("x")).select("file", F.get("x", 0)["block"].alias("block"), F.get("x", 0)["nr"].alias("nr"), F.array_join(F.transform("x", lambda x: x["record"]), "\n").alias("record"))
    every = whole.union(joined).where("block > 0 or nr > 0")
    return every.select("file", F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")
