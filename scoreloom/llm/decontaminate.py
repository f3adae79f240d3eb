"""Benchmark decontamination by size-partitioned MinHash containment search (operator 1)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import bytescan as B
from scoreloom.llm.common import fresh

SHINGLE, CONTAINMENT = 5, 0.8
#: Bytes of benchmark text that one pass over the documents searches for, and so the bound of what is sent to executors.
BLOCK_BYTES = 8_000_000
_FILTER_BITS = 22


def shingle_set(text: str | None) -> set[tuple[bytes, ...]]:
    """Distinct shingles: runs of five words, or the whole sequence of one to four words."""
    words = (text or "").encode().translate(B.LOWER.tobytes()).split()
    return {tuple(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, bool(words)))}


def needed(size: int) -> int:
    """Fewest shared shingles that give an item of ``size`` shingles the containment asked for."""
    return -(-size * 4 // 5)


def size_class(size: int) -> int:
    """Partition of an item: its size's power of two."""
    return size.bit_length()


class Sketches:
    """MinHash sketches of a block of items, partitioned by size.

    All items of a size class have sketches of one depth: the least ``depth`` hashes of
    their shingle sets, where depth is one more than the most shingles that an
    item of the class may lack. A document that contains an item to the
    threshold therefore holds at least one hash of its sketch: the search has
    no false negatives, whatever the document's length.
    """

    def __init__(self, items: list[tuple[object, str | None]]) -> None:
        self.ids = [i for i, _ in items]
        self.sets = [shingle_set(t) for _, t in items]
        top: dict[int, int] = defaultdict(int)
        for s in self.sets:
            top[size_class(len(s))] = max(top[size_class(len(s))], len(s))
        self.depth = {k: n - needed(n) + 1 for k, n in top.items()}
        keys: dict[int, list[int]] = defaultdict(list)
        texts = pa.array([t or "" for _, t in items], pa.string())
        for lo, data, offsets in B.chunks(texts):
            h, doc = _hashes(data, offsets)
            for row in np.unique(doc).tolist():
                own = np.unique(h[doc == row])
                for key in own[: self.depth[size_class(len(self.sets[lo + row]))]].tolist():
                    keys[key].append(lo + row)
        self.keys = np.array(sorted(keys), np.uint64)
        self.items = [keys[k] for k in self.keys.tolist()]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, set[int]]:
        """By row of the chunk, items that share a hash of their sketch and are not larger than the document allows."""
        h, doc = _hashes(data, offsets)
        maybe = self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        h, doc, shingles = h[maybe], doc[maybe], np.bincount(doc, minlength=len(offsets) - 1)
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        found = defaultdict(set)
        for k in np.flatnonzero(self.keys[at] == h).tolist() if len(self.keys) else []:
            row = int(doc[k])
            found[row].update(i for i in self.items[at[k]] if needed(len(self.sets[i])) <= shingles[row])
        return found


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = B.LOWER[data]
    found = B.words(low, offsets)
    return B.shingles(B.hashes(low, found.starts, found.ends), found, SHINGLE)


def _search(sketches: Sketches, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, items, shared, size = [], [], [], []
            texts = batch.column(1)
            for lo, data, offsets in B.chunks(texts):
                for row, candidates in sketches.candidates(data, offsets).items():
                    own = shingle_set(texts[lo + row].as_py())
                    for i in candidates:
                        n = len(sketches.sets[i] & own)
                        if n >= needed(len(sketches.sets[i])):
                            docs.append(lo + row)
                            items.append(sketches.ids[i])
                            shared.append(n)
                            size.append(len(sketches.sets[i]))
            ids = batch.column(0).take(pa.array(docs, pa.int64()))
            yield pa.record_batch([ids, pa.array(items, pa.int64()), pa.array(shared, pa.int64()), pa.array(size, pa.int64())], schema=schema)

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item)`` for each document that holds at least 0.8 of an item's shingles.

    Shingles are distinct runs of five words of the text lower-cased in A-Z;
    1 to 4 words form one shingle, which only a text of exactly these words
    shares. Null and empty texts have no shingles: such items are found
    nowhere, such documents hold nothing. The test set is read in blocks of
    ``BLOCK_BYTES``, each searched for in one pass over the documents without a
    shuffle; candidates by MinHash are verified on the shingles themselves.
    Null ids are kept as null, repeated rows of either table each give their
    rows, an empty table gives none. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_id_col).cast("long"), F.col(item_text_col))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())])
    ddl = "doc_id long, item_id long, n_shared long, n_item long"
    parts = [docs.mapInArrow(_search(Sketches(block), schema), ddl) for block in _blocks(items)]
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], ddl)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item (as in :func:`contained_items`); columns stay as they are."""
    items = items.select(F.col(item_id_col).cast("long"), F.col(item_text_col))
    (flag,) = fresh(docs, "contaminated")
    out = docs
    for block in _blocks(items):
        out = out.withColumn(flag, _holds(Sketches(block))(F.col(text_col))).where(~F.col(flag)).drop(flag)
    return out


def _holds(sketches: Sketches):
    def holds(texts: pa.Array) -> pa.Array:
        hit = np.zeros(len(texts), bool)
        for lo, data, offsets in B.chunks(texts):
            for row, candidates in sketches.candidates(data, offsets).items():
                own = shingle_set(texts[lo + row].as_py())
                hit[lo + row] = any(len(sketches.sets[i] & own) >= needed(len(sketches.sets[i])) for i in candidates)
        return pa.array(hit)

    return F.arrow_udf(holds, "boolean")
