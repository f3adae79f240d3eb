"""Exact ranked lexical search over dual-sorted wavelet trees (operator 13).

An index is a table of shards. In a shard, the postings of each term stand
together, those of high impact first, and terms one after the other; a wavelet
matrix over that sequence of document numbers lets a range of postings be
narrowed to a range of documents while the order by impact stays. So the first
posting of a narrowed range bounds the term's part of any score in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm import bytescan as B
from scoreloom.llm.common import stage

TOP = 10
#: Postings and documents from which on a shard is closed, and bytes of query text that one pass over the index answers.
SHARD, SHARD_DOCS, BLOCK_BYTES = 1 << 21, 1 << 20, 4 << 20
#: Queries that a task searches together, and nodes that each of them opens in a round.
GROUP, BEAM = 64, 32
#: Stands for a null id, which comes after all others.
_NO_ID = (1 << 63) - 1

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_SHARD = "doc_ids binary, m binary, terms binary, starts binary, bits binary, tf binary"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[B.Spans, np.ndarray]:
    """Spans of letters, digits and all bytes from 0x80 on, with the hash of each in lower case (A-Z only)."""
    low = B.LOWER[data]
    found = B.spans(_TERM[low], offsets)
    return found, B.hashes(low, found.starts, found.ends)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many of ``docs`` have a term, and how many terms, repeats included, they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = every = 0
            for _, data, offsets in B.chunks(batch.column(0)):
                n = np.diff(B.spans(_TERM[data], offsets).first)
                full, every = full + int(np.count_nonzero(n)), every + int(n.sum())
            yield pa.record_batch([pa.array([full]), pa.array([every])], ["n", "l"])

    row = docs.select(F.col(text_col)).mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


class _Postings:
    """Postings of the documents that are to share a shard."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.length: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.docs = 0

    def add(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        found, h = terms(data, offsets)
        n = np.diff(found.first)
        full = np.flatnonzero(n)
        order = np.lexsort((h, found.doc))
        h, doc = h[order], found.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        number = np.cumsum(n > 0) - 1 + self.docs
        self.parts.append((h[at], number[doc[at]].astype(np.int32), np.diff(np.append(at, len(h))).astype(np.int32)))
        self.ids.append(ids[full])
        self.length.append(n[full])
        self.size, self.docs = self.size + len(at), self.docs + len(full)

    def shard(self, n: int, l: int) -> pa.RecordBatch:
        """The index of these documents, numbered in the order of their ids."""
        ids, length = np.concatenate(self.ids), np.concatenate(self.length)
        h, doc, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        order = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), np.int32)
        number[order] = np.arange(len(ids), dtype=np.int32)
        ids, m, doc = ids[order], 25 + 75 * length[order] * n // l, number[doc]
        kinds, term = np.unique(h, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(kinds)))]).astype(np.int32)
        order = np.lexsort((doc, -impact(tf.astype(np.int64), m[doc]), term))
        seq, tf = doc[order], tf[order]
        levels = max(1, (len(ids) - 1).bit_length())
        bits = np.zeros((levels, 8 * (len(seq) // 64 + 1)), np.uint8)
        for k in range(levels):
            one = (seq >> (levels - 1 - k)) & 1 == 1
            packed = np.packbits(one, bitorder="little")
            bits[k, : len(packed)] = packed
            seq, tf = np.concatenate([seq[~one], seq[one]]), np.concatenate([tf[~one], tf[one]])
        columns = [pa.array([x.tobytes()], pa.binary()) for x in (ids.astype("<i8"), m.astype("<i8"), kinds.astype("<u8"), starts.astype("<i4"), bits, tf.astype("<i4"))]
        return pa.record_batch(columns, ["doc_ids", "m", "terms", "starts", "bits", "tf"])


@dataclass
class Index:
    """Shards of all documents with a term, and what the scores need of the whole corpus."""

    shards: DataFrame
    n: int
    l: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every row of ``docs``; each task closes a shard at ``SHARD`` postings. Nothing is shuffled.

    Rows without a term are left out, as no query finds them.
    """
    n, l = corpus_size(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Postings()
        for batch in batches:
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for lo, data, offsets in B.chunks(batch.column(1)):
                part.add(ids[lo : lo + len(offsets) - 1], data, offsets)
                if part.size >= SHARD or part.docs >= SHARD_DOCS:
                    yield part.shard(n, l)
                    part = _Postings()
        if part.docs:
            yield part.shard(n, l)
        B.give_back()

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return Index(stage(rows.mapInArrow(run, _SHARD), "wavelets", compression="zstd", maxRecordsPerFile="4"), n, l)


class Shard:
    """A shard's wavelet matrix: level 0 has the highest bit of the document numbers."""

    def __init__(self, ids: bytes, m: bytes, kinds: bytes, starts: bytes, bits: bytes, tf: bytes) -> None:
        self.ids, self.m = np.frombuffer(ids, "<i8"), np.frombuffer(m, "<i8")
        self.kinds, self.starts = np.frombuffer(kinds, "<u8"), np.frombuffer(starts, "<i4")
        self.tf = np.frombuffer(tf, "<i4")
        self.levels = max(1, (len(self.ids) - 1).bit_length())
        words = np.frombuffer(bits, "<u8").reshape(self.levels, -1)
        self.width = words.shape[1]
        ones = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int32)
        self.zeros = (len(self.tf) - ones[:, -1]).astype(np.int32)
        self.before = np.concatenate([np.zeros((self.levels, 1), np.int32), ones[:, :-1]], axis=1).ravel()
        self.words = words.ravel()

    def ones(self, level: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ones of a level before a position, and the bit there."""
        word = level * self.width + (at >> 6)
        here, low = self.words[word], (at & 63).astype(np.uint64)
        upto = here & ((np.uint64(1) << low) - np.uint64(1))
        return self.before[word] + np.bitwise_count(upto).astype(np.int32), ((here >> low) & np.uint64(1)).astype(bool)

    def impact_at(self, level: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Impacts of the postings at these positions of these levels; ``doc`` has the bits above the level."""
        at, doc = at.copy(), doc.copy()
        order = np.argsort(level, kind="stable")
        reached = np.searchsorted(level[order], np.arange(self.levels), "right")
        for k in range(self.levels):
            own = order[: reached[k]]
            if len(own):
                ones, bit = self.ones(np.full(len(own), k), at[own])
                at[own] = np.where(bit, self.zeros[k] + ones, at[own] - ones)
                doc[own] = 2 * doc[own] + bit
        return impact(self.tf[at].astype(np.int64), self.m[doc])

    def ranges(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of each term start and end; both alike for a term that the shard lacks."""
        at = np.minimum(np.searchsorted(self.kinds, h), len(self.kinds) - 1)
        has = self.kinds[at] == h
        return np.where(has, self.starts[at], 0), np.where(has, self.starts[at + 1], 0)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), first[1], ..."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _best(query: np.ndarray, score: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    """Rows of the ``top`` highest scores of each query, of equal ones those of the lowest documents, in that order."""
    order = np.lexsort((doc, -score, query))
    q = query[order]
    begin = np.searchsorted(q, q)
    return order[np.arange(len(q)) - begin < top]


def search_shard(shard: Shard, first: np.ndarray, h: np.ndarray, weight: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, document number and score of the ``top`` best documents of each query; query k has terms first[k] to first[k + 1].

    A node is a range of documents with the part of each term's postings in it.
    Its bound is the sum of its terms' first impacts by their weights, at a
    single document the score. Each round opens the ``BEAM`` nodes of highest
    bound of each query, and drops those that can't enter its best ones.
    """
    queries = len(first) - 1
    start, end = shard.ranges(h)
    term = np.flatnonzero(end > start)
    lo, hi = start[term].astype(np.int32), end[term].astype(np.int32)
    high = shard.impact_at(np.zeros(len(term), np.int64), lo.astype(np.int64), np.zeros(len(term), np.int64))
    pool = [lo, hi, term.astype(np.int32), high.astype(np.int32)]
    used = len(term)
    cut = np.searchsorted(term, first)
    size = np.diff(cut)
    own = np.flatnonzero(size)
    part = high * weight[term]
    bound = np.add.reduceat(part, cut[:-1][own]) if len(own) else np.zeros(0, np.int64)
    nodes = [own, np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), bound, cut[:-1][own], size[own]]  # query, level, bits of the documents, bound, its ranges
    got = [np.zeros(0, np.int64) for _ in range(3)]
    least, last = np.zeros(queries, np.int64), np.full(queries, -1, np.int64)  # the score and document at place ``top``
    while True:
        query, level, doc, bound, *_ = nodes
        lowest = doc << (shard.levels - level)
        live = np.flatnonzero((bound > 0) & ((bound > least[query]) | (bound == least[query]) & (lowest < last[query])))
        if not len(live):
            break
        nodes = [x[live] for x in nodes]
        query, level, doc, bound, at, size = nodes
        pick = _best(query, bound, lowest[live], BEAM)
        rest = np.ones(len(query), bool)
        rest[pick] = False
        query, level, doc, at, size = (x[pick] for x in (query, level, doc, at, size))
        nodes = [x[rest] for x in nodes]

        take = _spread(at, size)
        node = np.repeat(np.arange(len(pick)), size)
        lo, hi, term, high = (x[take] for x in pool)
        deep = level[node]
        ones_lo, bit = shard.ones(deep, lo)
        ones_hi, _ = shard.ones(deep, hi)
        begins, ends = [lo - ones_lo, shard.zeros[deep] + ones_lo], [hi - ones_hi, shard.zeros[deep] + ones_hi]
        made = []
        for side in (0, 1):
            there = np.flatnonzero(ends[side] > begins[side])
            impacts = high[there].copy()
            new = np.flatnonzero(bit[there] != side)
            from_ = there[new]
            impacts[new] = shard.impact_at(deep[from_] + 1, begins[side][from_].astype(np.int64), 2 * doc[node[from_]] + side)
            made.append((2 * node[there] + side, begins[side][there], ends[side][there], term[there], impacts))
        child, *fields = (np.concatenate(x) for x in zip(*made, strict=True))
        order = np.argsort(child, kind="stable")
        child, fields = child[order], [x[order] for x in fields]
        begin = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1]])) if len(child) else np.zeros(0, np.int64)
        bound = np.add.reduceat(fields[3] * weight[fields[2]], begin) if len(begin) else np.zeros(0, np.int64)
        parent, side = child[begin] >> 1, child[begin] & 1
        query, level, doc = query[parent], level[parent] + 1, 2 * doc[parent] + side
        leaf = level == shard.levels
        if leaf.any():
            got = [np.concatenate(x) for x in zip(got, (query[leaf], doc[leaf], bound[leaf]), strict=True)]
            keep = _best(got[0], got[2], got[1], top)
            got = [x[keep] for x in got]
            full = np.flatnonzero(np.diff(np.searchsorted(got[0], np.arange(queries + 1))) == top)
            where = np.searchsorted(got[0], full, "right") - 1
            least[full], last[full] = got[2][where], got[1][where]
        inner = np.flatnonzero(~leaf)
        if len(inner):
            size = np.diff(np.append(begin, len(child)))[inner]
            take = _spread(begin[inner], size)
            if used + len(take) > len(pool[0]):
                pool = [np.concatenate([x, np.zeros(used + len(take), np.int32)]) for x in pool]
            for x, new in zip(pool, fields, strict=True):
                x[used : used + len(take)] = new[take]
            added = (query[inner], level[inner], doc[inner], bound[inner], used + np.cumsum(size) - size, size)
            used += len(take)
            nodes = [np.concatenate(x) for x in zip(nodes, added, strict=True)]
    sure = got[2] > 0
    return got[0][sure], got[1][sure], got[2][sure]


def _query_terms(items: DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bounds, distinct terms and their repeats of the rows of ``items(id, text)`` that have a term."""
    rows = items.toArrow().combine_chunks()
    ids, by_row, kinds, counts = rows["id"].to_pylist(), [], [], []
    for lo, data, offsets in B.chunks(rows["text"]):
        found, h = terms(data, offsets)
        for k in range(len(offsets) - 1):
            distinct, n = np.unique(h[found.first[k] : found.first[k + 1]], return_counts=True)
            if len(distinct):
                by_row.append(ids[lo + k])
                kinds.append(distinct)
                counts.append(n)
    first = np.concatenate([[0], np.cumsum([len(x) for x in kinds], dtype=np.int64)]).astype(np.int64)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return by_row, first, join(kinds, np.uint64), join(counts, np.int64)


def document_frequency(index: Index, h: np.ndarray) -> np.ndarray:
    """How many documents hold each of the terms ``h``, which are sorted; reads the shards' dictionaries only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(h), np.int64)
        for batch in batches:
            for kinds, starts in zip(batch.column(0), batch.column(1), strict=True):
                kinds, starts = np.frombuffer(kinds.as_buffer(), "<u8"), np.frombuffer(starts.as_buffer(), "<i4")
                at = np.minimum(np.searchsorted(kinds, h), len(kinds) - 1)
                total += np.where(kinds[at] == h, starts[at + 1] - starts[at], 0)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["i", "df"])

    out = np.zeros(len(h), np.int64)
    for i, df in index.shards.select("terms", "starts").mapInArrow(run, "i long, df long").groupBy("i").agg(F.sum("df")).collect():
        out[i] = df
    return out


def _search_block(index: Index, items: DataFrame, top: int) -> DataFrame:
    ids, first, h, repeats = _query_terms(items)
    kinds, of = np.unique(h, return_inverse=True)
    df = document_frequency(index, kinds) if len(kinds) else np.zeros(0, np.int64)
    by_term = [math.floor(1000 * math.log((2 * index.n + 2) / (2 * x + 1))) for x in df.tolist()]
    weight = np.array(by_term, np.int64)[of] * repeats if len(kinds) else repeats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                shard = Shard(*(x.as_buffer() for x in row))
                found = []
                for k in range(0, len(ids), GROUP):
                    cut = first[k : k + GROUP + 1]
                    q, doc, score = search_shard(shard, cut - cut[0], h[cut[0] : cut[-1]], weight[cut[0] : cut[-1]], top)
                    found.append((q + k, shard.ids[doc], score))
                q, doc, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
                yield pa.record_batch([pa.array(q), pa.array(doc, mask=doc == _NO_ID), pa.array(score)], ["q", "doc_id", "score"])
            B.give_back()

    rows = index.shards.mapInArrow(run, "q long, doc_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    names = items.sparkSession.createDataFrame(list(enumerate(ids)), f"q long, item_id {items.schema['id'].dataType.simpleString()}")
    return rows.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def search(index: Index, items: DataFrame, top: int = TOP, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)`` of the ``top`` documents of the highest scores above 0 for each item.

    Exact: equal scores are ranked by ascending id, null ids last. Items are
    answered in blocks of about ``BLOCK_BYTES`` of text, each with one pass over
    the index; the driver holds one block. An id with several rows is one item
    with the terms of its distinct texts. Items without a term, nulls included,
    and an empty index give no rows. Each row of the documents is one, whatever
    its id; other columns are not read.
    """
    rows = items.select(F.col(item_id).alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    rows = rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    if blocks == 1:
        return _search_block(index, rows, top)
    rows = stage(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "items")
    out = [stage(_search_block(index, rows.where(F.col("block") == k).drop("block"), top), "found") for k in range(blocks)]
    while len(out) > 1:
        out = [a.union(b[0]) if b else a for a, *b in (out[i : i + 2] for i in range(0, len(out), 2))]
    return out[0]


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """:func:`search` for ``items(item_id, text)`` in an index of ``docs(doc_id, text)``."""
    return search(build_index(docs), items, top)
