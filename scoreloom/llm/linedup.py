"""Line-level deduplication by pairwise patience alignment (operator 8)."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import bytescan as B
from scoreloom.llm.common import SPACES, fresh, small_batches, stage

#: Least number of words of an aligned block that is deleted, unless told otherwise.
BLOCK_WORDS = 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def runs(size: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the shortest runs with ``least`` words that begin at a line, and of those that end at one, within a document.

    Each line of any block of ``least`` words or more is in one of the block's
    runs: those that begin at its lines and end inside, or the other way round.
    """
    total, at = np.cumsum(size), np.arange(len(size))
    end = np.searchsorted(total, total - size + least)
    whole = end < len(size)
    whole[whole] = doc[end[whole]] == doc[whole]
    begin = np.searchsorted(total - size, total - least, "right") - 1
    back = total >= least
    back[back] = doc[begin[back]] == doc[back]
    both = np.unique(np.concatenate([at[whole] * len(at) + end[whole], begin[back] * len(at) + at[back]]))
    return both // max(len(at), 1), both % max(len(at), 1)


def _run_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """A hash of the line hashes of each run, in order."""
    up, down = (np.full(len(h), x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    up[:1] = down[:1] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
    return B.mix((total[last + 1] - total[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for ``size`` values, of each pair in turn."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _run_batches(least: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each distinct run of each document: its two hashes, positions of its first line among those with a word, hashes and words of its lines."""
        for batch in batches:
            ids, version = batch.column(0), batch.column(1)
            for lo, data, offsets in B.chunks(batch.column(2)):
                lines, word = B.lines(data, offsets), B.words(data, offsets)
                size = np.searchsorted(word.starts, lines.ends) - np.searchsorted(word.starts, lines.starts)
                full = size > 0
                starts, ends, doc, size = lines.starts[full], lines.ends[full], lines.doc[full], size[full]
                first, last = runs(size, doc, least)
                if not len(first):
                    continue
                h1, h2 = (B.hashes(data, starts, ends, salt) for salt in (1, 2))
                w1, w2 = _run_hashes(h1, first, last, _BASES[0]), _run_hashes(h2, first, last, _BASES[1])
                rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
                order = np.lexsort((first, w2, w1, doc[first]))
                new = np.ones(len(order), bool)
                new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (doc[first], w1, w2)], axis=0)
                head = np.flatnonzero(new)
                one = order[head]
                at = pa.ListArray.from_arrays(pa.array(np.append(head, len(order)).astype(np.int32)), pa.array(rank[first][order].astype(np.int32)))
                n = last[one] - first[one] + 1
                inside = _ragged(first[one], n)
                cuts = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                row = pa.array(lo + doc[first[one]])
                yield pa.record_batch(
                    [
                        ids.take(row), version.take(row), pa.array(w1[one].view(np.int64)), pa.array(w2[one].view(np.int64)), at,
                        pa.ListArray.from_arrays(cuts, pa.array(h1[inside].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(size[inside].astype(np.int32))),
                    ],
                    ["id", "v", "w1", "w2", "at", "lines", "words"],
                )

    return found


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that rises on both sides; pairs are distinct on each side."""
    pairs = sorted(pairs)
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[pile], piles[pile] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(left: dict[int, int], right: dict[int, int]) -> list[tuple[int, int]]:
    """Patience diff of two documents given as position to line code; positions of lines not shared may be left out.

    Lines found once on each side anchor the alignment; stretches between
    anchors grow from both ends over equal lines and are aligned anew inside.
    """
    a, b = sorted(left), sorted(right)
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and left[a[al]] == right[b[bl]]:
            out.append((a[al], b[bl]))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and left[a[ah - 1]] == right[b[bh - 1]]:
            ah, bh = ah - 1, bh - 1
            out.append((a[ah], b[bh]))
        if al >= ah or bl >= bh:
            continue
        once_a = Counter(left[p] for p in a[al:ah])
        once_b = Counter(right[p] for p in b[bl:bh])
        where_b = {right[b[j]]: j for j in range(bl, bh) if once_b[right[b[j]]] == 1}
        chain = patience([(i, where_b[left[a[i]]]) for i in range(al, ah) if once_a[left[a[i]]] == 1 and left[a[i]] in where_b])
        if not chain:
            continue
        i0, j0 = al, bl
        for i, j in chain:
            out.append((a[i], b[j]))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, ah, j0, bh))
    return sorted(out)


def blocks(aligned: list[tuple[int, int]], words: dict[int, int], least: int = BLOCK_WORDS) -> list[int]:
    """Left positions of all runs that are consecutive on both sides and have ``least`` words or more."""
    out: list[int] = []
    run: list[int] = []
    for k, (i, j) in enumerate(aligned):
        if k and (i, j) != (aligned[k - 1][0] + 1, aligned[k - 1][1] + 1):
            if sum(words[p] for p in run) >= least:
                out += run
            run = []
        run.append(i)
    return out + run if sum(words[p] for p in run) >= least else out


def _align_batches(least: int):
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, removed = [], []
            for at in range(0, batch.num_rows, 256):
                for row, shared in enumerate(batch.column(2).slice(at, 256).to_pylist(), at):
                    left = {p + i: code for s in shared for p in s["here"] for i, code in enumerate(s["lines"])}
                    right = {q + i: code for s in shared for q in s["there"] for i, code in enumerate(s["lines"])}
                    words = {p + i: n for s in shared for p in s["here"] for i, n in enumerate(s["words"])}
                    if gone := blocks(align(left, right), words, least):
                        hit.append(row)
                        removed.append(gone)
            rows = pa.array(hit, pa.int64())
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(removed, pa.list_(pa.int32()))], ["id", "v", "removed"])

    return aligned


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = BLOCK_WORDS) -> DataFrame:
    """``(id, v, removed)``: positions, among the lines with a word, to delete from a document with version hash ``v``.

    Lines are the parts between newlines. Documents overlap if they share a
    block of ``least`` words, and any such block consists of the shortest runs of
    lines with so many words. A run is as rare as the rarest of its lines, or
    rarer, so its hash is what documents are paired by: every document with the
    first one that holds the run. A run that very many documents hold gives as
    many pairs as documents, never their square, nothing is capped, and a
    frequent short line pairs nobody. Each run meets its first holder; of blocks
    that stand crossed there only some are aligned, and the others stay even if
    a later document holds them in the same order.

    A pair's shared runs give the candidate lines, by their hashes; patience diff
    aligns them, and aligned blocks of ``least`` words go from the later document.
    A document's candidate lines number no more than the lines of its runs, over
    all its pairs. Documents are ordered by id and, for one id with several
    texts, by the text's hash.
    """
    key = F.xxhash64(F.col(text_col))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), key.alias("v"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        found = stage(rows.mapInArrow(_run_batches(least), "id long, v long, w1 long, w2 long, at array<int>, lines array<long>, words array<int>"), "runs")
    who = F.struct("id", "v")
    heads = found.groupBy("w1", "w2").agg(F.min(F.struct("id", "v", "at")).alias("head"), F.max(who).alias("tail"))
    heads = heads.where("struct(head.id, head.v) <> tail").select("w1", "w2", F.col("head.id").alias("p"), F.col("head.v").alias("pv"), F.col("head.at").alias("there"))
    heads = stage(heads, "heads")  # with an exchange of its own the join below can split a hot run
    pairs = found.join(heads, ["w1", "w2"]).where((F.col("id") != F.col("p")) | (F.col("v") != F.col("pv")))
    each = pairs.groupBy("id", "v", "p", "pv").agg(F.collect_set(F.struct(F.col("at").alias("here"), "there", "lines", "words")).alias("shared"))  # repeated rows give one set
    gone = each.select("id", "v", "shared").mapInArrow(_align_batches(least), "id long, v long, removed array<int>")
    gone = gone.groupBy("id", "v").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("removed")))).alias("removed"))
    with small_batches(docs.sparkSession):
        return stage(gone, "gone")


def _without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    """The texts less their removed lines; only texts that change become Python strings."""
    changed = pc.fill_null(pc.greater(pc.list_value_length(removed), 0), False)
    rows = pc.indices_nonzero(changed)
    new = []
    for text, gone in zip(texts.take(rows), removed.take(rows), strict=True):
        gone, rank, kept, cut = set(gone.as_py()), 0, [], False
        for line in text.as_py().split("\n"):
            if line.strip(SPACES):
                cut = rank in gone
                rank += 1
                if not cut:
                    kept.append(line)
            elif not cut:
                kept.append(line)
        new.append("\n".join(kept))
    return pc.replace_with_mask(texts, changed, pa.array(new, texts.type))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, least: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with aligned common blocks deleted from the later of two documents.

    A block is a run of lines that patience diff aligns one by one, of
    ``least`` words or more; lines without a word are looked through, and
    go with the deleted line before them. Only ``text_col`` changes;
    ``count_col`` adds the number of deleted lines.

    Null and empty texts hold no line and stay as they are, as do rows with a
    null id, which have no place in the order. Rows repeating an id with the
    same text are one document and change alike; with different texts they are
    told apart by the text. Empty tables give empty tables.
    """
    gone = repeated_lines(docs, id_col, text_col, least)
    k, v, r = fresh(docs, "join_id", "join_version", "removed")
    marked = docs.withColumn(k, F.col(id_col).cast("long")).withColumn(v, F.xxhash64(F.col(text_col)))
    gone = gone.select(F.col("id").alias(k), F.col("v").alias(v), F.col("removed").alias(r))
    marked = marked.join(gone.hint("merge"), [k, v], "left")  # the same plan at every size: the lines grow with the texts

    def cut(texts: pa.Array, removed: pa.Array) -> pa.Array:
        return _without(texts, removed)

    changes = F.size(r) > 0
    new = F.arrow_udf(cut, "string")(F.when(changes, F.col(text_col)), F.col(r))  # other texts need not go to the workers
    out = [F.when(changes, new).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return marked.select(*out, *([F.coalesce(F.size(r), F.lit(0)).cast("long").alias(count_col)] if count_col else []))
