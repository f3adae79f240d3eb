"""Vectorised scans over the bytes of Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D. All functions work on
chunks of about a megabyte, so memory is bounded by the chunk size or by the one
document that is larger than it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BLOCK = 1 << 18
U = np.uint64

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _TRIM = None

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets from 0 of consecutive rows of about ``size`` bytes, at least one row."""
    at, data = raw(texts)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
    give_back()


def give_back() -> None:
    """Return freed memory to the system: idle Python workers stay beside the ones at work."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


@dataclass
class Spans:
    """Spans of one chunk: ``doc`` is the row in the chunk, ``first`` has the spans' bounds by row."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def spans(inside: np.ndarray, offsets: np.ndarray) -> Spans:
    """Runs of bytes that are ``inside``; no run goes over a document's end."""
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    begin[edge] = inside[edge]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets)
    return Spans(starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def words(data: np.ndarray, offsets: np.ndarray) -> Spans:
    return spans(~SPACE[data], offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Parts between 0x0A that are not empty."""
    return spans(data != 0x0A, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        made = np.full(max(n, BLOCK + 1), base, U)
        made[0] = 1
        have = _powers[base] = np.cumprod(made, dtype=U)
    return have


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each span's bytes; spans are in order and do not overlap."""
    out = np.empty(len(starts), U)
    base = (_BASE + 0x2545F4914F6CDD1C * salt | 1) % (1 << 64)
    inverse = _INVERSE if not salt else pow(base, -1, 1 << 64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK, "right")))
        s, e = starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]
        part = data[starts[lo] : ends[hi - 1]]
        n = len(part)
        total = np.zeros(n + 1, U)
        np.cumsum((part.astype(U) + U(1)) * _powers_of(base, n + 1)[:n], out=total[1:])
        out[lo:hi] = mix((total[e] - total[s]) * _powers_of(inverse, n + 1)[s] ^ ((e - s).astype(U) * U(0xD6E8FEB86659FD93)))
        lo = hi
    return out


def shingles(word_hash: np.ndarray, found: Spans, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``k`` words; a row of 1 to k-1 words gives its whole sequence once."""
    n = len(word_hash)
    total, step = np.zeros(max(n - k + 1, 0), U), U(1)
    for i in range(k):
        total = total + word_hash[i : n - k + 1 + i] * step if n >= k else total
        step = U(int(step) * 0xC2B2AE3D27D4EB4F % (1 << 64))
    whole = found.doc[: max(n - k + 1, 0)] == found.doc[k - 1 :] if n >= k else np.zeros(0, bool)
    out, doc = mix(total[whole]), found.doc[: max(n - k + 1, 0)][whole]
    size = np.diff(found.first)
    few = np.flatnonzero((size > 0) & (size < k))
    if len(few):
        extra = np.empty(len(few), U)
        for j, row in enumerate(few):
            value, step = 0x632BE59BD9B4E019 * int(size[row]), 1
            for h in word_hash[found.first[row] : found.first[row + 1]].tolist():
                value, step = value + h * step, step * 0xC2B2AE3D27D4EB4F
            extra[j] = value % (1 << 64)
        out, doc = np.concatenate([out, mix(extra)]), np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


def join_words(data: np.ndarray, found: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each; where each starts and ends there."""
    size = found.ends - found.starts
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if not len(size):
        return np.zeros(0, np.uint8), starts, ends
    source = np.repeat(found.starts - starts, size + 1)
    source += np.arange(len(source))
    np.minimum(source, len(data) - 1, out=source)
    out = data[source]
    out[ends] = 0x20
    return out, starts, ends


_P = [U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span, which may overlap; spans of one length are computed together."""
    p1, p2, p3, p4, p5 = _P
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    halves = np.ndarray((len(padded) - 3,), "<u4", padded.data, strides=(1,))
    size = ends - starts
    out = np.empty(len(starts), U)
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    round_ = lambda acc, lane: _turn(acc + lane * p2, 31) * p1
    with np.errstate(over="ignore"):
        for group in np.split(order, cut) if len(order) else []:
            at, n = starts[group], int(size[group[0]])
            i = 0
            if n >= 32:
                acc = [np.full(len(at), (seed + x) % (1 << 64), U) for x in (int(p1) + int(p2), int(p2), 0, -int(p1))]
                while i + 32 <= n:
                    for j in range(4):
                        acc[j] = round_(acc[j], lanes[at + (i + 8 * j)])
                    i += 32
                h = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
                for a in acc:
                    h = (h ^ round_(np.zeros(1, U), a)) * p1 + p4
            else:
                h = np.full(len(at), seed + int(p5), U)
            h = h + U(n)
            while i + 8 <= n:
                h = _turn(h ^ round_(np.zeros(1, U), lanes[at + i]), 27) * p1 + p4
                i += 8
            if i + 4 <= n:
                h = _turn(h ^ halves[at + i].astype(U) * p1, 23) * p2 + p3
                i += 4
            while i < n:
                h = _turn(h ^ padded[at + i].astype(U) * p5, 11) * p1
                i += 1
            h = (h ^ (h >> U(33))) * p2
            h = (h ^ (h >> U(29))) * p3
            out[group] = h ^ (h >> U(32))
    return out
