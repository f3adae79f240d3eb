"""Token alignment of two tokenizers by a dangling-suffix transducer (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import bytescan as B
from scoreloom.llm.common import stage

#: Vocabularies that are aligned.
BYTE_VOCABULARY, PIECE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Longest part, in bytes, whose alignment a worker keeps, and how many parts, bytes for them and transitions it keeps before it begins anew.
KEPT_BYTES, KEPT, KEPT_TOTAL, TRANSITIONS = 256, 600_000, 200_000_000, 200_000
#: Rows of the table of counts up to which it is broadcast (16 bytes each); a larger one is joined by shuffle, with the same result.
BROADCAST = 2_000_000

#: Bytes after which a space may begin a part: no white space ends with them.
_ENDS = np.ones(256, bool)
_ENDS[[*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x90), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
_MARK = "▁".encode()


def byte_level() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: printable ones as they are, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class ByteSide:
    """Byte-level BPE, read as if a space came before the text."""

    def __init__(self, path: str = BYTE_VOCABULARY) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        decode, vocabulary = byte_level(), self.model.get_vocab()
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(decode[c] for c in piece) if all(c in decode for c in piece) else piece.encode()

    def ids(self, text: str) -> list[int]:
        return self.model.encode(" " + text, add_special_tokens=False).ids


class PieceSide:
    """BPE with byte fallback, which puts a space before the text itself."""

    def __init__(self, path: str = PIECE_VOCABULARY) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id("▁")

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text) if text else [self.space]


class Transducer:
    """Aligns token sequences of two sides that spell the same bytes.

    The state is the side that leads and its dangling suffix, the bytes that
    the other side has not matched yet. The side behind gives the next token:
    it shortens the suffix, or outgrows it and leads with its own, or ends with
    it, which closes a group. A transition depends on the state and that token
    alone, so it is found once and kept. Many sequences are followed at once,
    each a step at a time: their next states are looked up together.
    """

    def __init__(self, a: list[bytes], b: list[bytes]) -> None:
        self.bytes = (a, b)
        self.width = max(len(a), len(b))
        self.forget()

    def forget(self) -> None:
        self.number: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.state: list[tuple[int, bytes]] = [(0, b"")]
        self.next: dict[int, int] = {}
        self._arrays()

    def _arrays(self) -> None:
        """The transitions by rising key ``state * width + token``, and for each state whether side A gives the next token."""
        self.keys = np.array(sorted(self.next), np.int64)
        self.targets = np.array([self.next[k] for k in self.keys.tolist()], np.int64)
        self.from_a = np.array([not k or bool(leads) for k, (leads, _) in enumerate(self.state)])

    def step(self, state: int, token: int) -> int:
        """The state after the side behind gives ``token``; from state 0 side A begins."""
        key = state * self.width + token
        if (known := self.next.get(key)) is not None:
            return known
        leads, rest = self.state[state]
        got = self.bytes[1 - leads if state else 0][token]
        if not state:
            new = (0, got)
        elif rest.startswith(got):
            new = (leads, rest[len(got) :])
        elif got.startswith(rest):
            new = (1 - leads, got[len(rest) :])
        else:
            raise ValueError("the sides differ")
        to = self.number.setdefault(new if new[1] else (0, b""), len(self.state))
        if to == len(self.state):
            self.state.append(new)
        self.next[key] = to
        return to

    def steps(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        keys = states * self.width + tokens
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            for key in np.unique(keys[new]).tolist():
                self.step(*divmod(key, self.width))
            self._arrays()
            at = np.searchsorted(self.keys, keys)
        return self.targets[at]

    def align(self, a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of sequences ``k`` with tokens ``a[a_first[k] : a_first[k + 1]]`` and likewise of ``b``: the group, from 0, of each token of both sides, and the sequence and sides of each link.

        A link is a step that does not begin a group: the token that leads and
        the one that comes to it.
        """
        if len(self.next) > TRANSITIONS:
            self.forget()
        i, j, end_a, end_b = a_first[:-1].copy(), b_first[:-1].copy(), a_first[1:], b_first[1:]
        state, closed = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        group_a, group_b, found = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), []
        live = np.flatnonzero(i < end_a)
        while len(live):
            now, at_a, at_b = state[live], i[live], j[live]
            gives = self.from_a[now]
            if (np.where(gives, at_a - end_a[live], at_b - end_b[live]) >= 0).any():
                raise ValueError("the sides differ")
            token = np.where(gives, a[np.minimum(at_a, len(a) - 1)], b[np.minimum(at_b, len(b) - 1)])
            linked = now > 0
            found.append(np.stack([live, np.where(gives, token, a[at_a - 1]), np.where(gives, b[at_b - 1], token)])[:, linked])
            group_a[at_a[gives]], group_b[at_b[~gives]] = closed[live[gives]], closed[live[~gives]]
            i[live], j[live] = at_a + gives, at_b + ~gives
            then = self.steps(now, token)
            state[live] = then
            closed[live] += then == 0
            live = live[(then > 0) | (i[live] < end_a[live])]
        if (j < end_b).any():
            raise ValueError("the sides differ")
        links = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
        return group_a, group_b, closed, links[:, np.argsort(links[0], kind="stable")]


class Store:
    """Alignments of texts by number: counts of tokens, groups and links, whether a text has none, the groups as text, and the links as ``a * kinds + b``."""

    def __init__(self) -> None:
        self.sizes = np.zeros((0, 5), np.int64)
        self.links = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.texts: list[bytes] = []
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, sizes: np.ndarray, texts: list[bytes], links: np.ndarray) -> None:
        self.waiting.append((sizes, links))
        self.texts += texts
        self.bytes += sum(map(len, texts)) + 8 * len(links) + 150 * len(texts)

    def settle(self) -> None:
        if self.waiting:
            self.sizes = np.concatenate([self.sizes, *(s for s, _ in self.waiting)])
            self.links = np.concatenate([self.links, *(x for _, x in self.waiting)])
            self.first = np.concatenate([[0], np.cumsum(self.sizes[:, 3])])
            self.waiting = []


@dataclass
class Aligner:
    """Alignments of the parts of texts.

    A text is cut before every space that follows other than white space: no
    token of either vocabulary goes over such a place, and what comes after it
    does not depend on what came before. So a part is encoded once, without its
    space, and its alignment holds wherever the part occurs.
    """

    a: ByteSide
    b: PieceSide
    known: dict[int, int] = field(default_factory=dict)
    store: Store = field(default_factory=Store)

    def __post_init__(self) -> None:
        self.kinds = len(self.b.bytes)
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        self.length = [np.array([len(x) for x in side.bytes]) for side in (self.a, self.b)]
        self.shown = [f"{i}{mark}".encode() for i in range(self.transducer.width) for mark in ",|;"]
        self.shown_size = np.array([len(x) for x in self.shown])

    def ids(self, text: bytes) -> list[np.ndarray] | None:
        """Both sides' tokens of a text with a space before it; None if a side's bytes are others."""
        found = [side.ids(text.decode()) for side in (self.a, self.b)]
        if any(b"".join(map(side.bytes.__getitem__, ids)) != b" " + text for side, ids in zip((self.a, self.b), found, strict=True)):
            return None
        return [np.array(ids, np.int64) for ids in found]

    def learn(self, texts: list[bytes]) -> np.ndarray:
        """Add the alignments of ``texts`` to the store and return their numbers in it. Those that may be joined are encoded together."""
        begin, number = len(self.store.texts), np.empty(len(texts), np.int64)
        joined = [k for k, t in enumerate(texts) if t and _ENDS[t[-1]] and _MARK not in t]
        cuts = np.cumsum([len(texts[k]) + 1 for k in joined])
        found = self.ids(b" ".join(texts[k] for k in joined)) if joined else None
        ends = []
        if found is not None:
            upto = [np.cumsum(length[ids]) for length, ids in zip(self.length, found, strict=True)]
            ends = [np.searchsorted(x, cuts) for x in upto]
        if found is None or any((x[e] != cuts).any() for x, e in zip(upto, ends, strict=True)):
            joined = []
        else:
            number[joined] = begin + np.arange(len(joined))
            self._add(found[0], np.append(0, ends[0] + 1), found[1], np.append(0, ends[1] + 1), np.ones(len(joined), bool))
        alone = sorted(set(range(len(texts))).difference(joined))
        if alone:
            number[alone] = begin + len(joined) + np.arange(len(alone))
            own = [self.ids(texts[k]) for k in alone]
            sides = [[p[side] if p is not None else np.zeros(0, np.int64) for p in own] for side in (0, 1)]
            first = [np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype(np.int64) for side in sides]
            self._add(np.concatenate(sides[0]), first[0], np.concatenate(sides[1]), first[1], np.array([p is not None for p in own]))
        return number

    def _add(self, a: np.ndarray, first_a: np.ndarray, b: np.ndarray, first_b: np.ndarray, has: np.ndarray) -> None:
        group_a, group_b, groups, links = self.transducer.align(a, first_a, b, first_b)
        sizes = np.stack([np.diff(first_a), np.diff(first_b), groups, np.bincount(links[0], minlength=len(groups)), ~has], axis=1).astype(np.int64)
        self.store.add(sizes, self._shown(a, group_a, first_a, b, group_b, first_b, groups), links[1] * self.kinds + links[2])

    def _shown(self, a: np.ndarray, group_a: np.ndarray, first_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, first_b: np.ndarray, groups: np.ndarray) -> list[bytes]:
        """The groups of each sequence as ``a1,a2|b1;a3|b2``."""
        before = np.cumsum(groups) - groups
        place = 2 * np.concatenate([group_a + np.repeat(before, np.diff(first_a)), group_b + np.repeat(before, np.diff(first_b))])
        place[len(a) :] += 1
        order = np.argsort(place, kind="stable")
        place, token = place[order], np.concatenate([a, b])[order]
        mark = np.full(len(token), 2)
        mark[:-1] = np.where(place[1:] == place[:-1], 0, np.where(place[1:] == place[:-1] + 1, np.where(place[:-1] % 2 == 0, 1, 2), 2))
        which = 3 * token + mark
        text = b"".join(map(self.shown.__getitem__, which.tolist()))
        ends = np.concatenate([[0], np.cumsum(self.shown_size[which])])[first_a + first_b].tolist()
        return [text[lo : max(lo, hi - 1)] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]

    def parts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each part of a chunk the number of its alignment in the store; parts over ``KEPT_BYTES`` are not kept for later chunks."""
        if len(self.known) > KEPT or self.store.bytes > KEPT_TOTAL:
            self.known, self.store = {}, Store()
        size = ends - starts
        short, long = np.flatnonzero(size <= KEPT_BYTES), np.flatnonzero(size > KEPT_BYTES)
        keys, at, of = np.unique(B.hashes(data, starts, ends)[short], return_index=True, return_inverse=True)
        number = np.fromiter((self.known.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        new = np.flatnonzero(number < 0)
        raw, wanted = data.tobytes(), np.concatenate([short[at[new]], long])
        texts = [raw[lo:hi] for lo, hi in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True)]
        learned = self.learn(texts)
        self.store.settle()
        number[new] = learned[: len(new)]
        self.known.update(zip(keys[new].tolist(), number[new].tolist(), strict=True))
        where = np.empty(len(starts), np.int64)
        where[short], where[long] = number[of], learned[len(new) :]
        return where


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner of two vocabularies: what it has learned stays for later tasks."""
    if (a_path, b_path) not in _aligners:
        _aligners.clear()
        _aligners[a_path, b_path] = Aligner(ByteSide(a_path), PieceSide(b_path))
    return _aligners[a_path, b_path]


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each part, without the space before it; bounds of rows among the rows that aren't empty, and of those among the parts."""
    space = np.zeros(len(data), bool)
    space[1:] = (data[1:] == 0x20) & _ENDS[data[:-1]]
    full = offsets[:-1] < offsets[1:]
    space[offsets[:-1][full]] = False
    at = np.flatnonzero(space)
    starts = np.sort(np.concatenate([offsets[:-1][full], at + 1]))
    ends = np.sort(np.concatenate([offsets[1:][full], at]))
    row = np.searchsorted(offsets[:-1][full], at, "right")
    first = np.concatenate([[0], np.cumsum(np.bincount(row - 1, minlength=int(full.sum())) + 1)]) if len(full) else np.zeros(1, np.int64)
    return starts, ends, np.concatenate([[0], np.cumsum(full)]).astype(np.int64), first.astype(np.int64)


_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _aligned(docs: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """A row for each of ``docs``, with its distinct id pairs (``a * kinds of b + b``) and how often each is linked."""

    def rows(ids: pa.Array, aligner: Aligner, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        n = len(offsets) - 1
        starts, ends, full, first = cut(data, offsets)
        where = aligner.parts(data, starts, ends)
        store = aligner.store
        by_full = np.add.reduceat(store.sizes[where], first[:-1], axis=0) if len(where) else np.zeros((0, 5), np.int64)
        by_full[by_full[:, 4] > 0] = 0
        which = np.flatnonzero(np.diff(full))
        counts = np.zeros((n, 4), np.int64)
        counts[which] = by_full[:, :4]
        digest, own = [""] * n, where.tolist()
        for k, row in enumerate(which.tolist()):
            if by_full[k, 0]:
                digest[row] = hashlib.sha256(b";".join(map(store.texts.__getitem__, own[first[k] : first[k + 1]]))).hexdigest()
        kinds = max(len(store.texts), 1)
        row = np.repeat(which, np.diff(first))
        key, times = np.unique((row * kinds + where)[counts[row, 0] > 0], return_counts=True)
        row, part = np.divmod(key, kinds)
        size = store.sizes[part, 3]
        pair = store.links[np.repeat(store.first[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        row = np.repeat(row, size)
        order = np.lexsort((pair, row))
        row, pair, times = row[order], pair[order], np.repeat(times, size)[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])])) if len(row) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, new) if len(new) else times
        cuts = pa.array(np.searchsorted(row[new], np.arange(n + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (pair[new], times.astype(np.int32))]
        return pa.record_batch([ids, *(pa.array(counts[:, k]) for k in range(4)), pa.array(digest), *lists], [x.split()[0] for x in _ROW.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_path, b_path)
        for batch in batches:
            for lo, data, offsets in B.chunks(batch.column(1)):
                yield rows(batch.column(0).slice(lo, len(offsets) - 1), aligner, data, offsets)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _ROW)


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_VOCABULARY, b_path: str = PIECE_VOCABULARY) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of each row of ``docs``.

    Texts are aligned once, and their distinct id pairs are written beside the
    rows. The number of rows that hold a pair, and the highest such number of
    its first id, cover all of ``docs``; they come back to the pairs by a join
    and are summed by row. Nulls, empty texts and texts whose bytes a vocabulary
    does not give back have zeros and the digest ''. Ids may be null or repeat:
    every row counts for itself. An empty table gives no rows; other columns are
    not read.
    """
    rows = _aligned(docs, id_col, text_col, a_path, b_path).withColumn("key", F.monotonically_increasing_id())
    rows = stage(rows, "aligned", compression="zstd")
    pairs = rows.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = stage(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    kinds = len(PieceSide(b_path).bytes)
    by_a = counts.withColumn("a", F.expr(f"pair div {kinds}"))
    top = by_a.groupBy("a").agg(F.max("n").alias("top"))
    counts = stage(by_a.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "best")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST else counts
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    found = pairs.join(counts, "pair").groupBy("key").agg(*sums)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs", "times").join(found, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_VOCABULARY, b_path: str = PIECE_VOCABULARY) -> DataFrame:
    """``(doc_id, groups)``: the groups of each row of ``docs`` as ``a1,a2|b1;...``, '' without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_path, b_path)
        for batch in batches:
            for lo, data, offsets in B.chunks(batch.column(1)):
                starts, ends, full, first = cut(data, offsets)
                where, store = aligner.parts(data, starts, ends), aligner.store
                out = [""] * (len(offsets) - 1)
                for k, row in enumerate(np.flatnonzero(np.diff(full)).tolist()):
                    own = where[first[k] : first[k + 1]]
                    if not store.sizes[own, 4].any():
                        out[row] = b";".join(map(store.texts.__getitem__, own.tolist())).decode()
                yield pa.record_batch([batch.column(0).slice(lo, len(out)), pa.array(out)], ["doc_id", "groups"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, groups string")
