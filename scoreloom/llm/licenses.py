"""Licence scans with a trained paragraph classifier (operator 7)."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import bytescan as B
from scoreloom.llm.common import stage

#: Notices by licence family (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Distributed under the terms of the Apache License 2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU GPL version 2 or later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0",
        "Released into the public domain",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission",
    ),
}
#: Buckets of the word n-grams, longest n-gram, and words of the windows at half steps in which a paragraph is searched.
BUCKETS, LONGEST, WIDTHS = 1 << 14, 3, (4, 8, 16, 32)
#: Windows of the corpus, ordinary ones by comparison with the templates, that the classifier is fitted on at most.
SAMPLE = 3_000
#: Share of all ordinary windows of the greatest width that may be taken for a notice of unknown family.
FALSE_SHARE = 0.0005
#: Share of a template's word pairs that a passage must hold to confirm a prediction, and words that may lie between two of them.
CONFIRMED, BETWEEN = 0.6, 4
#: Width and number of the steps in which notice scores are counted.
STEP, STEPS = 1 / 64, 1 << 13
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def tokens(text: str) -> list[bytes]:
    return bytes(b if _LETTERS[b] else 0x20 for b in text.encode().translate(B.LOWER.tobytes())).split()


@dataclass
class Grams:
    """Words of a chunk with their row and paragraph, and the bucket of each word's n-grams (-1 over a paragraph's end)."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    para: np.ndarray
    buckets: list[np.ndarray]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Word bounds of windows of ``width`` words at half steps; a shorter paragraph is one window."""
        n = np.bincount(self.para) if len(self.para) else np.zeros(0, np.int64)
        first = np.cumsum(n) - n
        count = np.where(n <= width, np.minimum(n, 1), -(-(n - width) // (width // 2)) + 1)
        para = np.repeat(np.arange(len(n)), count)
        begin = first[para] + (np.arange(len(para)) - np.repeat(np.cumsum(count) - count, count)) * (width // 2)
        return begin, np.minimum(begin + width, (first + n)[para])


def grams(data: np.ndarray, offsets: np.ndarray) -> Grams:
    """Paragraphs end with a text, and where a line has neither letter nor digit."""
    low = B.LOWER[data]
    found = B.spans(_LETTERS[low], offsets)
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    new = np.ones(len(found.starts), bool)
    new[1:] = (found.doc[1:] != found.doc[:-1]) | (lines[found.starts[1:]] - lines[found.ends[:-1]] > 1)
    para = np.cumsum(new) - 1
    h = B.hashes(low, found.starts, found.ends)
    buckets, total = [], h
    for n in range(1, LONGEST + 1):
        if n > 1:
            total = B.mix(total[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :]) if len(total) > 1 else np.zeros(0, np.uint64)
        b = np.full(len(h), -1, np.int64)
        b[: len(total)] = (B.mix(total + np.uint64(n)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        if n > 1 and len(h) >= n:
            b[: len(total)][para[: len(total)] != para[n - 1 :]] = -1
        buckets.append(b)
    return Grams(found.starts, found.ends, found.doc, para, buckets)


def _indices(texts: list[str]) -> list[np.ndarray]:
    """Buckets of the n-grams of each text, which is one line."""
    out = []
    for t in texts:
        raw = np.frombuffer(t.replace("\n", " ").encode(), np.uint8)
        g = grams(raw, np.array([0, len(raw)]))
        out.append(np.concatenate([b[b >= 0] for b in g.buckets]))
    return out


def fit_sparse(x: list[np.ndarray], y: np.ndarray, kinds: int, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression on mean n-gram indicators by AdaGrad steps, one text at a time."""
    w, b = np.zeros((BUCKETS, kinds)), np.zeros(kinds)
    gw, gb, order = np.full((BUCKETS, kinds), 1e-6), np.full(kinds, 1e-6), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            at = x[i]
            scale = 1 / np.sqrt(max(len(at), 1))
            z = w[at].sum(0) * scale + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            grad = p * scale
            gw[at] += grad**2
            w[at] -= 0.5 * grad / np.sqrt(gw[at])
            gb += p**2
            b -= 0.5 * p / np.sqrt(gb)
    return w, b


def variants(text: str, rng: random.Random, corpus: list[str]) -> str:
    """A template as notices come: with words lost, words of the corpus around it, or cut short."""
    words = [w for w in text.split() if rng.random() > 0.06]
    if rng.random() < 0.3 and len(words) > 8:
        words = words[: max(8, int(len(words) * rng.uniform(0.5, 1)))]
    around = rng.choice(corpus).split() if corpus else []
    if rng.random() < 0.5 and around:
        at, k = rng.randrange(len(around)), rng.randrange(1, 8)
        words = around[at : at + k] + words if rng.random() < 0.5 else words + around[at : at + k]
    return " ".join(words)


def _pairs(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return set(zip(words, words[1:], strict=False)) or {tuple(words)}


def passages(words: list[bytes], pairs: dict[tuple[bytes, ...], int]) -> list[tuple[int, int, float]]:
    """Bounds of the passages of ``words`` that hold ``CONFIRMED`` of a template's word pairs or more, and the share.

    ``pairs`` has how often the template holds each. A passage goes on while the
    next pair is at most ``BETWEEN`` words away. At a pair that it has already,
    and the template once, it ends if it is confirmed, and else begins after the
    earlier one.
    """
    out: list[tuple[int, int, float]] = []
    seen: dict[tuple[bytes, ...], int] = {}  # in the order of their places
    last = -1
    for i, pair in enumerate([*zip(words, words[1:], strict=False), None]):
        if pair is not None and pair not in pairs:
            continue
        share = len(seen) / len(pairs)
        if seen and (pair is None or i - last > BETWEEN or pair in seen and pairs[pair] == 1 and share >= CONFIRMED):
            if share >= CONFIRMED:
                out.append((next(iter(seen.values())), last + 2, share))
            seen = {}
        if pair in seen and pairs[pair] == 1:
            place = seen[pair]
            seen = {q: at for q, at in seen.items() if at > place}
        last = i
        seen.setdefault(pair, i)
    return out


@dataclass
class Licences:
    """Notice or not, then the family; both sparse n-gram logistic regressions."""

    names: list[str]
    notice: np.ndarray
    notice_bias: float
    family: np.ndarray
    family_bias: np.ndarray
    threshold: float
    unknown: float

    def __post_init__(self) -> None:
        templates = [(k, tokens(t)) for k, name in enumerate(self.names) for t in TEMPLATES[name]]
        self.pairs = [(k, Counter(zip(t, t[1:], strict=False))) for k, t in templates]

    def scores(self, g: Grams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By width, the windows of :meth:`Grams.windows` and how much each looks like a notice."""
        weight, n = np.zeros(len(g.starts)), np.zeros(len(g.starts))
        for b in g.buckets:
            weight += np.where(b >= 0, self.notice[b], 0.0)
            n += b >= 0
        total, count = np.concatenate([[0.0], np.cumsum(weight)]), np.concatenate([[0.0], np.cumsum(n)])
        for width in WIDTHS:
            begin, end = g.windows(width)
            yield begin, end, (total[end] - total[begin]) / np.sqrt(np.maximum(count[end] - count[begin], 1)) + self.notice_bias

    def families(self, g: Grams, words: list[bytes], at: int) -> list[tuple[int, int, str]]:
        """Bounds and family of the notices among ``words``, which begin at word ``at`` of the chunk.

        Templates of all families are compared. Where passages of several overlap,
        the classifier decides which of these families it is.
        """
        found = sorted((a, b, share, k) for k, pairs in self.pairs for a, b, share in passages(words, pairs))
        out, k = [], 0
        while k < len(found):
            group, end = [], found[k][1]
            while k < len(found) and (not group or found[k][0] < end):
                group.append(found[k])
                end = max(end, found[k][1])
                k += 1
            low = min(a for a, *_ in group)
            buckets = np.concatenate([b[at + low : at + end] for b in g.buckets])
            buckets = buckets[buckets >= 0]
            score = self.family[buckets].sum(0) / np.sqrt(max(len(buckets), 1)) + self.family_bias
            best = max({f for *_, f in group}, key=lambda f: score[f])
            a, b, *_ = max((x for x in group if x[3] == best), key=lambda x: (x[2], x[1] - x[0]))
            out.append((at + a, at + b, self.names[best]))
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
        """Row, start and end (bytes of the chunk) of notices, and the family or ``unknown``.

        Windows that look like a notice, of any width, are joined with as many
        words as the greatest before and after; those that meet form one stretch
        of a paragraph.
        Where no template is found in it, but a window of the greatest width
        passes the limit of the unknown, this window is a notice of unknown family.
        """
        g = grams(data, offsets)
        if not len(g.starts):
            return
        edge, unsure = np.zeros(len(g.starts) + 1, np.int64), []
        for width, (begin, end, z) in zip(WIDTHS, self.scores(g), strict=True):
            hit = z >= self.threshold
            low, high = begin[hit] - WIDTHS[-1], end[hit] + WIDTHS[-1]
            np.add.at(edge, np.maximum(low, np.searchsorted(g.para, g.para[begin[hit]])), 1)
            np.add.at(edge, np.minimum(high, np.searchsorted(g.para, g.para[begin[hit]], "right")), -1)
            if width == WIDTHS[-1]:
                unsure = [(int(begin[k]), int(end[k])) for k in np.flatnonzero(z >= self.unknown)]
        inside = np.cumsum(edge)[:-1] > 0
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (g.para[1:] != g.para[:-1])
        bounds = np.append(np.flatnonzero(new), len(inside))
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            b = a + int(np.argmin(np.append(inside[a:z], False)))
            words = [data[s:e].tobytes().translate(_LOWER) for s, e in zip(g.starts[a:b].tolist(), g.ends[a:b].tolist(), strict=True)]
            found = self.families(g, words, a)
            for lo, hi, name in found or [(lo, hi, "unknown") for lo, hi in unsure if a <= lo and hi <= b][:1]:
                yield int(g.doc[lo]), *_span(data, offsets, g, lo, hi), name


_LOWER = B.LOWER.tobytes()


def _span(data: np.ndarray, offsets: np.ndarray, g: Grams, lo: int, hi: int) -> tuple[int, int]:
    """Bytes of words ``lo`` to ``hi`` with the marks that follow the last; the whole line if they are half of its words or more."""
    row, start, end = int(g.doc[lo]), int(g.starts[lo]), int(g.ends[hi - 1])
    inside = data[offsets[row] : offsets[row + 1]].tobytes()
    low = inside.rfind(b"\n", 0, start - offsets[row]) + 1 + offsets[row]
    high = inside.find(b"\n", end - offsets[row])
    high = offsets[row + 1] if high < 0 else high + offsets[row]
    own = np.searchsorted(g.starts, high) - np.searchsorted(g.starts, low)
    if b"\n" not in data[start:end].tobytes() and 2 * (hi - lo) >= own:
        return int(low), int(high)
    while end < high and not B.SPACE[data[end]] and not _LETTERS[data[end]]:
        end += 1
    return start, end


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of least hash of a batch."""
    for batch in batches:
        best: list[tuple[int, str]] = []
        for _, data, offsets in B.chunks(batch.column(0)):
            g = grams(data, offsets)
            begin, end = (np.concatenate(x) for x in zip(*map(g.windows, WIDTHS), strict=True))
            h = B.mix((end - begin).astype(np.uint64) + B.hashes(data, g.starts, g.ends)[begin]) if len(begin) else np.zeros(0, np.uint64)
            for k in np.argsort(h, kind="stable")[:SAMPLE].tolist():
                best.append((int(h[k] >> np.uint64(1)), data[g.starts[begin[k]] : g.ends[end[k] - 1]].tobytes().decode(errors="replace")))
        best = sorted(set(best))[:SAMPLE]
        yield pa.record_batch([pa.array([h for h, _ in best], pa.int64()), pa.array([t for _, t in best], pa.string())], ["h", "p"])


def train(docs: DataFrame, text_col: str = "text", seed: int = 7) -> Licences:
    """Fit on variants of the templates against at most ``SAMPLE`` windows of the corpus, those of least hash.

    Candidates are windows that are rather a notice than not, and no worse than
    any template is. The unknown class is what is neither an ordinary text nor a
    known notice: notice scores of all windows of the greatest width in the
    corpus are counted, and its limit is where ``FALSE_SHARE`` of the ordinary
    ones would pass. Windows that hold half of a template are not ordinary.
    """
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    found = texts.mapInArrow(_window_batches, "h long, p string").distinct().orderBy("h", "p").limit(SAMPLE)
    corpus = [r.p for r in stage(found, "windows").orderBy("h", "p").collect()]
    rng, names = random.Random(seed), list(TEMPLATES)
    every = [_pairs(tokens(t)) for ts in TEMPLATES.values() for t in ts]
    plain = [c for c in corpus if not _holds_half(tokens(c), every)]
    made = [(k, variants(t, rng, plain)) for k, name in enumerate(names) for t in TEMPLATES[name] for _ in range(60)] + [(k, t) for k, name in enumerate(names) for t in TEMPLATES[name] for _ in range(5)]
    mixed = [" ".join(rng.sample(words, len(words) // 2 + 1)) for words in (t.split() for ts in TEMPLATES.values() for t in ts) for _ in range(4) if len(words) > 12]
    x = _indices([t for _, t in made] + plain + mixed)
    y = np.array([1] * len(made) + [0] * (len(plain) + len(mixed)))
    w, b = fit_sparse(x, y, 2)
    family, family_bias = fit_sparse(x[: len(made)], np.array([k for k, _ in made]), len(names))
    model = Licences(names, w[:, 1] - w[:, 0], float(b[1] - b[0]), family, family_bias, 0.0, 0.0)
    exact = min(model.notice[at].sum() / np.sqrt(max(len(at), 1)) + model.notice_bias for at in _indices([t for ts in TEMPLATES.values() for t in ts]))
    model.threshold = min(0.0, exact - 1e-9)
    model.unknown = max(ordinary_limit(texts, model, every), 0.0)
    return model


def _holds_half(words: list[bytes], every: list[set[tuple[bytes, ...]]]) -> bool:
    own = _pairs(words)
    return any(2 * len(p & own) >= len(p) for p in every)


def ordinary_limit(texts: DataFrame, model: Licences, every: list[set[tuple[bytes, ...]]]) -> float:
    """The notice score that ``FALSE_SHARE`` of all ordinary windows of ``texts`` exceed, from counts by step."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(STEPS, np.int64)
            for _, data, offsets in B.chunks(batch.column(0)):
                g = grams(data, offsets)
                *_, (begin, end, z) = model.scores(g)
                at = np.clip(np.floor(z / STEP).astype(np.int64) + STEPS // 2, 0, STEPS - 1)
                total += np.bincount(at, minlength=STEPS)
                for k in np.flatnonzero(z >= 0).tolist():  # only here may a notice be
                    words = data[g.starts[begin[k]] : g.ends[end[k] - 1]].tobytes().decode(errors="replace")
                    total[at[k]] -= _holds_half(tokens(words), every)
            full = np.flatnonzero(total)
            yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(total[full])], ["step", "n"])

    rows = sorted(map(tuple, texts.mapInArrow(count, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()), reverse=True)
    allowed, passed = FALSE_SHARE * sum(n for _, n in rows), 0
    for step, n in rows:
        passed += n
        if passed > allowed:
            return (step + 1 - STEPS // 2) * STEP
    return 0.0


def scan_licences(docs: DataFrame, model: Licences | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, notices)`` for each row: structs (start, end, family) of the notices found, in characters.

    A paragraph ends at a line without a letter or digit, and is searched as a
    whole, over its line ends, in windows of ``WIDTHS`` words; notices of all
    families with templates are reported, and in a stretch without any at most
    one unknown notice. Null and empty texts have no paragraph.
    Ids may be null and repeat; every row gives a row; an empty table gives none
    (and a classifier fitted on the templates alone). Other columns are not read.
    """
    model = model or train(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for lo, data, offsets in B.chunks(batch.column(1)):
                for row, start, end, name in model.scan(data, offsets):
                    before = len(data[offsets[row] : start].tobytes().decode(errors="replace"))
                    size = len(data[start:end].tobytes().decode(errors="replace"))
                    out[lo + row].append({"start": before, "end": before + size, "family": name})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string())]))
            yield pa.record_batch([batch.column(0), pa.array(out, kind)], ["doc_id", "notices"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, notices array<struct<start:long,end:long,family:string>>")
