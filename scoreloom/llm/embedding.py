"""Quality by random-indexing word vectors and a two-layer network (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import bytescan as B
from scoreloom.llm.common import fresh, stage

#: Length of a word vector, and the numbers other than 0 in a word's index vector.
DIMS, MARKS = 32, 4
#: Vectors are kept by the first bits of a word's hash: so many words share one. The table has this size whatever the corpus.
SLOT_BITS = 17
#: Neighbours on each side whose index vectors are added to a word's vector.
REACH = 2
#: Labelled documents that the network is fitted on at most, those its temperature is fitted on at most, and its hidden units.
SAMPLE, CALIBRATE, HIDDEN = 20_000, 5_000, 32
THRESHOLD = 0.3
#: Bytes of texts that are read together, and words of them whose vectors are in memory at once: a longer text goes in blocks.
CHUNK, BLOCK = 1 << 18, 1 << 17

#: 1 for bytes of words, 2 for marks, 0 for white space.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word: a run of letters and digits, or of marks."""
    kind = _KIND[data]
    edges = np.unique(np.concatenate([offsets, np.flatnonzero(kind[1:] != kind[:-1]) + 1]))
    starts, ends = edges[:-1], edges[1:]
    full = kind[starts] > 0
    starts, ends = starts[full], ends[full]
    return B.hashes(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1


def index_vectors(h: np.ndarray) -> np.ndarray:
    """A word's index vector: ``MARKS`` numbers 1 or -1 where the bits of its hash say, which may meet, and zeros."""
    out, bits, row = np.zeros((len(h), DIMS), np.int16), B.mix(h), np.arange(len(h))
    for _ in range(MARKS):
        np.add.at(out, (row, (bits % np.uint64(DIMS)).astype(np.int64)), (1 - 2 * ((bits >> np.uint64(8)) & np.uint64(1)).astype(np.int16)))
        bits = bits >> np.uint64(9)
    return out


def context_sums(h: np.ndarray, doc: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words from ``first`` to ``last`` in rising order, and for each the sum of its words' contexts and then their number.

    A context is the sum of the index vectors of the ``REACH`` words on either
    side in the row; those of words that follow are turned by one place, so
    that before and after differ.
    """
    _, at, word = np.unique(h, return_index=True, return_inverse=True)
    index = index_vectors(h[at])
    before, after = index[word], np.roll(index, 1, axis=1)[word]
    context = np.zeros((len(h), DIMS + 1), np.int32)
    context[:, DIMS] = 1
    for lag in range(1, REACH + 1):
        here = (doc[lag:] == doc[:-lag])[:, None]
        context[lag:, :DIMS] += before[:-lag] * here
        context[:-lag, :DIMS] += after[lag:] * here
    slot = (h[first:last] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(slot[order]) > 0]))
    return slot[order][begin], np.add.reduceat(context[first:last][order], begin, axis=0, dtype=np.int64)


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << SLOT_BITS, DIMS + 1), np.int64)
    for batch in batches:
        for _, data, offsets in B.chunks(batch.column(0), CHUNK):
            h, doc = tokens(data, offsets)
            for lo in range(0, len(h), BLOCK):
                begin, end = max(lo - REACH, 0), min(lo + BLOCK, len(h))
                slot, sums = context_sums(h[begin : end + REACH], doc[begin : end + REACH], lo - begin, end - begin)
                total[slot] += sums
    seen = np.flatnonzero(total[:, DIMS])
    for part in np.array_split(seen, max(1, len(seen) // 8192)):
        yield pa.record_batch([pa.array(part.astype(np.int32)), *(pa.array(total[part, k]) for k in range(DIMS + 1))], ["slot", *(f"v{k}" for k in range(DIMS)), "n"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors by slot from the contexts of every word of ``docs``; zeros for slots without a word.

    What all words have in common, the mean context, is taken off first. The
    driver gets the ``2 ** SLOT_BITS`` sums, whatever the size of the corpus.
    """
    names = [f"v{k}" for k in range(DIMS)] + ["n"]
    part = docs.select(F.col(text_col)).mapInArrow(_sum_batches, "slot int, " + ", ".join(f"{c} long" for c in names))
    rows = part.groupBy("slot").agg(*(F.sum(c).cast("double").alias(c) for c in names)).toArrow()
    sums = np.stack([rows[c].to_numpy() for c in names], 1) if rows.num_rows else np.zeros((0, DIMS + 1))
    n = sums[:, DIMS:]
    own = sums[:, :DIMS] - n * (sums[:, :DIMS].sum(0) / max(n.sum(), 1))
    out = np.zeros((1 << SLOT_BITS, DIMS), np.float32)
    if len(sums):
        out[rows["slot"].to_numpy()] = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    return out


#: Mean and spread of the vectors, likeness of a word to the ones before it, and length.
FEATURES = 2 * DIMS + REACH + 1


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` numbers for each text, from all of its words' vectors; zeros without a word."""
    out, size = np.zeros((len(texts), FEATURES)), np.zeros((len(texts), 1))
    mean, square, like = slice(0, DIMS), slice(DIMS, 2 * DIMS), 2 * DIMS - 1
    for first, data, offsets in B.chunks(texts, CHUNK):
        words, rows = tokens(data, offsets)
        for lo in range(0, len(words), BLOCK):
            before = min(lo, REACH)
            h, doc = words[lo - before : lo + BLOCK], rows[lo - before : lo + BLOCK]
            own = vectors[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
            begin = np.flatnonzero(np.concatenate([[True], np.diff(doc[before:]) > 0]))
            row = first + doc[before:][begin]
            out[row, mean] += np.add.reduceat(own[before:], begin, axis=0, dtype=np.float64)
            out[row, square] += np.add.reduceat(own[before:] * own[before:], begin, axis=0, dtype=np.float64)
            for lag in range(1, REACH + 1):
                likeness = np.zeros(len(h))
                likeness[lag:] = np.einsum("ij,ij->i", own[lag:], own[:-lag]) * (doc[lag:] == doc[:-lag])
                out[row, like + lag] += np.add.reduceat(likeness[before:], begin)
            size[row, 0] += np.diff(np.append(begin, len(h) - before))
    out /= np.maximum(size, 1)
    out[:, square] = np.sqrt(np.maximum(out[:, square] - out[:, mean] ** 2, 0))
    out[:, -1] = np.log1p(size[:, 0])
    return out


@dataclass
class Network:
    """Scaling, a layer of tanh units and a logit divided by the temperature; without layers a constant."""

    constant: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        hidden = np.tanh(np.einsum("ij,jk->ik", (x - self.mean) / self.scale, w) + b)  # row by row, so that a text's logit does not depend on its batch
        return np.einsum("ij,j->i", hidden, v) + c[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 40, seed: int = 7) -> Network:
    """Penalised maximum likelihood by Adam over shuffled batches; one class, or no row, gives its smoothed share."""
    if len(set(y.tolist())) < 2:
        return Network(float((y.sum() + 1) / (len(y) + 2)))
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in layers]
    step, size = 0, min(256, len(x))
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x) - size + 1, size):
            rows = order[lo : lo + size]
            w, b, v, c = layers
            hidden = np.tanh(x[rows] @ w + b)
            error = (1 / (1 + np.exp(-np.clip(hidden @ v + c[0], -40, 40))) - y[rows]) / size
            back = np.outer(error, v) * (1 - hidden**2)
            step += 1
            for layer, grad, (m, s) in zip(layers, (x[rows].T @ back + 1e-4 * w, back.sum(0), hidden.T @ error + 1e-4 * v, np.array([error.sum()])), moments, strict=True):
                m += 0.1 * (grad - m)
                s += 0.001 * (grad**2 - s)
                layer -= 0.01 * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Network(0.5, mean, scale, tuple(layers))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits under which ``y`` is likeliest, from 0.05 to 20, by golden section over its logarithm; 1 without rows."""
    if not len(y):
        return 1.0
    loss = lambda t: float(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / np.exp(t)).sum())
    lo, hi, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.network.probability(pooled(texts, self.vectors))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> Classifier:
    """Vectors of all words of ``docs``, and a network fitted on the labelled rows whose crc32 of the id's text mod 5 is not 0.

    Rows of remainder 4 only set the temperature. The network sees at most
    ``SAMPLE`` ids and the temperature at most ``CALIBRATE``, those of least
    hash. An id with several labels is good if all say so; of an id with
    several texts one is taken, always the same. Null ids, texts and labels are
    left out.
    """
    vectors = word_vectors(docs, text_col)
    clean = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    rest = F.crc32(F.col("id").cast("string").cast("binary")) % 5
    clean = clean.withColumn("fold", F.when(rest == 4, 1).when(rest != 0, 0)).where("fold is not null")
    order = [F.xxhash64("id"), F.col("id")]
    some = stage(clean.where("fold = 0").orderBy(*order).limit(SAMPLE).union(clean.where("fold = 1").orderBy(*order).limit(CALIBRATE)), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(0), vectors)
            yield pa.record_batch([*batch.columns[1:], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["id", "y", "fold", "h", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(some), "id")
    rows = rows.select("text", "id", "y", "fold", F.xxhash64("text").alias("h")).mapInArrow(run, "id long, y int, fold int, h long, x array<double>")
    rows = rows.groupBy("id", "y", "fold").agg(F.min_by("x", "h").alias("x")).toPandas().sort_values("id")
    fold, y = rows["fold"].to_numpy(), rows["y"].to_numpy(float)
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, FEATURES))
    network = fit_network(x[fold == 0], y[fold == 0])
    if network.layers:
        network.temperature = fit_temperature(network.logits(x[fold == 1]), y[fold == 1])
    return Classifier(vectors, network)


def with_scores(docs: DataFrame, classifier: Classifier, score_col: str, text_col: str = "text") -> DataFrame:
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(classifier.scores(texts))

    return docs.withColumn(score_col, F.arrow_udf(score, "double")(F.col(text_col)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` in 0 to 1 and ``predicted`` (score of 0.3 or more).

    Word vectors are sums of the random index vectors of neighbours, over every
    word of every row; a text's pooled vectors go through a two-layer network
    whose probability is calibrated by a temperature. Only texts enter a score.
    Nulls and empty texts are scored as texts without a word. A null id is not
    held out. Repeated rows score alike; an empty table gives no rows; labels
    without one of the classes give every row their smoothed share of good ones,
    0.5 without any. Columns of the results' names are replaced.
    """
    (own,) = fresh(docs, "quality_score")
    scored = with_scores(docs, train(docs, labels, id_col, text_col, label_id, label_col), own, text_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    made = [held.alias("held_out"), F.col(own).alias("score"), (F.col(own) >= THRESHOLD).cast("int").alias("predicted")]
    keep = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    return scored.select(*(F.col(f"`{c}`") for c in keep), *made)
