"""Mixing sources to target weights by soft domain membership (operator 3)."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import bytescan as B
from scoreloom.llm.common import fresh, stage

#: Labelled rows that the domain classifier is fitted on at most, and buckets its words are hashed to.
SAMPLE, BUCKETS = 2_000, 1 << 10
#: A gradient of at most this share of the targets ends the descent, and a ridge keeps rates finite where targets are out of reach.
CLOSE, RIDGE = 1e-7, 1e-10
#: Distance from the targets, as a share of all tokens, from which on there is a warning.
FAR = 0.01
#: Share of all tokens that each domain (language, then + for good and - for poor quality) is to have.
TARGETS = {"en+": 0.50, "de+": 0.15, "fr+": 0.15, "es+": 0.12, "en-": 0.04, "de-": 0.015, "fr-": 0.015, "es-": 0.01}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>!")] = True
SHAPE = 4


def _shape(data: np.ndarray, offsets: np.ndarray, found: B.Spans, h: np.ndarray) -> np.ndarray:
    """By row: shares of symbols, capitals and words equal to the one before, and the log of the length."""
    n = np.maximum(np.diff(found.first), 1)[:, None]
    size = np.maximum(np.diff(offsets), 1)
    count = lambda inside: np.diff(np.concatenate([[0], np.cumsum(inside)])[offsets])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (found.doc[1:] == found.doc[:-1])
    repeats = np.diff(np.concatenate([[0], np.cumsum(again)])[found.first])
    return np.stack([10 * count(_SYMBOL[data]) / size, 3 * count((data >= 65) & (data <= 90)) / size, repeats / n[:, 0], np.log1p(n[:, 0]) / 5], 1)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[B.Spans, np.ndarray, np.ndarray]:
    low = B.LOWER[data]
    found = B.words(low, offsets)
    h = B.hashes(low, found.starts, found.ends)
    return found, h, (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _features(texts: pa.Array) -> np.ndarray:
    """Root-scaled shares of word buckets, then the shape."""
    out = np.zeros((len(texts), BUCKETS + SHAPE), np.float32)
    for lo, data, offsets in B.chunks(texts):
        found, h, bucket = _words(data, offsets)
        rows = len(offsets) - 1
        share = np.bincount(found.doc * BUCKETS + bucket, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
        out[lo : lo + rows, :BUCKETS] = share * (BUCKETS**0.5 / np.maximum(np.diff(found.first), 1))[:, None]
        out[lo : lo + rows, BUCKETS:] = _shape(data, offsets, found, h)
    return out


@dataclass
class Domains:
    """Multinomial logistic regression from texts to domain posteriors."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and domain probabilities by text; a text without a word has those of the intercept alone."""
        tokens, logits = np.zeros(len(texts)), np.tile(self.bias, (len(texts), 1))
        by_word = (self.weights[:BUCKETS] * BUCKETS**0.5).astype(np.float32)
        for lo, data, offsets in B.chunks(texts):
            found, h, bucket = _words(data, offsets)
            n = np.diff(found.first)
            full = np.flatnonzero(n)
            tokens[lo : lo + len(n)] = n
            if len(full):
                for k in range(len(self.bias)):
                    total = np.add.reduceat(by_word[bucket, k].astype(np.float64), found.first[:-1][full])
                    logits[lo + full, k] += total / n[full]
                logits[lo + full] += _shape(data, offsets, found, h)[full] @ self.weights[BUCKETS:]
        p = np.exp(logits - logits.max(1, keepdims=True))
        return tokens, p / p.sum(1, keepdims=True)


def fit_domains(x: np.ndarray, y: list[str], names: list[str], steps: int = 250) -> Domains:
    """Penalised maximum likelihood by Adam; without rows the posterior is uniform."""
    w, b = np.zeros((x.shape[1], len(names))), np.zeros(len(names))
    if len(x):
        t = np.eye(len(names))[[names.index(d) for d in y]]
        state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, b)]
        for i in range(1, steps + 1):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - t) / len(x)
            for v, grad, (m, s) in zip((w, b), (x.T @ g + 1e-4 * w, g.sum(0)), state, strict=True):
                m += 0.1 * (grad - m)
                s += 0.001 * (grad**2 - s)
                v -= 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.999**i)) + 1e-9)
    return Domains(names, w, b)


def train_domains(docs: DataFrame, labelled: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text") -> Domains:
    """Fit on at most ``SAMPLE`` rows of ``labelled(id, domain)``, chosen by the id's hash; other domains, null ids and null texts are left out."""
    some = labelled.select(F.col("id").cast("long"), "domain").where(F.col("domain").isin(names)).dropna().groupBy("id").agg(F.min("domain").alias("domain"))
    some = stage(some.orderBy(F.xxhash64("id"), "id").limit(SAMPLE), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(batch.column(0))
            yield pa.record_batch([batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["domain", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(some), "id")
    rows = rows.groupBy("id").agg(F.min("domain").alias("domain"), F.min_by("text", F.xxhash64("text")).alias("text"))  # of an id with several texts, always the same one
    rows = rows.select("text", "domain").mapInArrow(run, "domain string, x array<float>").orderBy("domain", F.xxhash64("x")).toPandas()
    x = np.stack(rows["x"].to_list()).astype(np.float64) if len(rows) else np.zeros((0, BUCKETS + SHAPE))
    return fit_domains(x, rows["domain"].to_list(), names)


def _rate(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Each document's rate: 1 less its part of all gradient steps, projected on the numbers from 0 on."""
    return np.maximum(0.0, 1 - p @ np.sum(steps, axis=0)) if steps else np.ones(len(p))


@dataclass
class Rates:
    """Steps to the documents' rates, and how far the totals stay from the goal, as a share of all tokens."""

    steps: list[np.ndarray]
    residual: float

    def checked(self) -> list[np.ndarray]:
        """The steps; a warning where the targets are out of reach, as when no document belongs to a domain."""
        if self.residual > FAR:
            warnings.warn(f"the mixture is {self.residual:.1%} of all tokens away from its targets", stacklevel=3)
        return self.steps


def fit_rates(table: DataFrame, targets: np.ndarray) -> Rates:
    """Steps of projected-gradient least squares on nonnegative rates, over all of ``table(n_tokens, posterior)``.

    The unknowns are one rate a document. The residual is the expected token
    total by domain less the target share of all tokens; its gradient, scaled by
    a document's tokens, depends on the posterior alone. So gradient steps are
    added up as a vector over domains, and a document's rate is the projection
    of 1 less its product with the posterior: the projection comes after the
    sum of all steps, which makes each rate a function of ``k`` numbers. Seen
    from these, the descent minimises the convex function

        sum of n * max(0, 1 - p.y) ** 2 / 2 + goal.y + ridge * |y| ** 2 / 2

    whose gradient is the residual. A step is scaled by the inverse of its
    curvature, the covariance of the documents with a positive rate, plus a
    damping that falls with every step that brings the function down and rises
    with every other one. The end is the least squares solution, of those the
    one nearest to rates of 1; where targets are out of reach, the ``RIDGE``
    keeps its rates finite. A pass sums ``1 + k + k * k`` numbers over the table.
    """
    k = len(targets)

    def sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column(0).to_numpy(zero_copy_only=False)
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                r = _rate(p, [y])
                gram = (p * (n * (r > 0))[:, None]).T @ p
                yield pa.record_batch([pa.array([[n @ (r * r) / 2, *((n * r) @ p), *gram.ravel()]], pa.list_(pa.float64()))], ["s"])

        parts = table.select("n_tokens", "posterior").mapInArrow(run, "s array<double>")
        row = parts.agg(*(F.sum(F.element_at("s", i + 1)).alias(f"s{i}") for i in range(1 + k + k * k))).first()
        out = np.array([v or 0.0 for v in row])
        return out[1 : 1 + k], out[1 + k :].reshape(k, k), float(out[0])

    y, moved = np.zeros(k), False
    now, gram, value = sums(y)
    tokens = float(now.sum())
    if not tokens:
        return Rates([], 0.0)
    goal, ridge, damping = targets * tokens, RIDGE * np.trace(gram), 1e-6 * np.trace(gram)
    least, most = ridge / 10, 1e6 * np.trace(gram)
    objective = value
    while damping <= most:
        gradient = goal - now + ridge * y
        if np.abs(gradient).sum() <= CLOSE * tokens:
            break
        step = np.linalg.solve(gram + (ridge + damping) * np.eye(k), gradient)  # the steps are taken off
        then, then_gram, then_value = sums(y - step)
        z = y - step
        new = then_value + goal @ z + ridge * (z @ z) / 2
        if new <= objective - 1e-4 * (gradient @ step):
            gain = objective - new
            y, now, gram, objective, damping, moved = z, then, then_gram, new, max(least, damping / 10), True
            if gain <= 1e-13 * abs(objective):
                break
        elif gradient @ step <= 1e-12 * abs(objective):
            break  # nothing left to gain that doubles can tell
        else:
            damping *= 10
    return Rates([y] if moved else [], float(np.abs(now - goal).sum()) / tokens)


def _posterior_table(docs: DataFrame, domains: Domains, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, p = domains.posteriors(batch.column(1))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), pa.array(n), lists], ["doc_id", "n_tokens", "posterior"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage(rows.mapInArrow(run, "doc_id long, n_tokens double, posterior array<double>"), "posteriors")


def document_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, posterior, rate)`` of each row of ``docs``.

    A classifier fitted on ``labelled(id, domain)`` gives every document its
    probability of each domain in ``targets``; the rates are the nonnegative ones
    nearest to 1 whose expected domain token totals come nearest to the targets'
    shares of all tokens. Texts without a word,
    and nulls, have 0 tokens and the rate of the mean posterior; null ids stay
    null; repeated rows each get their rate. Empty tables give no rows, and
    labels without rows leave posteriors uniform.
    """
    domains = train_domains(docs, labelled, list(targets), id_col, text_col)
    rows = _posterior_table(docs, domains, id_col, text_col)
    steps = fit_rates(rows, np.array(list(targets.values())) / sum(targets.values())).checked()

    def rate(posterior: pa.Array) -> pa.Array:
        return pa.array(_rate(posterior.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(domains.names)), steps))

    return rows.withColumn("rate", F.arrow_udf(rate, "double")("posterior"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], rate_col: str = "rate", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``rate_col``, the mean number of times to emit a document; rows of rate 0 go.

    A column of that name is replaced. Scores the texts anew instead of joining
    the rates, which moves no text between executors.
    """
    domains = train_domains(docs, labelled, list(targets), id_col, text_col)
    steps = fit_rates(_posterior_table(docs, domains, id_col, text_col), np.array(list(targets.values())) / sum(targets.values())).checked()

    def rate(texts: pa.Array) -> pa.Array:
        return pa.array(_rate(domains.posteriors(texts)[1], steps))

    (own,) = fresh(docs, "mixing_rate")
    out = docs.withColumn(own, F.arrow_udf(rate, "double")(F.col(text_col))).where(F.col(own) > 0)
    keep = [c for c in docs.columns if c.lower() != rate_col.lower()]
    return out.select(*(F.col(f"`{c}`") for c in keep), F.col(own).alias(rate_col))


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, domain)`` of the labelled documents: language with + for good and - for poor quality."""
    quality = labels.select("doc_id", F.when(F.col("quality") == 1, "+").when(F.col("quality") == 0, "-").alias("sign"))
    return docs.select("doc_id", "lang").join(quality, "doc_id").select(F.col("doc_id").alias("id"), F.concat("lang", "sign").alias("domain"))
