"""Toxicity by class-conditional Kneser-Ney models (operator 10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm import bytescan as B
from scoreloom.llm.common import fresh, stage

#: Symbols of the longest gram. A symbol is a byte of a word, or one of the two that stand before and after a word.
ORDER, FIRST, LAST = 7, 1, 2
DISCOUNT, SYMBOLS = 0.75, 256
#: Documents' worth of the shared model in each class model of a context.
SHARED = 32.0
#: Most suspicious distinct words whose mean is a feature each.
MOST = (1, 3)
#: Log-likelihood ratios are kept as whole multiples of one part in so many, so that sums don't depend on their order.
UNIT = 1 << 12
#: Rows of the model that are sent to workers at once (16 to 20 bytes each); a larger model is sent in slices, one after the other.
SLICE = 4_000_000
#: Labelled documents used at most to calibrate the score, and label rows up to which labels are broadcast.
CALIBRATE, BROADCAST_LABELS = 20_000, 500_000
THRESHOLD = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: A gram is a long: its bytes, the first one lowest, and its length above them. SQL for what follows from gram ``g``:
#: its length, itself without its first ``k`` symbols, and without its last one.
_SIZE = "shiftright(g, 56)"
_SHORTER = f"shiftright(g & {(1 << 56) - 1}L, 8 * k) + shiftleft({_SIZE} - k, 56)"
_CONTEXT = f"(g & (shiftleft(1L, cast(8 * ({_SIZE} - 1) as int)) - 1)) + shiftleft({_SIZE} - 1, 56)"
#: Slices of the model are chosen by the rest of a gram by this prime.
_PRIME = 16_777_213


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, B.Spans]:
    """The bytes with A-Z and the Latin-1 letters in lower case, and the runs of letters and digits in them."""
    low = B.LOWER[data]
    wide = np.flatnonzero(low[:-1] == 0xC3) + 1
    wide = wide[(low[wide] >= 0x80) & (low[wide] <= 0x9E) & (low[wide] != 0x97)]
    low[wide] += 0x20
    return low, B.spans(_LETTER[low], offsets)


def grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol after the first of each word, the gram that ends there, and its word.

    It has ``ORDER`` symbols, or goes back to the word's beginning.
    """
    size = ends - starts + 2
    over = np.cumsum(size)
    first = over - size
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(word))
    symbols = np.zeros(len(word) + 8, np.uint8)
    symbols[7:-1] = low[np.clip(np.repeat(starts - 1 - first, size) + at, 0, max(len(low) - 1, 0))] if len(word) else 0
    symbols[7 + first], symbols[6 + over] = FIRST, LAST
    back = at - first[word] + 1
    keep = back > 1
    length = np.minimum(back[keep], ORDER).astype(np.uint64)
    last8 = np.ndarray((len(word),), "<u8", symbols.data, strides=(1,))[keep] if len(word) else np.zeros(0, np.uint64)
    return (last8 >> (np.uint64(8) * (np.uint64(8) - length))) | (length << np.uint64(56)), word[keep]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.concatenate([c for _, c in parts])
    return keys, np.stack([np.bincount(where, counts[:, k], len(keys)) for k in range(counts.shape[1])], 1).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' distinct words by the grams in them, by class (column 1) and fold (column 2)."""

    def rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = _merged(parts)
        return pa.record_batch([pa.array(keys.view(np.int64)), *(pa.array(counts[:, k].copy()) for k in range(4))], ["g", "o0", "o1", "t0", "t1"])

    for batch in batches:
        kind = 2 * batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) + batch.column(2).to_numpy(zero_copy_only=False)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, data, offsets in B.chunks(batch.column(0)):
            low, found = words(data, offsets)
            h = B.hashes(low, found.starts, found.ends)
            order = np.lexsort((h, found.doc))
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (found.doc[order][1:] != found.doc[order][:-1])
            once = order[new]  # a document counts each of its words once
            distinct, at, where = np.unique(h[once], return_index=True, return_inverse=True)
            by_word = np.bincount(where * 4 + kind[lo:][found.doc[once]], minlength=4 * len(distinct)).reshape(-1, 4)
            key, word = grams(low, found.starts[once[at]], found.ends[once[at]])
            if len(key):
                parts.append(_merged([(key, by_word[word])]))
            if sum(len(k) for k, _ in parts) > 1_000_000:
                yield rows(parts)
                parts = []
        if parts:
            yield rows(parts)


def count_grams(labelled: DataFrame) -> DataFrame:
    """``(g, o0, o1, t0, t1)``: how often ordinary and toxic documents of both folds have a gram, over all of ``labelled(text, toxic, fold)``."""
    part = labelled.select("text", F.col("toxic").cast("int"), F.col("fold").cast("int")).mapInArrow(_count_batches, "g long, o0 long, o1 long, t0 long, t1 long")
    return stage(part.groupBy("g").agg(*(F.sum(c).alias(c) for c in ("o0", "o1", "t0", "t1"))), "grams")


def shared_levels(counts: DataFrame) -> DataFrame:
    """``(g, a, b)`` for every gram that continues to the left: its discounted share of its context, and the context's mass for shorter ones.

    The counts are Kneser-Ney's continuation counts, pooled over the classes:
    the number of distinct grams, one symbol longer, that end in ``g``.
    """
    every = counts.select(F.expr(f"explode(transform(sequence(0, cast({_SIZE} as int) - 1), k -> {_SHORTER}))").alias("g")).distinct()
    ends = every.where(f"{_SIZE} > 1").groupBy(F.expr(_SHORTER.replace("k", "1")).alias("g")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("h")
    ends = ends.withColumn("h", F.expr(_CONTEXT)).withColumn("all", F.sum("n").over(own)).withColumn("kinds", F.count("*").over(own))
    return ends.select("g", ((F.col("n") - DISCOUNT) / F.col("all")).alias("a"), (DISCOUNT * F.col("kinds") / F.col("all")).alias("b"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """``(g, ratio, other)``: ln of the toxic over the ordinary probability of each gram's last symbol, in ``UNIT``s; ``other`` by the classes of fold 0 alone.

    With ``n`` documents' words of both classes that have the gram, ``N`` and
    ``K`` the sum and number of such grams of its context, and ``p`` the
    probability by the next shorter context, the shared Kneser-Ney model is
    ``(n - D) / N + D * K / N * p``; for the shorter grams the counts are the
    continuation counts of :func:`shared_levels`, down to the uniform
    distribution. A class model divides the first part, the discounted counts,
    as the class does, with ``SHARED`` documents' worth of the shared division
    added; the mass ``D * K / N`` that goes to shorter grams, and what these say,
    are shared. So a symbol never seen after its context has one probability in
    both models, and needs no row, and the fewer documents a gram has, the more
    the shared counts speak for it.
    """
    levels = stage(shared_levels(counts), "levels")
    below = counts.select(F.col("g").alias("top"), F.expr(f"explode(transform(sequence(1, cast({_SIZE} as int) - 1), k -> {_SHORTER}))").alias("g"))
    short = F.broadcast(levels.where(f"{_SIZE} <= 2"))  # at most 2 ** 8 + 2 ** 16 rows
    steps = below.where(f"{_SIZE} <= 2").join(short, "g").union(below.where(f"{_SIZE} > 2").join(levels.where(f"{_SIZE} > 2"), "g"))
    steps = steps.groupBy(F.col("top").alias("g")).agg(F.array_sort(F.collect_list(F.struct(F.expr(_SIZE).alias("k"), "a", "b"))).alias("steps"))
    shorter = steps.select("g", F.aggregate("steps", F.lit(1.0 / SYMBOLS), lambda p, x: x["a"] + x["b"] * p).alias("p"))
    own = Window.partitionBy(F.expr(_CONTEXT))
    n = F.col("o0") + F.col("o1") + F.col("t0") + F.col("t1")
    full = counts.join(shorter, "g").withColumn("n", n).withColumn("keep", 1 - DISCOUNT / F.col("n"))
    full = full.withColumn("all", F.sum("n").over(own)).withColumn("mass", DISCOUNT * F.count("*").over(own) / F.col("all"))
    part = (F.col("n") - DISCOUNT) / (F.col("all") * (1 - F.col("mass")))

    def of_class(count: Column) -> Column:
        held = count * F.col("keep")
        return (1 - F.col("mass")) * (held + SHARED * part) / (F.sum(held).over(own) + SHARED) + F.col("mass") * F.col("p")

    def ratio(toxic: Column, ordinary: Column) -> Column:
        return F.round(F.ln(of_class(toxic) / of_class(ordinary)) * UNIT).cast("int")

    every = ratio(F.col("t0") + F.col("t1"), F.col("o0") + F.col("o1"))
    return stage(full.select("g", every.alias("ratio"), ratio(F.col("t0"), F.col("o0")).alias("other")), "ratios")


@dataclass
class Table:
    """Ratios by the gram's mixed bits in rising order; ``first`` is where those of each beginning of ``bits`` bits start."""

    keys: np.ndarray
    ratio: np.ndarray
    first: np.ndarray
    bits: int

    def of(self, g: np.ndarray) -> np.ndarray:
        """The ratio of each gram, 0 where the table has none."""
        h = B.mix(g)
        part = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[part], self.first[part + 1]
        out = np.zeros(len(h), np.int32)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == h[left]
            found = left[hit]
            out[found] = self.ratio[at[found]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def scoring_table(ratios: DataFrame) -> Table:
    """The table of all of ``ratios(g, ratio)``: 12 bytes each and 4 to 8 for the index."""
    rows = ratios.select("g", "ratio").toArrow()
    keys, at = np.unique(B.mix(rows["g"].to_numpy().view(np.uint64)), return_index=True)
    bits = max(1, len(keys).bit_length())
    sizes = np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return Table(keys, rows["ratio"].to_numpy()[at].astype(np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), bits)


@dataclass
class Chunk:
    """Words of consecutive rows: row bounds, distinct words by row (``row``, ``word``), and each distinct word's symbols and grams."""

    lo: int
    first: np.ndarray
    row: np.ndarray
    word: np.ndarray
    symbols: np.ndarray
    key: np.ndarray
    key_word: np.ndarray


def _chunks(texts: pa.Array) -> Iterator[Chunk]:
    for lo, data, offsets in B.chunks(texts):
        low, found = words(data, offsets)
        _, at, where = np.unique(B.hashes(low, found.starts, found.ends), return_index=True, return_inverse=True)
        row, word = np.divmod(np.unique(found.doc * max(len(at), 1) + where), max(len(at), 1))
        key, key_word = grams(low, found.starts[at], found.ends[at])
        yield Chunk(lo, np.searchsorted(row, np.arange(len(offsets))), row, word, found.ends[at] - found.starts[at] + 1, key, key_word)


def features(c: Chunk, ratio: np.ndarray) -> np.ndarray:
    """By row, from the ratios of its distinct words: their sum by symbols, and the mean of the ``MOST`` highest; zeros without a word."""
    rows = len(c.first) - 1
    by_word = ratio / UNIT
    out = np.zeros((rows, 1 + len(MOST)))
    out[:, 0] = np.bincount(c.row, by_word, rows) / np.maximum(np.bincount(c.row, c.symbols[c.word], rows), 1)
    total = np.concatenate([[0.0], np.cumsum(by_word[np.lexsort((-by_word, c.row))])])
    for j, k in enumerate(MOST, 1):
        out[:, j] = (total[np.minimum(c.first[:-1] + k, c.first[1:])] - total[c.first[:-1]]) / k
    return out


def _over_model(docs: DataFrame, model: DataFrame, column: str, name: str, finish: Callable[[np.ndarray], pa.Array], kind: str, text_col: str) -> DataFrame:
    """``docs`` with column ``name``: ``finish`` of the features by ``column`` of the model.

    The model goes to workers in slices of about ``SLICE`` rows, chosen by the
    gram. Each adds its part of every distinct word's ratio to what the slices
    before it gave, which is written between them; all but a large model have
    one slice.
    """
    slices = -(-model.count() // SLICE) or 1
    (so_far,) = fresh(docs, "so_far")
    rows = model.select("g", F.col(column).alias("ratio"), (F.col("g") % _PRIME % slices).alias("part"))
    out = docs
    for k in range(slices):
        table = scoring_table(rows.where(F.col("part") == k))
        last = k == slices - 1

        def run(texts: pa.Array, before: pa.Array | None = None, table: Table = table, k: int = k, last: bool = last) -> pa.Array:
            parts, sizes = [], [np.zeros(1, np.int64)]
            bounds = before.value_lengths().fill_null(0).to_numpy().cumsum() if before is not None else None
            earlier = before.flatten().to_numpy() if before is not None else None
            for c in _chunks(texts):
                own = np.flatnonzero(c.key % np.uint64(_PRIME) % np.uint64(slices) == k) if slices > 1 else slice(None)
                ratio = np.bincount(c.key_word[own], table.of(c.key[own]), len(c.symbols))[c.word]
                if before is not None:
                    begin = bounds[c.lo - 1] if c.lo else 0
                    ratio = ratio + earlier[begin : begin + len(ratio)]
                parts.append(features(c, ratio) if last else ratio)
                sizes.append(np.diff(c.first))
            if last:
                return finish(np.concatenate([np.zeros((0, 1 + len(MOST))), *parts]))
            cuts = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
            return pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0), *parts]).astype(np.int32)))

        udf = F.arrow_udf(_with_types(run, bool(k)), kind if last else "array<int>")
        out = out.withColumn(name if last else so_far, udf(F.col(text_col), F.col(so_far)) if k else udf(F.col(text_col)))
        out = out if last else stage(out, "slice")
    return out.drop(so_far)


def _with_types(run: Callable, two: bool) -> Callable:
    """``run`` with as many arguments as columns, and the type hints by which Spark knows the kind of function."""

    def one_column(texts: pa.Array) -> pa.Array:
        return run(texts)

    def two_columns(texts: pa.Array, before: pa.Array) -> pa.Array:
        return run(texts, before)

    return two_columns if two else one_column


@dataclass
class Classifier:
    model: DataFrame
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self) -> Callable[[np.ndarray], pa.Array]:
        mean, scale, weights = self.mean, self.scale, self.weights
        return lambda x: pa.array(1 / (1 + np.exp(-np.clip(weights[0] + ((x - mean) / scale) @ weights[1:], -40, 40))))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """Newton fit with an unpenalised intercept in front."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [penalty * max(1, len(x)) ** 0.5] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> Classifier | None:
    """Fit on the labelled rows of ``docs`` whose crc32 of the id's text mod 3 is not 1; None if a class is missing.

    Counts cover all these rows. The calibration sees at most ``CALIBRATE``
    rows of one fold, scored by class counts of the other fold, so that it
    meets texts as unknown as later ones. An id with several label rows is
    toxic if one of them says so; null ids, texts and labels are left out.
    """
    clean = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    rest = F.crc32(F.col("id").cast("string").cast("binary")) % 3
    clean = stage(clean.where(rest != 1).withColumn("fold", (rest == 2).cast("int")), "labels")
    n = clean.count()
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    labelled = own.join(F.broadcast(clean) if n <= BROADCAST_LABELS else clean, "id")
    counts = count_grams(labelled)
    seen = counts.agg(*(F.sum(c) for c in ("o0", "o1", "t0", "t1"))).first()
    if any(x is None for x in seen) or not (seen[0] + seen[1] and seen[2] + seen[3]):
        return None
    model = log_ratios(counts)
    held = clean.where("fold = 1")
    held = held.orderBy(F.xxhash64("id")).limit(CALIBRATE) if held.count() > CALIBRATE else held
    lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
    rows = own.join(F.broadcast(held), "id").select("text", "toxic")
    rows = _over_model(rows, model, "other" if seen[0] and seen[2] else "ratio", "x", lists, "array<double>", "text").select("toxic", "x").toPandas()
    y = rows["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        k = len(MOST)
        return Classifier(model, np.zeros(1 + k), np.ones(1 + k), np.array([-2.0, 4.0, *([1.0] * k)]))
    x = np.stack(rows["x"].to_list())
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Classifier(model, mean, scale, logistic((x - mean) / scale, y))


def with_scores(docs: DataFrame, classifier: Classifier | None, score_col: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score_col``; nulls and empty texts are scored as texts without a word, all texts 0.0 without a classifier."""
    if classifier is None:
        return docs.withColumn(score_col, F.lit(0.0))
    return _over_model(docs, classifier.model, "ratio", score_col, classifier.probability(), "double", text_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` in 0 to 1 and ``predicted`` (score of 0.7 or more).

    One Kneser-Ney model of the symbols of words for toxic and one for ordinary
    texts, with shared backoff counts (see :func:`log_ratios`). The difference
    of a text's log-likelihoods, over its distinct words and divided by their
    symbols, and the difference at its most suspicious words, are calibrated to
    a probability. Only texts enter a score. A null id is not held out. Repeated
    rows score alike; an empty table, or labels without one of the classes, give
    rows scored 0. Columns of the results' names are replaced.
    """
    scored = with_scores(docs, train(docs, labels, id_col, text_col, label_id, label_col), "score", text_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored 0.7 or more by a classifier fitted on ``labelled``; columns stay as they are."""
    (score,) = fresh(docs, "score")
    return with_scores(docs, train(labelled, labels), score, text_col).where(F.col(score) < THRESHOLD).drop(score)
