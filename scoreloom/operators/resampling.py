"""Bootstrap replicates of any statistic of sums, and the null distribution of shuffled cluster labels."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.ordering import dense_index, finite
from scoreloom.operators.staging import stage

#: Clusters whose sums are sent to workers at most (8 bytes a sum); beyond that draws are sent to them.
SENT = 2_000_000
#: Neighbouring clusters of a block, whose draws one task adds up: a place inside has two bytes.
BLOCK = 65_536
#: Chance that a Poisson(1) number is at most 0, 1, 2, ...; what is left after 12 is below 1e-9.
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)]))


def keyed_numbers(heads: Sequence[str], tails: Sequence[str]) -> np.ndarray:
    """:func:`scoreloom.functions.keyed.uniform` of each head and tail put together, a row for each tail."""
    tails, out = [t.encode() for t in tails], []
    for head in heads:
        begun, digests = hashlib.sha256(head.encode()).copy, []
        for tail in tails:  # the head is hashed once
            h = begun()
            h.update(tail)
            digests.append(h.digest())
        out.append(np.frombuffer(b"".join(digests), ">u8")[::4] >> np.uint64(12))
    return np.stack(out, axis=1).astype(float) / 4503599627370496.0


def _tail(label: str, own: str) -> Column:
    """What comes after seed and replicate in a row's keys; nulls are left out, as :func:`~pyspark.sql.functions.concat_ws` does."""
    return F.concat_ws("|", F.lit(""), F.col(label), F.col(own)).alias("tail")


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _added(rows: DataFrame, samples: int, seed: str, sums: Sequence[str], add: Callable[[int, np.ndarray, list[np.ndarray]], np.ndarray]) -> DataFrame:
    """``(b, label, <sums>)`` over ``rows(label, tail, ...)``.

    ``add`` makes an array of sums by replicate from a label, the keyed numbers
    of some of its rows and their other columns. A task adds these up and gives
    one row for each label and replicate.
    """
    heads = [f"{seed}|{b}" for b in range(samples)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in _slices(batches):
            labels = batch.column(0).to_numpy()
            for k in np.unique(labels).tolist():
                own = batch.filter(pa.array(labels == k))
                total[k] = total.get(k, 0) + add(k, keyed_numbers(heads, own.column(1).to_pylist()), [c.to_numpy(zero_copy_only=False) for c in own.columns[2:]])
        for k, found in total.items():
            yield pa.record_batch([pa.array(range(samples), pa.int32()), pa.array([k] * samples, pa.int32()), *(pa.array(x.astype(float)) for x in found)], ["b", "label", *sums])

    part = _spread(rows.where("label is not null")).mapInArrow(run, "b int, label int, " + ", ".join(f"`{c}` double" for c in sums))
    return part.groupBy("b", "label").agg(*(F.sum(c).alias(c) for c in sums))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` in many parts alike in size: each is hashed for every replicate, so that a part of few bytes is much work."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _shipped(ranked: DataFrame, sums: Sequence[str], samples: int, seed: str) -> DataFrame:
    """``(b, label, <sums>)`` of the draws from ``ranked(label, idx, idx_n, <sums>)``, whose sums no worker has as a whole.

    Places are dealt to blocks of ``BLOCK``. A task draws for some places and
    replicates and sends each block, in one row, the drawn places inside it, two
    bytes each, and how many are of each replicate; a block adds up its own.
    """
    heads = [f"{seed}|{b}" for b in range(samples)]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 8192):
            labels = batch.column(0).to_numpy()
            for k in np.unique(labels).tolist():
                own = batch.filter(pa.array(labels == k))
                n = own.column(2)[0].as_py()
                at = np.floor(keyed_numbers(heads, own.column(1).to_pylist()).T.ravel() * n).astype(np.int64)  # replicate by replicate
                block, blocks = at // BLOCK, -(-n // BLOCK)
                of = np.bincount(block * samples + np.arange(samples).repeat(own.num_rows), minlength=blocks * samples).reshape(blocks, samples)
                order = np.argsort(block.astype(np.uint16) if blocks < 65536 else block, kind="stable")
                places, ends = (at % BLOCK).astype(np.uint16)[order], of.sum(1).cumsum()
                hit = np.flatnonzero(of.any(1))
                parts = [places[ends[j] - of[j].sum() : ends[j]].tobytes() for j in hit]
                yield pa.record_batch([pa.array([k] * len(hit), pa.int32()), pa.array(hit, pa.int64()), pa.array([of[j].astype(np.uint32).tobytes() for j in hit], pa.binary()), pa.array(parts, pa.binary())], ["label", "block", "counts", "places"])

    def add(drawn: pa.Table, own: pa.Table) -> pa.Table:
        total = np.zeros((len(sums), samples))
        if own.num_rows and drawn.num_rows:
            values = np.zeros((len(sums), BLOCK))
            values[:, own["idx"].to_numpy() % BLOCK] = np.stack([own[c].to_numpy() for c in sums])
            for counts, places in zip(drawn["counts"], drawn["places"], strict=True):
                b = np.arange(samples).repeat(np.frombuffer(counts.as_buffer(), np.uint32))
                at = np.frombuffer(places.as_buffer(), np.uint16)
                total += [np.bincount(b, v[at], samples) for v in values]
        label = (own if own.num_rows else drawn)["label"][0].as_py()
        return pa.table({"b": pa.array(range(samples), pa.int32()), "label": pa.array([label] * samples, pa.int32()), **{c: pa.array(x) for c, x in zip(sums, total, strict=True)}})

    rows = _spread(ranked.where("label is not null").select("label", _tail("label", "idx"), "idx_n"))
    drawn = rows.mapInArrow(draw, "label int, block long, counts binary, places binary")
    own = ranked.select("label", F.floor(F.col("idx") / BLOCK).cast("long").alias("block"), "idx", *sums)
    found = drawn.groupBy("label", "block").cogroup(own.groupBy("label", "block")).applyInArrow(add, "b int, label int, " + ", ".join(f"`{c}` double" for c in sums))
    return found.groupBy("b", "label").agg(*(F.sum(c).alias(c) for c in sums))


def replicate_sums(clusters: DataFrame, sums: Sequence[str], samples: int, seed: str, method: str = "draws") -> DataFrame:
    """``(b, label, <sums>)`` of ``samples`` bootstrap replicates of whole ``clusters(label, cluster_id, <sums>)`` within each label.

    ``draws`` takes as many clusters with replacement as there are, by keyed
    numbers of replicate, label and place, so any engine can repeat it.
    ``poisson`` gives each cluster an independent Poisson(1) weight by its keyed
    number instead. A task makes the numbers of some rows at a time and adds up
    what they stand for: replicates of clusters are never rows. For ``draws`` the
    workers get the clusters' sums, up to ``SENT`` clusters; draws of more are
    sent to the blocks that hold them, to the same result.
    """
    clusters = clusters.withColumn("label", F.col("label").cast("int"))
    values = [F.col(c).cast("double").alias(c) for c in sums]
    if method == "poisson":

        def weighted(_: int, numbers: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
            return np.stack(own) @ np.searchsorted(POISSON, numbers, "right").astype(float)

        return _added(clusters.select("label", _tail("label", "cluster_id"), *values), samples, seed, sums, weighted)
    ranked = stage(dense_index(clusters, "cluster_id", ["label"]).select("label", "idx", "idx_n", *values), "ranked")
    if ranked.count() > SENT:
        return _shipped(ranked, sums, samples, seed)
    table = ranked.orderBy("label", "idx").toArrow().combine_chunks()
    labels, of = table["label"].to_numpy(), np.stack([table[c].to_numpy() for c in sums])
    sent = {int(k): of[:, labels == k] for k in np.unique(labels)}

    def drawn_sums(label: int, numbers: np.ndarray, _: list[np.ndarray]) -> np.ndarray:
        own = sent[label]
        return own[:, np.floor(numbers * own.shape[1]).astype(np.int64)].sum(1)

    return _added(ranked.select("label", _tail("label", "idx")), samples, seed, sums, drawn_sums)


def replicates(rows: DataFrame, sums: Mapping[str, Column], statistics: Callable[[Callable[[str, int], Column]], Mapping[str, Column]], samples: int, seed: str, method: str = "draws") -> DataFrame:
    """``(b, <statistics>)``: any statistics of sums over clusters, of bootstrap replicates of ``rows(label, cluster_id, ...)``.

    ``sums`` are row expressions that are added up by label. ``statistics`` gets
    a function from a sum's name and a label to that sum's column and returns
    the statistics as expressions of these; with ``n`` it finds the row count.
    The statistics of all rows are :func:`statistics_of`.
    """
    clusters = per_cluster(rows, sums)
    by = replicate_sums(clusters, ["n", *sums], samples, seed, method)
    return _wide(by, ["b"], ["n", *sums], statistics)


def per_cluster(rows: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    return rows.groupBy("label", "cluster_id").agg(F.count("*").alias("n"), *(F.sum(v).alias(c) for c, v in sums.items()))


def statistics_of(rows: DataFrame, sums: Mapping[str, Column], statistics: Callable[[Callable[[str, int], Column]], Mapping[str, Column]]) -> DataFrame:
    """One row: the statistics of all ``rows``."""
    return _wide(rows.groupBy("label").agg(F.count("*").alias("n"), *(F.sum(v).alias(c) for c, v in sums.items())), [], ["n", *sums], statistics)


def _wide(by: DataFrame, keys: list[str], sums: list[str], statistics: Callable[[Callable[[str, int], Column]], Mapping[str, Column]]) -> DataFrame:
    wide = by.groupBy(*keys).agg(*(F.sum(F.when(F.col("label") == k, F.col(c))).alias(f"{c}_{k}") for c in sums for k in (0, 1)))
    return wide.select(*keys, *(v.alias(c) for c, v in statistics(lambda c, k: F.col(f"{c}_{k}")).items()))


def intervals(by_replicate: DataFrame, names: Sequence[str], confidence: float) -> DataFrame:
    """One row with ``(lower, upper)`` percentile bounds of each statistic as an array; replicates are few by definition."""
    tail = (1 - confidence) / 2
    return by_replicate.agg(*(F.percentile(c, F.array(F.lit(tail), F.lit(1 - tail))).alias(c) for c in names))


# ---- shuffled cluster labels -------------------------------------------------

#: Rows of a part of the sorted table, and parts whose sums one task adds up at each level.
PART_ROWS, FAN = 20_000, 64


def dividing_numbers(clusters: DataFrame, samples: int, seed: str) -> DataFrame:
    """One row ``cuts``: by replicate, the number up to which clusters are positive, so that as many are as of ``clusters(cluster_id, label)``.

    The keyed numbers of clusters are uniform, so the one that divides them
    lies within eight deviations of its expectation but for a chance below 1e-14
    (then the query fails). Numbers below that window are only counted, and
    those inside, some square root of all, are sorted: replicates of all
    clusters are never ranked or shuffled.
    """
    n, k = clusters.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = k / n if n else 0.0
    width = 8 * (share * (1 - share) / n) ** 0.5 + 8 / n if n else 0.0
    low, high, heads = share - width, share + width, [f"{seed}|{b}" for b in range(samples)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, inside = np.zeros(samples, np.int64), [[] for _ in range(samples)]
        for batch in _slices(batches):
            u = keyed_numbers(heads, batch.column(0).to_pylist())
            below += (u < low).sum(0)
            for b, own in enumerate(((u >= low) & (u < high)).T):
                inside[b].append(u[own, b])
        lists = [np.concatenate(x) if x else np.zeros(0) for x in inside]
        yield pa.record_batch([pa.array(range(samples), pa.int32()), pa.array(below), pa.array(lists, pa.list_(pa.float64()))], ["b", "below", "inside"])

    found = _spread(clusters.select(F.concat_ws("|", F.lit(""), "cluster_id").alias("tail"))).mapInArrow(run, "b int, below long, inside array<double>")
    by = found.groupBy("b").agg(F.sum("below").alias("_below"), F.array_sort(F.flatten(F.collect_list("inside"))).alias("_inside"))
    at = F.get("_inside", (F.lit(k) - F.col("_below") - 1).cast("int"))
    cut = F.lit(-1.0) if k == 0 else F.coalesce(at, F.raise_error(F.lit("no dividing number in the window")).cast("double"))
    return by.select("b", cut.alias("cut")).agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "cut"))), lambda x: x["cut"]).alias("cuts"))


def cluster_bits(clusters: DataFrame, cuts: DataFrame, seed: str) -> DataFrame:
    """``(cluster_id, bits)``: one bit for each replicate, 1 where the cluster is positive."""
    cut = np.array(cuts.first()["cuts"])
    heads = [f"{seed}|{b}" for b in range(len(cut))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            bits = np.packbits(keyed_numbers(heads, [f"|{c}" for c in batch.column(0).to_pylist()]) <= cut, axis=1)
            yield pa.record_batch([batch.column(0), pa.array([x.tobytes() for x in bits], pa.binary())], ["cluster_id", "bits"])

    ids = clusters.select(F.col("cluster_id").cast("string").alias("cluster_id")).where("cluster_id is not null").distinct()
    return _spread(ids).mapInArrow(run, "cluster_id string, bits binary")


def prefix_sums(parts: DataFrame, order: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``parts(<keys>, <order>, <values>)`` with ``<v>_before``: the sum of the values before, by the whole number ``order`` from 0.

    A tree: ``FAN`` neighbours are added up to a node of the next level, the
    nodes' own sums before are found in the same way, and inside a node a window
    adds those of its few members. No task sees more than ``FAN`` rows of a key.
    """
    keys, up, top = list(keys), f"{order}_up", parts.agg(F.max(order)).first()[0]
    inside = Window.partitionBy(*keys, up).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn(up, F.floor(F.col(order) / FAN).cast("long"))
    own = {f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    if top is None or top < FAN:
        return parts.withColumns(own).drop(up)
    nodes = stage(parts.groupBy(*keys, up).agg(*(F.sum(v).alias(v) for v in values)), "nodes")
    above = prefix_sums(nodes, up, values, keys).select(*keys, up, *(F.col(f"{v}_before").alias(f"{v}_above") for v in values))
    out = parts.withColumns(own).join(above, [*keys, up])
    return out.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"{v}_above") for v in values}).drop(up, *(f"{v}_above" for v in values))


def null_accuracies(rows: DataFrame, clusters: DataFrame, samples: int, seed: str) -> DataFrame:
    """``(b, oracle_ba)`` of ``rows(cluster_id, score)``, of which in each replicate as many ``clusters(cluster_id, label)`` are positive as really are.

    Equal rows are counted first. Their counts are dealt by ranges of score and
    cluster, so a score that all rows share goes to many parts, with a bit for
    each replicate. A part gives its positives by replicate; :func:`prefix_sums`
    turns these into the positives before each part, and then each part its
    largest gap of the class distributions, at the last row of each score only.
    A score that goes over parts counts in the last of them. Nothing is
    collected, and what a task holds depends on ``PART_ROWS`` and the number of
    replicates alone.
    """
    counts = rows.where(finite(F.col("score"))).groupBy("score", "cluster_id").agg(F.count("*").alias("c"))
    counts = stage(counts.join(cluster_bits(clusters, dividing_numbers(clusters, samples, seed), seed), "cluster_id").select("score", "cluster_id", "c", "bits"), "bits")
    n = -(-counts.count() // PART_ROWS) or 1
    placed = stage(counts.repartitionByRange(n, "score", "cluster_id").select("score", "c", "bits", F.spark_partition_id().cast("long").alias("part")), "ranges")

    def blocks(part: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
        """Some replicates at a time: each row's count where it is positive."""
        bits = np.frombuffer(b"".join(part["bits"].to_pylist()), np.uint8).reshape(part.num_rows, -1)
        c = part["c"].to_numpy()[:, None]
        for k in range(0, samples, 128):
            end = min(k + 128, samples)
            yield slice(k, end), np.unpackbits(bits[:, k // 8 : -(-end // 8)], axis=1, count=end - k) * c

    def sums(part: pa.Table) -> pa.Table:
        score, p = part["score"].to_numpy(), np.zeros(samples, np.int64)
        for own, x in blocks(part):
            p[own] = x.sum(0)
        one = lambda x: pa.array([x] * samples)
        return pa.table({"part": one(part["part"][0].as_py()), "b": pa.array(range(samples), pa.int32()), "p": pa.array(p), "n": one(int(part["c"].to_numpy().sum())), "low": one(float(score.min())), "high": one(float(score.max()))})

    parts = stage(placed.groupBy("part").applyInArrow(sums, "part long, b int, p long, n long, low double, high double"), "parts")
    ends = parts.where("b = 0").select("part", F.explode(F.array("low", "high")).alias("score")).groupBy("score").agg(F.max("part").alias("last"))
    open_ = parts.where("b = 0").select("part", F.col("high").alias("score")).join(ends, "score").where("part < last").select("part", F.lit(True).alias("goes_on"))
    total = parts.groupBy("b").agg(F.sum("p").alias("p_all"), F.sum("n").alias("n_all"))
    before = prefix_sums(parts, "part", ["p", "n"], ["b"]).join(total, "b")
    each = F.transform(F.array_sort(F.collect_list(F.struct("b", "p_before", "p_all"))), lambda x: F.struct(x["p_before"], x["p_all"]))
    before = before.groupBy("part").agg(each.alias("x"), F.max("n_before").alias("n_before"), F.max("n_all").alias("n_all")).join(open_, "part", "left")
    before = before.select("part", F.transform("x", lambda x: x["p_before"]).alias("p_before"), F.transform("x", lambda x: x["p_all"]).alias("p_all"), "n_before", "n_all", "goes_on")

    def gaps(part: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(part["score"].to_numpy(), kind="stable")
        part = part.take(pa.array(order))
        score = part["score"].to_numpy()
        last = np.append(score[1:] != score[:-1], not known["goes_on"][0].as_py())
        p_before, p_all = (known[c].combine_chunks().flatten().to_numpy() for c in ("p_before", "p_all"))
        n_before, n_all = known["n_before"][0].as_py(), known["n_all"][0].as_py()
        n_to, gap = (np.cumsum(part["c"].to_numpy())[last] + n_before)[:, None], np.zeros(samples)
        with np.errstate(invalid="ignore", divide="ignore"):
            for own, x in blocks(part):
                p_to = np.cumsum(x, axis=0)[last] + p_before[own]
                gap[own] = np.abs(p_to / p_all[own] - (n_to - p_to) / (n_all - p_all[own])).max(0, initial=0)
        alone = (p_all == 0) | (p_all == n_all)
        return pa.table({"b": pa.array(np.flatnonzero(~alone).astype(np.int32)), "gap": pa.array(gap[~alone])})

    found = placed.groupBy("part").cogroup(before.groupBy("part")).applyInArrow(gaps, "b int, gap double")
    return found.groupBy("b").agg(((1 + F.max("gap")) / 2).alias("oracle_ba"))
