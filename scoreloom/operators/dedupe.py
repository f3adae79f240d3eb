"""Near duplicates by Hamming distance, greedy removal, and grouped splitting."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.staging import stage

SPLITS = ("fit", "calibration", "eval")
#: Members of a band bucket up to which it is joined pair by pair.
PAIRWISE = 128


def hash_bits(hexadecimal: Column) -> Column:
    """A hash of 16 hex digits as 64 bits (signed)."""
    return F.conv(hexadecimal, 16, -10).cast("long")


def _cuts(width: int, distance: int) -> list[tuple[int, int]]:
    """``distance + 1`` bands of ``width`` bits."""
    cuts = [round(i * width / (distance + 1)) for i in range(distance + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def _part(bits: Column, lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(bits, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1))


def _key(parts: list[Column]) -> Column:
    """One value of a band's parts: of several words a hash, which adds candidates at most."""
    return parts[0] if len(parts) == 1 else F.xxhash64(*parts)


def _finer(lo: int, hi: int, distance: int, words: list[str]) -> list[Column]:
    """Bands of the bits outside ``lo`` to ``hi`` of each word, moved together."""
    rest = [_part(F.col(w), 0, lo) if lo else F.lit(0).cast("long") for w in words]
    if hi < 64:
        rest = [r.bitwiseOR(F.shiftleft(_part(F.col(w), hi, 64), lo)) for r, w in zip(rest, words, strict=True)]
    return [F.struct(F.lit(i).alias("band2"), _key([_part(r, a, b) for r in rest]).alias("value2")) for i, (a, b) in enumerate(_cuts(64 - hi + lo, distance))]


def _bands(rows: DataFrame, distance: int, words: list[str]) -> DataFrame:
    """Each row under the value of each of distance + 1 bands: pairs within the distance share one."""
    band = [F.struct(F.lit(i).alias("band"), _key([_part(F.col(w), lo, hi) for w in words]).alias("value")) for i, (lo, hi) in enumerate(_cuts(64, distance))]
    return rows.select("id", *words, F.inline(F.array(*band)))


def hamming_pairs(rows: DataFrame, distance: int, more: str | None = None) -> DataFrame:
    """All pairs ``(a, b, distance)`` of distinct values of ``rows(id, bits)`` within ``distance``, a before b.

    Rows of equal bits are one node, named by their least id; expand them by
    joining ``bits`` back. Bands make the join lossless, the exact predicate
    follows. The members of a bucket of more than ``PAIRWISE`` nodes are not
    paired: what is left of their bits is cut into as many bands again, one of
    which two members within the distance also share.

    Among millions of rows some unrelated 64 bits are within a few of each other
    by chance. With ``more``, the column of a second word, a hash is of 128 bits,
    and ``distance`` is over both words.
    """
    words = ["bits"] if more is None else ["bits", more]
    nodes = rows.groupBy(*words).agg(F.min("id").alias("id"))
    banded = _bands(nodes, distance, words)
    sizes = stage(banded.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1"), "bands")  # so that the joins can split a hot bucket
    live = stage(banded.join(sizes, ["band", "value"]), "buckets")
    few = live.where(F.col("n") <= PAIRWISE).select("id", *words, "band", "value", F.lit(0).alias("band2"), F.lit(0).cast("long").alias("value2"))
    many = live.where(F.col("n") > PAIRWISE)
    finer = F.when(F.lit(False), F.array(*_finer(0, 64, distance, words)))
    for i, (lo, hi) in enumerate(_cuts(64, distance)):
        finer = finer.when(F.col("band") == i, F.array(*_finer(lo, hi, distance, words)))
    keys = ["band", "value", "band2", "value2"]
    left = few.union(many.select("id", *words, "band", "value", F.inline(finer)))
    right = left.select(F.col("id").alias("b"), *(F.col(w).alias(f"b_{w}") for w in words), *keys)
    d = reduce(add, (F.bit_count(F.col(w).bitwiseXOR(F.col(f"b_{w}"))) for w in words))
    found = left.join(right, keys).where("id < b").where(d <= distance)
    return found.select(F.col("id").alias("a"), "b", d.alias("distance")).distinct()


def keep_earliest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ``nodes(id)`` that a scan in order keeps: those without a kept earlier neighbour; ``edges(a, b)`` go from earlier to later.

    Rounds keep nodes whose earlier neighbours are all dropped and drop the
    later neighbours of kept ones, until none is undecided.
    """
    kept = nodes.join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti").select("id")
    dropped = edges.join(kept.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct()
    state = stage(kept.select("id", F.lit(True).alias("keep")).union(dropped.select("id", F.lit(False))), "state")
    while True:
        left = stage(edges.join(state.select(F.col("id").alias("b")), "b", "left_anti").join(state.where("not keep").select(F.col("id").alias("a")), "a", "left_anti"), "open")
        todo = nodes.join(state, "id", "left_anti").select("id")
        if not todo.limit(1).count():
            return state.where("keep").select("id")
        kept = todo.join(left.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        state = state.union(kept.select("id", F.lit(True)))
        dropped = edges.join(kept.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct().join(state, "id", "left_anti")
        state = stage(state.union(dropped.select("id", F.lit(False))), "state")


def greedy_dedupe(rows: DataFrame, distance: int, more: str | None = None) -> DataFrame:
    """``rows(id, bits)`` that a scan in id order would keep: those without a kept earlier row within ``distance``.

    Not components: a row near only to a dropped row stays (see
    :func:`keep_earliest`). Rows without bits are excluded. Equal bits are
    decided without pairs: only the least id can stay. ``more`` is the second
    word of hashes of 128 bits (see :func:`hamming_pairs`).
    """
    words = ["bits"] if more is None else ["bits", more]
    rows = rows.dropna(subset=words)
    nodes = stage(rows.groupBy(*words).agg(F.min("id").alias("id")), "nodes")
    edges = stage(hamming_pairs(nodes, distance, more).select("a", "b"), "edges")
    return rows.join(keep_earliest(nodes, edges), "id", "left_semi")


def greedy_assignment(counts: DataFrame, ratios: tuple[float, float, float], group: str = "grp") -> DataFrame:
    """Whole groups of ``counts(group, n)``, largest first (ties by name), each to the split furthest below its share.

    Groups are few by nature (sources or generators); they are folded in one
    row. Equal deficits go to the earlier of fit, calibration, eval.
    """
    ordered = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(group).alias("g")))).alias("gs"), F.sum("n").alias("total"))
    zero = F.struct(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("now"), F.array().cast("array<struct<g:string,s:int>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        gap = [F.col("total") * r - F.get(state["now"], i) for i, r in enumerate(ratios)]
        best = F.when((gap[0] >= gap[1]) & (gap[0] >= gap[2]), 0).when(gap[1] >= gap[2], 1).otherwise(2)
        now = F.transform(state["now"], lambda v, i: F.when(i == best, v - x["m"]).otherwise(v))
        return F.struct(now.alias("now"), F.concat(state["out"], F.array(F.struct(x["g"].alias("g"), best.alias("s")))).alias("out"))

    made = ordered.select(F.inline(F.aggregate("gs", zero, step)["out"]))
    return made.select(F.col("g").alias(group), F.get(F.array(*map(F.lit, SPLITS)), F.col("s")).alias("split"))


def bucket_split(hexadecimal: Column, ratios: dict[str, float] | None = None) -> Column:
    """Split by the hash as an unsigned number: 5, 2 and 3 tenths, or thousandths against the cumulative ``ratios``."""
    value = F.conv(hexadecimal, 16, 10).cast("decimal(20,0)")
    if ratios is None:
        tenth = value % 10
        return F.when(tenth < 5, "fit").when(tenth < 7, "calibration").otherwise("eval")
    unit, total, out = (value % 1000).cast("double") / 1000, 0.0, None
    for name, r in list(ratios.items())[:-1]:
        total += r / sum(ratios.values())
        out = F.when(unit < total, name) if out is None else out.when(unit < total, name)
    last = F.lit(list(ratios)[-1])
    return last if out is None else out.otherwise(last)


def cross_split_drop(rows: DataFrame, order: str, digest: str = "digest", split: str = "split") -> DataFrame:
    """Rows whose split is that of the first row with the same hash."""
    first = rows.groupBy(digest).agg(F.min_by(split, order).alias("_first"))
    return rows.join(first, digest).where(F.col(split) == F.col("_first")).drop("_first")


def split_summary(rows: DataFrame, group: str = "grp") -> DataFrame:
    """Rows and groups by split, and how many groups are in other splits as well."""
    spread = rows.groupBy(group).agg(F.countDistinct("split").alias("n_splits"))
    return rows.join(spread, group).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct(group).alias("n_groups"), F.countDistinct(F.when(F.col("n_splits") > 1, F.col(group))).alias("n_crossing"))


def keep_first_boxes(boxes: DataFrame, least_overlap: float = 0.8, cell: float = 256.0, page: str = "page") -> DataFrame:
    """Pairs ``(keeper, suppressed)`` of ``boxes(page, id, rank, x0, y0, x1, y1)`` whose smaller one is covered by ``least_overlap`` or more.

    Boxes of a page meet in the grid cells they touch, and a pair is reported in its
    first common cell only.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("int"), F.floor(F.col(b) / cell).cast("int"))
    cells = boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    other = cells.select(*(F.col(c).alias(f"o_{c}") for c in ("id", "rank", "x0", "y0", "x1", "y1")), page, "cx", "cy")
    edge = lambda lo, hi: F.greatest(F.lit(0.0), F.least(hi, f"o_{hi}") - F.greatest(lo, f"o_{lo}"))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    overlap = edge("x0", "x1") * edge("y0", "y1") / F.nullif(F.least(area(""), area("o_")), F.lit(0.0))
    home = (F.col("cx") == F.floor(F.greatest("x0", "o_x0") / cell)) & (F.col("cy") == F.floor(F.greatest("y0", "o_y0") / cell))
    pairs = cells.join(other, [page, "cx", "cy"]).where((F.col("rank") < F.col("o_rank")) & home).where(overlap >= least_overlap)
    return pairs.select(F.col("id").alias("keeper"), F.col("o_id").alias("suppressed"), overlap.alias("overlap"))


def suppressed_boxes(boxes: DataFrame, least_overlap: float = 0.8, page: str = "page") -> DataFrame:
    """``boxes`` that stay when they are taken by rank and one that a kept box covers goes: a box covered only by one that went stays."""
    pairs = keep_first_boxes(boxes, least_overlap, page=page)
    edges = stage(pairs.select(F.col("keeper").alias("a"), F.col("suppressed").alias("b")), "edges")
    return boxes.join(keep_earliest(stage(boxes.select("id"), "boxes"), edges), "id", "left_semi")


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of greatest ``order`` for each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("m")).select(*keys, "m.*")


def newest(rows: DataFrame, order: str, keep: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` rows of greatest ``order`` (by key), as a bounded cache holds them."""
    if not keys:
        return rows.orderBy(F.desc(order)).limit(keep)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_r") <= keep).drop("_r")
