"""Exact quantiles by distributed selection: brackets around the wanted ranks, narrowed until few rows are left in them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.staging import stage

#: Rows of a bracket up to which its values are gathered and sorted, and the error of its approximate bounds as one part in so many.
GATHERED, ACCURACY = 2_000, 1_000


@dataclass
class _Bracket:
    """The value of one rank of a column (from 0) lies from ``low`` to ``high``; ``below`` rows lie under, ``inside`` within."""

    name: str
    rank: int
    low: float
    high: float
    below: int
    inside: int
    value: float | None = None

    def holds(self, c: Column) -> Column:
        return (c >= F.lit(self.low)) & (c <= F.lit(self.high))


def _narrowed(rows: DataFrame, values: Mapping[str, Column], open_: list[_Bracket]) -> None:
    """One round: approximate values on either side of each rank, then the exact counts that these divide."""
    near = []
    for i, b in enumerate(open_):
        own = F.when(b.holds(values[b.name]), values[b.name])
        at, slack = (b.rank - b.below) / b.inside, 2 / ACCURACY
        near.append(F.percentile_approx(own, F.array(*(F.lit(min(1.0, max(0.0, p))) for p in (at - slack, at + slack))), F.lit(ACCURACY)).alias(f"n{i}"))
    bounds = [(float(lo), float(hi)) for lo, hi in rows.agg(*near).first()]
    counts = []
    for i, (b, (lo, hi)) in enumerate(zip(open_, bounds, strict=True)):
        c = values[b.name]
        tests = {"a": c < F.lit(lo), "b": c == F.lit(lo), "c": (c > F.lit(lo)) & (c < F.lit(hi)), "d": c == F.lit(hi)}
        counts += [F.count_if(b.holds(c) & t).alias(f"{k}{i}") for k, t in tests.items()]
    row = rows.agg(*counts).first().asDict()
    for i, (b, (lo, hi)) in enumerate(zip(open_, bounds, strict=True)):
        under, at_low, middle = (row[f"{k}{i}"] for k in "abc")
        at_high = row[f"d{i}"] if hi > lo else 0
        place = b.rank - b.below
        if place < under:  # the approximation missed; what is under it is the new bracket
            b.high, b.inside = math.nextafter(lo, -math.inf), under
        elif place < under + at_low:
            b.value = lo
        elif place < under + at_low + middle:
            b.low, b.high = math.nextafter(lo, math.inf), math.nextafter(hi, -math.inf)
            b.below, b.inside = b.below + under + at_low, middle
        elif place < under + at_low + middle + at_high:
            b.value = hi
        else:
            seen = under + at_low + middle + at_high
            b.low, b.below, b.inside = math.nextafter(hi, math.inf), b.below + seen, b.inside - seen


def exact_quantiles(rows: DataFrame, columns: Mapping[str, Column] | Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """By column, the quantiles of its values at ``probabilities``, linear between neighbours; nulls and NaN are left out, None without a value.

    All rows are counted and none is sorted or shuffled: a rank's bracket starts
    as the range of the column. A round asks for two approximate values around
    the rank (a summary of bounded size), counts how many rows these divide the
    bracket into, and keeps the part that holds the rank. When a bracket has at
    most ``GATHERED`` rows, they are sorted and the rank is read off. A round
    keeps about four rows in ``ACCURACY``, so 10 ** 12 rows take five of them;
    the approximation may be wrong at no loss but another round. The values are
    written once and read twice a round.
    """
    chosen = dict(columns) if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    if not chosen:
        return {}
    made = {c: v.cast("double") for c, v in chosen.items()}
    rows = stage(rows.select(*(F.when(~F.isnan(v), v).alias(c) for c, v in made.items())), "values")
    values = {c: F.col(f"`{c}`") for c in made}
    spread = [x for i, v in enumerate(values.values()) for x in (F.count(v).alias(f"n{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"))]
    row = rows.agg(*spread).first().asDict()
    size = {c: row[f"n{i}"] for i, c in enumerate(values)}
    places = {c: [p * (n - 1) for p in probabilities] for c, n in size.items() if n}
    brackets = {}
    for i, c in enumerate(values):
        for rank in {r for at in places.get(c, ()) for r in (math.floor(at), math.ceil(at))}:
            brackets[c, rank] = _Bracket(c, rank, row[f"l{i}"], row[f"h{i}"], 0, size[c])
    while open_ := [b for b in brackets.values() if b.value is None]:
        for b in open_:
            if b.low == b.high:
                b.value = b.low
        small = [b for b in open_ if b.value is None and b.inside <= GATHERED]
        if small:
            found = rows.agg(*(F.get(F.array_sort(F.collect_list(F.when(b.holds(values[b.name]), values[b.name]))), b.rank - b.below).alias(f"v{i}") for i, b in enumerate(small))).first()
            for b, value in zip(small, found, strict=True):
                b.value = value
        if large := [b for b in open_ if b.value is None]:
            _narrowed(rows, values, large)
    at = lambda c, rank: brackets[c, rank].value

    def between(c: str, place: float) -> float:
        lo, hi = at(c, math.floor(place)), at(c, math.ceil(place))
        return lo if lo == hi else lo + (hi - lo) * (place - math.floor(place))

    return {c: [between(c, p) for p in places[c]] if size[c] else [None] * len(probabilities) for c in values}
