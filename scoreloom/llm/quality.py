"""Quality rules compiled from a threshold table into one projection (operator 5)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import fresh

#: Common function words of the languages served (fixed values).
STOP_WORDS = (
    "the of and to in is was that for with are this from by at or as be "
    "der die und das ist nicht mit von zu den ein eine für auf sich des dem "
    "le la les et des est dans un une que pour par sur en qui au du ne pas "
    "el los las y es por con para del se no su al lo como de"
).split()

#: The threshold table: measure, least and most allowed value, None for no bound.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, 1_000_000),
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_word_ratio", None, 0.10),
    ("mark_word_ratio", None, 0.30),
    ("capital_ratio", None, 0.50),
    ("n_stop_words", 2, None),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.50),
    ("repeat_word_ratio", None, 0.50),
)
#: The stop words as they may stand in a text.
STOP_FORMS = list(dict.fromkeys(f(x) for f in (str.lower, str.capitalize, str.upper) for x in STOP_WORDS))
#: Words of each window whose repetition counts.
WINDOW = 3
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of other characters than 0x20 and 0x09-0x0D; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def repeat_words(word: Column) -> Column:
    """Words that lie in a window of three words which the text holds twice or more.

    Windows are sorted by 64-bit hash with their positions, so equal ones are
    neighbours: n log n for the whole text, however repetitive.
    """

    def covered(order: Column) -> Column:
        same = lambda i, j: F.get(order, i)["h"] == F.get(order, j)["h"]
        repeated = F.filter(order, lambda w, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        positions = F.flatten(F.transform(repeated, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))
        return F.size(F.array_distinct(positions)).cast("long")

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def counted(w: Column) -> Column:
        every = windows(w)
        return let(every, lambda v: F.when(F.size(F.array_distinct(F.transform(v, lambda x: x["h"]))) == F.size(v), F.lit(0).cast("long")).otherwise(let(F.sort_array(v), covered)))

    return F.when(F.size(word) <= WINDOW, F.lit(0).cast("long")).otherwise(counted(word))


def measures(docs: DataFrame, text_col: str, names: dict[str, str]) -> DataFrame:
    """``docs`` with a column for each measure, named by ``names``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    w, line = fresh(docs.select("*", *(F.lit(0).alias(n) for n in names.values())), "words", "lines")
    docs = docs.withColumn(w, words(F.col(text_col)))
    docs = docs.withColumn(line, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size(w).cast("long")
    chars = F.length(F.array_join(F.col(w), "")).cast("long")
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")
    dup = (F.size(line) - F.size(F.array_distinct(line))).cast("long")
    per_word = lambda c: c / F.greatest(n, F.lit(1))
    made = {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup,
        "n_repeat_words": repeat_words(F.col(w)),
        "mean_word_chars": per_word(chars),
        "symbol_word_ratio": per_word(symbols),
        "mark_word_ratio": per_word(F.regexp_count(text, F.lit("[!?#*$%&|<>]"))),
        "capital_ratio": F.regexp_count(text, F.lit(r"\p{Lu}")) / F.greatest(chars, F.lit(1)),
        "n_stop_words": F.size(F.array_intersect(F.col(w), F.array(*(F.lit(x) for x in STOP_FORMS)))),
        "stop_word_ratio": per_word(F.size(F.filter(F.col(w), lambda x: x.isin(STOP_FORMS)))),
        "dup_line_ratio": dup / F.greatest(F.size(line), F.lit(1)),
    }
    docs = docs.select("*", *(c.alias(names[k]) for k, c in made.items()))
    return docs.withColumn(names["repeat_word_ratio"], F.col(names["n_repeat_words"]) / F.greatest(F.col(names["n_words"]), F.lit(1))).drop(w, line)


def verdict(names: dict[str, str], thresholds=THRESHOLDS) -> Column:
    """One predicate from the whole threshold table."""
    bounds = [F.col(names[m]) >= low for m, low, _ in thresholds if low is not None] + [F.col(names[m]) <= high for m, _, high in thresholds if high is not None]
    return reduce(lambda a, b: a & b, bounds)


def quality(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """``docs`` with the base measures, ``base_failed`` and ``kept``.

    ``base_failed`` is true for fewer than 50 words, or if over half the words
    lie in repeated windows; ``kept`` also asks for all ``thresholds``. All in
    one projection of built-in functions, without shuffle. Null and empty texts
    have no words and fail; columns of the results' names are replaced; repeated
    rows each get their row, empty tables none.
    """
    docs = docs.drop(*_BASE, "base_failed", "kept") if text_col not in (*_BASE, "base_failed", "kept") else docs
    plain = [*_BASE, "mean_word_chars", "symbol_word_ratio", "mark_word_ratio", "capital_ratio", "n_stop_words", "stop_word_ratio", "dup_line_ratio", "repeat_word_ratio"]
    names = dict(zip(plain, fresh(docs, *plain), strict=True))
    out = measures(docs, text_col, names)
    failed = (F.col(names["n_words"]) < 50) | (100 * F.col(names["n_repeat_words"]) > 50 * F.col(names["n_words"]))
    out = out.withColumns({"base_failed": failed, "kept": ~failed & verdict(names, thresholds)})
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(names[b]).alias(b) for b in _BASE), "base_failed", "kept")
