"""Secret scans with corpus-wide ownership frequency (operator 6); built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import fresh, stage

#: Kind, pattern, group that must be long enough (0: the whole match), least characters of it. Fixed values.
KINDS = (
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 12),
    ("access", r"AKIA[A-Z0-9]+", 18),
    ("hex", r"[0-9a-f]{16,}", 16),
)
_KEY = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Kinds that the method adds to the base kinds, with patterns that match nothing shorter than a real one. Fixed values.
MORE_KINDS = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
#: Distinct owners from which on a value counts as a copied example, and repositories of two owners or more from which on it does as well.
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 5
#: Matches whose positions are added up in one fold.
_FOLD = 64


def is_wide(n_owners: Column, n_repositories: Column) -> Column:
    """Whether a value is a copied example: one owner's value is not, in however many of its repositories it is."""
    return (n_owners >= WIDE_OWNERS) | ((n_owners > 1) & (n_repositories >= WIDE_REPOSITORIES))


def matches(text: Column, pattern: str) -> Column:
    """All matches, left to right, as structs of start, end (code points, end exclusive) and value.

    Splitting at a pattern gives the parts between its matches, so the lengths
    of parts and matches add up to the positions. They are added in blocks, so
    that a text with very many matches does not copy a growing list at each.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.transform(F.split(text, pattern, -1), F.length)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    size = lambda x: F.coalesce(x["gap"], F.lit(0)) + F.length(x["hit"])

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.coalesce(pair["gap"], F.lit(0))
        end = begin + F.length(pair["hit"])
        one = F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    pairs = F.arrays_zip(F.slice(parts, 1, F.greatest(F.size(found), F.lit(1))).alias("gap"), found.alias("hit"))
    n_blocks = F.ceil(F.size(found) / _FOLD).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: F.slice(pairs, k * _FOLD + 1, _FOLD))
    sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + size(x)))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(sizes, first, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
    spans = F.flatten(F.zip_with(blocks, starts, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("out")), step)["out"]))
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _spans(text: Column, nr: int, kind: str, pattern: str, key: str | None, least: int) -> Column:
    def span(x: Column) -> Column:
        value = F.regexp_replace(x["value"], key, "") if key else x["value"]
        return F.struct(x["start"].alias("start"), F.lit(nr).alias("nr"), x["end"].alias("end"), F.lit(kind).alias("kind"), value.alias("value"))

    return F.filter(F.transform(matches(text, pattern), span), lambda x: F.length(x["value"]) >= least)


def candidates(text: Column) -> Column:
    """Spans of all kinds as structs (start, kind number, end, kind, value), in order."""
    base = [_spans(text, i, kind, pattern, _KEY if kind == "assign" else None, least) for i, (kind, pattern, least) in enumerate(KINDS)]
    more = [_spans(text, i, kind, pattern, None, 1) for i, (kind, pattern) in enumerate(MORE_KINDS, len(KINDS))]
    return F.array_sort(F.concat(*base, *more))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """``(doc_id, spans, n_live, n_example, live_spans)`` for each row of ``docs``.

    ``spans`` has all candidates (see ``KINDS``; a failing match still uses up
    its text). Each value's hash is counted over the corpus by distinct
    repositories and owners: a widely copied one (see :func:`is_wide`) is an
    example, any other looks like a live credential of its owners, and
    ``live_spans`` lists its spans. ``owner`` and ``repository`` are by default
    the source and the source with the language.

    Nulls count as empty texts; a null owner or repository is one of its own.
    Repeated rows each give a row and do not change distinct counts; documents
    without a candidate give zeros; empty tables no rows. The counts are
    aggregated in two steps, first to distinct (hash, owner, repository), so a
    value that a third of all rows hold never meets in one task.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"), candidates(text).alias("spans"))
    rows = rows.withColumn("values", F.transform("spans", lambda x: F.sha2(x["value"], 256)))
    rows = stage(rows.withColumn("bundle", F.when(F.size("values") > 0, F.array_join("values", ","))), "secrets")
    held = rows.where("bundle is not null").select("owner", "repository", F.explode("values").alias("value")).distinct()
    counts = held.groupBy("value", "owner").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    bundles = rows.where("bundle is not null").select("bundle").distinct().select("bundle", F.posexplode(F.split("bundle", ",")).alias("at", "value"))
    known = bundles.join(counts, "value").groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("at", "n_owners", "n_repositories"))).alias("known"))
    known = stage(known, "ownership")
    wide = lambda k: is_wide(k["n_owners"], k["n_repositories"])
    out = rows.join(known, "bundle", "left")
    live = F.filter(F.coalesce("spans", F.array().cast(rows.schema["spans"].dataType)), lambda x, i: ~F.coalesce(wide(F.get("known", i)), F.lit(False)))
    n_known = lambda test: F.coalesce(F.size(F.filter("known", test)), F.lit(0)).cast("long")
    return out.select("doc_id", "spans", n_known(lambda k: ~wide(k)).alias("n_live"), n_known(wide).alias("n_example"), F.when(F.size("spans") > 0, live).otherwise(F.col("spans")).alias("live_spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every candidate's value in ``text_col`` replaced; all other columns stay."""
    (own,) = fresh(docs, "spans")
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, x: Column) -> Column:
        begin = F.greatest(x["end"] - F.length(x["value"]), state["at"])
        more = F.concat(state["out"], F.substring(text, state["at"] + 1, begin - state["at"]), F.lit(mask))
        return F.when(x["end"] > state["at"], F.struct(more.alias("out"), x["end"].alias("at"))).otherwise(state)

    def rebuilt(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))

    new = F.when(F.size(own) > 0, F.aggregate(own, start, step, rebuilt)).otherwise(text)
    out = docs.withColumn(own, candidates(F.coalesce(text, F.lit(""))))
    return out.select(*((new.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns))
