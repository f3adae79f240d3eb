"""Text, URL and markup functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameter and attribute names, markers and suffixes (fixed values).
REDIRECTS = ("imgurl", "mediaurl", "imageurl", "image_url", "ou", "iu", "image", "src", "url", "u")
ATTRIBUTES = ("zoomSrc", "hiResSrc", "largeFile", "origFile", "fullSrc", "largeSrc", "imageSrc", "original", "origsrc", "src", "lazySrc")
FREE_LICENCES = ("cc0", "public domain", "pd-", "no restrictions")
RESTRICTED = ("copyright", "all rights reserved", "courtesy of", "used with permission", "trademark")
UNWATCHED = ("SCRIPT", "STYLE", "LINK", "META", "HEAD", "NOSCRIPT", "BR", "HR", "TEMPLATE", "IFRAME", "SVG", "PATH", "CANVAS", "VIDEO", "AUDIO", "SOURCE", "TRACK", "INPUT", "TEXTAREA", "SELECT", "OPTION")
MOST_INLINE_BYTES = 2 * 1024 * 1024
_IMAGE_PATH = r"(?i)\.(?:avif|bmp|gif|jpe?g|jxl|png|tiff?|webp)$"
_SPACE = r"[ \t\n\x0b\f\r]"


def _outside_brackets(text: Column) -> Column:
    """The parts at depth 0, of parts that each begin with a bracket, by a fold over them."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(state: Column, part: Column) -> Column:
        depth = F.when(part.startswith("<"), state["depth"] + 1).when(part.startswith(">"), F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        plain = F.regexp_replace(part, "^[<>]", "")
        return F.struct(depth.alias("depth"), F.when(depth == 0, F.concat(state["out"], plain)).otherwise(state["out"]).alias("out"))

    return F.aggregate(F.split(text, "(?=[<>])"), start, step)["out"]


def strip_markup(text: Column) -> Column:
    """Text outside of angle brackets, nested ones included, with white space collapsed.

    Innermost brackets go first, in 8 rounds; texts nested deeper, which are
    rare, are read bracket by bracket. An unclosed bracket takes the rest of the
    text with it.
    """
    out = text
    for _ in range(8):
        out = F.regexp_replace(out, r"<[^<>]*>", "")
    deep = out.rlike(r"<[^<>]*>")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<.*$", ""), ">", "")
    out = F.when(deep, _outside_brackets(text)).otherwise(out)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def slug(text: Column, most: int | None = 48, default: str = "unknown") -> Column:
    out = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-")
    out = F.regexp_replace(out, "^-+|-+$", "")
    out = F.substring(out, 1, most) if most else out
    return F.when(F.coalesce(out, F.lit("")) == "", default).otherwise(out)


def short_name(markup: Column, most: int = 60, default: str = "unknown-artist") -> Column:
    name = F.trim(F.substring(strip_markup(markup), 1, most))
    return F.when(F.coalesce(name, F.lit("")) == "", default).otherwise(name)


def has_any(text: Column, markers: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))


def failure_kind(error: Column) -> Column:
    """Ordered classes of failure messages."""
    e = F.lower(error)
    code = F.regexp_extract(e, r"http\s+(\d{3})", 1)
    has = lambda *w: F.reduce(F.array(*(F.contains(e, F.lit(x)) for x in w)), F.lit(False), lambda a, b: a | b)
    out = F.when(code != "", F.concat(F.lit("http-"), code)).when(has("timed out", "timeout"), "timeout").when(has("failed to fetch", "networkerror"), "network")
    return out.when(has("too large", "exceeded"), "size-limit").when(has("decode", "imagebitmap"), "decode").otherwise("other")


def hud_counts(text: Column) -> Column:
    names = ("images", "tracked", "scored", "pending", "failed", "setup", "skipped")
    p = r"\bdev\b.*?(\d+) img.*?(\d+) tracked.*?(\d+) scored.*?(\d+) pending.*?(\d+) failed.*?(\d+) setup.*?(\d+) too-small"
    return F.when(text.rlike(p), F.struct(*(F.regexp_extract(text, p, i).cast("int").alias(n) for i, n in enumerate(names, 1))))


def content_range(value: Column) -> Column:
    """Struct (first, last, total) of a byte range header, total null for ``*``; null if it is none."""
    v, p = F.trim(value), r"(?i)^bytes\s+(\d+)-(\d+)/(\d+|\*)$"
    return F.when(v.rlike(p), F.struct(F.regexp_extract(v, p, 1).cast("long").alias("first"), F.regexp_extract(v, p, 2).cast("long").alias("last"), F.regexp_extract(v, p, 3).try_cast("long").alias("total")))


def is_svg(url: Column) -> Column:
    u = F.lower(F.trim(url))
    return u.rlike(r"^data:image/svg(?:\+xml)?[;,]") | u.rlike(r"\.svg(?:[?#]|$)")


def inline_bytes(url: Column) -> Column:
    """Decoded length of a data URL; 0 for others, infinite without a comma."""
    comma = F.instr(url, ",")
    size = F.length(url) - comma
    coded = F.substring(url, F.lit(6), F.greatest(comma - 6, F.lit(0))).rlike("(?i);base64")
    return F.when(~url.startswith("data:"), 0.0).when(comma == 0, float("inf")).when(coded, F.floor(size * 3 / 4).cast("double")).otherwise(size.cast("double"))


def is_kept_in_session(url: Column) -> Column:
    return url.startswith("http:") | url.startswith("https:")


def candidate_class(url: Column, complete: Column, width: Column, height: Column, shown_w: Column, shown_h: Column, least: int, limit: int = MOST_INLINE_BYTES) -> Column:
    """Ordered rules of what to do with an image found on a page."""
    return F.when(~F.coalesce(url.rlike("^(https?:|data:)"), F.lit(False)), "wait-source").when(is_svg(url) | (inline_bytes(url) > limit), "skip").when(~complete | (width == 0) | (height == 0), "wait-load").when(F.least(shown_w, shown_h) < least, "skip").otherwise("scan")


def painted_class(url: Column, shown_w: Column, shown_h: Column, least: int, limit: int = MOST_INLINE_BYTES) -> Column:
    """The same for backgrounds, which have no loading state."""
    return F.when(~F.coalesce(url.rlike("^(https?:|data:)"), F.lit(False)), "wait-source").when(is_svg(url) | (inline_bytes(url) > limit), "skip").when(F.least(shown_w, shown_h) < least, "skip").otherwise("scan")


def css_urls(value: Column) -> Column:
    """Raster URLs of ``url()`` tokens."""
    p = r"""(?i)url\(\s*(['"]?)(.*?)\1\s*\)"""
    found = F.transform(F.regexp_extract_all(value, F.lit(p), F.lit(2)), F.trim)
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda u: (u != "") & ~is_svg(u))


def srcset(value: Column) -> Column:
    """Structs (url, width) of width descriptors, widest first; commas inside URLs stay."""
    entries = F.split(value, r"(?<=[0-9][wx])\s*,\s*|,\s+")
    parts = F.transform(entries, lambda e: F.split(F.trim(e), r"\s+"))
    wide = F.filter(parts, lambda p: F.coalesce(F.get(p, 1).rlike(r"^\d+w$"), F.lit(False)) & F.get(p, 0).rlike("^https?:"))
    made = F.transform(wide, lambda p, i: F.struct((-F.regexp_extract(F.get(p, 1), r"\d+", 0).cast("int")).alias("w"), i.alias("i"), F.get(p, 0).alias("url")))
    return F.transform(F.array_sort(made), lambda m: F.struct(m["url"].alias("url"), (-m["w"]).alias("width")))


def url_host(url: Column) -> Column:
    return F.when(url.startswith("data:"), "data:").otherwise(F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("unknown")))


def is_search_thumbnail(url: Column) -> Column:
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    return host.rlike(r"(?i)^encrypted-tbn[0-9]*\.gstatic\.com$") | host.rlike(r"(?i)^tse[0-9]*\.mm\.bing\.net$")


def wiki_original(url: Column) -> Column:
    """The file a scaled derivative names in its own path; null if it names none."""
    base = F.regexp_replace(url, r"[?#].*$", "")
    p = r"^(https?://[^/]+(?:/.*)?)/thumb(/.+)/[^/]*\d+px-[^/]*$"
    return F.when(base.rlike(p), F.regexp_replace(base, p, "$1$2"))


def resource_key(url: Column) -> Column:
    """Host without www and path without a final slash, of the original; empty for thumbnails and other schemes."""
    u = F.coalesce(wiki_original(url), url)
    host = F.regexp_replace(F.lower(F.try_parse_url(u, F.lit("HOST"))), r"^www\.", "")
    path = F.coalesce(F.nullif(F.try_parse_url(u, F.lit("PATH")), F.lit("")), F.lit("/"))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    ok = url.rlike("^https?://") & ~is_search_thumbnail(url)
    return F.when(ok, F.coalesce(F.concat(host, path), F.lit(""))).otherwise("")


def same_resource(a: Column, b: Column) -> Column:
    ka, kb = resource_key(a), resource_key(b)
    return F.coalesce((a == b) | ((ka != "") & (ka == kb)), F.lit(False))


def image_from_query(url: Column) -> Column:
    """The first redirect parameter, by rank, that holds an http(s) URL other than a search page or this one."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), F.try_url_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).alias("v")))

    def value(key: str) -> Column:
        v = F.get(F.filter(pairs, lambda p: p["k"] == key), 0)["v"]
        host = F.coalesce(F.try_parse_url(v, F.lit("HOST")), F.lit(""))
        search = host.rlike(r"(?i)(?:^|\.)google(?:\.[a-z]+)+$") | host.rlike(r"(?i)(?:^|\.)bing\.com$")
        return F.when(v.rlike("^https?://") & (v != url) & ~search, v)

    return F.coalesce(*map(value, REDIRECTS))


def upgrade_candidates(current: Column, short_edge: Column, least: int, srcset_value: Column, data: Column, link: Column, limit: int = 3) -> Column:
    """Ranked larger versions of an image as structs (url, confidence), without repeats, at most ``limit``.

    In order: the original of the URL shown, wider sources, data attributes,
    the link's redirect parameter (all the same file), and the link itself if
    it ends like an image (linked only). A derivative stands behind its
    original. Base URLs are resolved before; ``data`` is a map.
    """
    same = lambda c: F.struct(c.alias("url"), F.lit("same-file").alias("confidence"))
    wide = F.transform(F.filter(F.coalesce(srcset(srcset_value), F.array().cast("array<struct<url:string,width:int>>")), lambda s: s["width"] > short_edge), lambda s: same(s["url"]))
    attributes = F.array(*(same(F.when(F.get(F.array(F.element_at(data, k)), 0).rlike("^https?:"), F.element_at(data, k))) for k in ATTRIBUTES))
    direct = F.struct(F.when(link.rlike("^https?://") & F.coalesce(F.try_parse_url(link, F.lit("PATH")).rlike(_IMAGE_PATH), F.lit(False)), link).alias("url"), F.lit("linked").alias("confidence"))
    ranked = F.concat(F.array(same(wiki_original(current))), wide, attributes, F.array(same(image_from_query(link)), direct))
    ranked = F.flatten(F.transform(ranked, lambda c: F.array(same(wiki_original(c["url"])), c)))
    ranked = F.filter(ranked, lambda c: c["url"].isNotNull() & (c["url"] != current))
    urls = F.transform(ranked, lambda c: c["url"])
    ranked = F.filter(ranked, lambda c, i: F.array_position(urls, c["url"]) == i + 1)
    wanted = (short_edge > 0) & ((short_edge < least) | is_search_thumbnail(current))
    return F.when(wanted, F.slice(ranked, 1, limit)).otherwise(F.array().cast("array<struct<url:string,confidence:string>>"))


def preferred_asset(urls: Column) -> Column:
    """The best picture of a listing: no small derivative, then originals, large ones, short names."""
    low = F.filter(urls, lambda u: F.lower(u).rlike(r"\.(jpg|jpeg|png)$"))
    full = F.filter(low, lambda u: ~F.lower(u).rlike("~thumb|~small|~medium"))
    pool = F.when(F.size(full) > 0, full).otherwise(low)
    keyed = F.transform(pool, lambda u, i: F.struct((~F.contains(F.lower(u), F.lit("~orig"))).alias("a"), (~F.contains(F.lower(u), F.lit("~large"))).alias("b"), F.length(u).alias("n"), i.alias("i"), u.alias("u")))
    return F.get(F.array_sort(keyed), 0)["u"]


def before_mark(identifier: Column, mark: str = "--") -> Column:
    return F.substring_index(identifier, mark, 1)


def last_number(steps: Column, op: str, field: str) -> Column:
    """The field of the last step of a kind that has one."""
    return F.get(F.slice(F.filter(steps, lambda s: (s["op"] == op) & s[field].isNotNull()), -1, 1), 0)[field] if field else F.lit(None)


def format_of(field: Column, path: Column) -> Column:
    """Declared format in lower case, else the path's suffix, with jpg as jpeg."""
    suffix = F.nullif(F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1), F.lit(""))
    out = F.coalesce(F.nullif(F.lower(F.trim(field)), F.lit("")), suffix, F.lit("unknown"))
    return F.when(out == "jpg", "jpeg").otherwise(out)


def canonical_path(path: Column) -> Column:
    """Forward slashes, no ``./``; null for absolute paths and those that leave their root."""
    p = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/(\./)+", "/"), r"^(\./)+", "")
    return F.when(~p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)") & (p != ""), p)


def undo_cp1252(values: Column) -> Column:
    """UTF-8 text that was read as cp1252, repaired; other text as it is. Spark has no cp1252 codec, so Arrow batches do it."""
    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else x.encode("cp1252").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                return x

        return s.map(one)

    return fix(values)


def resolve_url(url: Column, base: Column) -> Column:
    """Absolute http(s) URL of a reference, null for anything else; no built-in resolves references."""
    @F.pandas_udf("string")
    def join(u: pd.Series, b: pd.Series) -> pd.Series:
        from urllib.parse import urljoin

        def one(x, y):
            if not x:
                return None
            try:
                out = urljoin(y or "", x)
            except ValueError:
                return None
            return out if out.startswith(("http:", "https:")) else None

        return pd.Series([one(x, y) for x, y in zip(u, b, strict=True)])

    return join(url, base)
