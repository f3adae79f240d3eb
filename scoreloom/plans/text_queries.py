"""URL, markup and text functions over pages, documents, events and line items, each with a statement that recomputes it.

The strings that the functions read (references, attributes, headers, messages)
are put together from the tables; the statements do not parse them, but tell from
the parts what has to come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import texts as X
from scoreloom.plans.fixtures import table
from scoreloom.registry import query

_ORIGIN, _PATH = "^(https?://[^/?#]+)", "^https?://[^/?#]+([^?#]*)"


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """``(page_id, url, origin, path, k, word)``: the links of pages in order, each with the letters of its reference."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    rows = table(spark, sf, "pages").select("page_id", "url", F.posexplode(found).alias("k", "href"))
    return rows.select("page_id", "url", F.regexp_extract("url", _ORIGIN, 1).alias("origin"), F.regexp_extract("url", _PATH, 1).alias("path"), (F.col("k") + 1).alias("k"), F.regexp_replace("href", r"[^\p{L}]", "").alias("word"))


_LINKS = rf"""links AS (SELECT page_id, url, regexp_extract(url, '{_ORIGIN}', 1) AS origin, regexp_extract(url, '{_PATH}', 1) AS path, k, regexp_replace(hrefs[k], '[^\p{{L}}]', '', 'g') AS word
FROM (SELECT page_id, url, hrefs, unnest(range(1, len(hrefs) + 1)) AS k FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages)))"""


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", _ORIGIN, 1).alias("origin"), F.regexp_extract("url", _PATH, 1).alias("path"))


_PAGES = f"p AS (SELECT page_id, url, regexp_extract(url, '{_ORIGIN}', 1) AS origin, regexp_extract(url, '{_PATH}', 1) AS path FROM pages)"


def _cases(by: str, *values: str) -> Column:
    """The value whose number ``by`` has."""
    return F.expr(f"CASE {by} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END")


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') || (CASE WHEN length(p) > 1 THEN regexp_replace(p, '/$', '') ELSE p END) AS resource_key
FROM (SELECT *, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS p FROM pages)""")
def resource_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.resource_key(F.col("url")).alias("resource_key"))


@query(r"SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def pages_by_host(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(X.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '^$', ''), ''), 'unknown') AS slug FROM documents")
def slugify(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^<>]*>', '', 'g'), '(?s)<.*$', ''), '>', '', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def strip_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(X.strip_markup(F.col("html"))).alias("text_md5"))


@query("""SELECT user_id, CASE event_id % 7 WHEN 0 THEN 'http-' || (400 + event_id % 120) WHEN 1 THEN 'timeout' WHEN 2 THEN 'network' WHEN 3 THEN 'network' WHEN 4 THEN 'size-limit' WHEN 5 THEN 'decode' ELSE 'other' END AS kind, count(*) AS n,
1 - count(*) / any_value(every) AS success_ratio FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS every FROM events) WHERE event_type = 'error' GROUP BY ALL""")
def failure_category(spark: SparkSession, sf: str) -> DataFrame:
    """Failed requests of each user by class of their message, and the share of requests that did not fail so."""
    messages = ("'HTTP ' || (400 + event_id % 120) || ' at ' || user_id", "'Request TIMED OUT for ' || user_id", "'Failed to fetch ' || props", "'NetworkError when asked by ' || user_id", "'image too large: ' || event_id", "'createImageBitmap failed: ' || props", "'odd ' || props")
    events = table(spark, sf, "events")
    every = events.groupBy("user_id").agg(F.count("*").alias("every"))
    failed = events.where("event_type = 'error'").select("user_id", X.failure_kind(_cases("event_id % 7", *messages)).alias("kind"))
    return failed.groupBy("user_id", "kind").agg(F.count("*").alias("n")).join(every, "user_id").select("user_id", "kind", "n", (1 - F.col("n") / F.col("every")).alias("success_ratio"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN (strlen(coalesce(text, '')) + 2) // 3 * 3 WHEN 1 THEN length(coalesce(text, '')) WHEN 2 THEN 0 ELSE 'inf'::DOUBLE END::DOUBLE AS bytes, doc_id % 4 = 2 AS kept FROM documents""")
def data_url_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as data URLs, coded and plain, beside links and data URLs without a comma; only links are kept in a session."""
    url = _cases("doc_id % 4", "'data:text/plain;base64,' || translate(base64(encode(coalesce(text, ''), 'utf-8')), '\\r\\n', '')", "'data:text/plain,' || coalesce(text, '')", "'https://h.example/' || doc_id", "'data:' || doc_id")
    return table(spark, sf, "documents").select("doc_id", X.inline_bytes(url).alias("bytes"), X.is_kept_in_session(url).alias("kept"))


@query(f"""WITH {_LINKS} SELECT page_id, coalesce(string_agg(origin || '/' || word || ',' || k || '.jpg ' || (1 + (k * 7 + page_id) % 900), '|' ORDER BY (k * 7 + page_id) % 900 DESC, k) FILTER (WHERE k % 4 > 0), '') AS parsed FROM links GROUP BY page_id""")
def srcset_parse(spark: SparkSession, sf: str) -> DataFrame:
    """A page's links as one srcset with commas inside URLs; every fourth has a density instead of a width."""
    entry = F.expr("origin || '/' || word || ',' || k || '.jpg ' || CASE WHEN k % 4 > 0 THEN (1 + (k * 7 + page_id) % 900) || 'w' ELSE '2x' END")
    sets = _links(spark, sf).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))), lambda x: x["e"]), ", ").alias("srcset"))
    return sets.select("page_id", F.array_join(F.transform(X.srcset(F.col("srcset")), lambda s: F.concat_ws(" ", s["url"], s["width"])), "|").alias("parsed"))


@query("SELECT page_id, CASE WHEN page_id % 5 < 4 THEN url END AS origin FROM pages")
def query_param_origin(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses inside redirect links: alone, behind a search page, behind a parameter of lower rank, in capitals, and in none."""
    own = "url_encode(url)"
    link = _cases("page_id % 5", f"'https://r.example/imgres?imgurl=' || {own} || '&n=1'", f"'https://r.example/?url=https%3A%2F%2Fwww.google.com%2Fsearch%3Fq%3D1&u=' || {own}", f"'https://r.example/?src=https%3A%2F%2Fother.example%2F&mediaurl=' || {own}", f"'https://r.example/?ImgURL=' || {own}", f"'https://r.example/?q=' || {own}")
    return table(spark, sf, "pages").select("page_id", X.image_from_query(link).alias("origin"))


@query(f"WITH {_LINKS} SELECT page_id, k, CASE WHEN k % 5 > 0 THEN origin || '/w/c/a/ab/' || word || '.jpg' END AS original FROM links")
def wiki_original(spark: SparkSession, sf: str) -> DataFrame:
    derivative = F.expr("CASE WHEN k % 5 > 0 THEN origin || '/w/c/thumb/a/ab/' || word || '.jpg/' || (100 + k) || 'px-' || word || '.jpg' ELSE origin || '/w/c/a/ab/' || word || '.jpg' END")
    return _links(spark, sf).select("page_id", "k", X.wiki_original(F.concat(derivative, _cases("page_id % 3", "''", "'?x=1'", "'#top'"))).alias("original"))


@query(f"""WITH {_LINKS} SELECT page_id, k, k % 4 < 2 AS thumb, CASE page_id % 3 WHEN 0 THEN NOT regexp_matches(url, '^https?://www[.]') WHEN 1 THEN false ELSE true END AS same FROM links""")
def search_thumb_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Which addresses are a search page's thumbnails, and whether an address and a variant of it are one resource."""
    url = _cases("k % 4", "'https://encrypted-tbn' || k || '.gstatic.com/images?q=' || page_id", "'https://tse' || page_id % 10 || '.mm.bing.net/th?id=' || k", "'https://gstatic.com/' || k", "url")
    other = _cases("page_id % 3", "regexp_replace(url, '^(https?://)', '$1www.')", "origin || '/other' || path", "origin || path || '?v=' || k")
    return _links(spark, sf).select("page_id", "k", X.is_search_thumbnail(url).alias("thumb"), X.same_resource(F.col("url"), other).alias("same"))


@query(f"""WITH {_LINKS}, c AS (SELECT page_id, k, k % 5 IN (0, 2) AS svg, (page_id + k) % 7 < 2 AS no_source, (page_id * 3 + k) % 4 > 0 AS complete, (length(word) * 37 + page_id) % 4 AS w, (page_id * 13 + k * 29) % 200 AS dw, (page_id * 7 + k * 31) % 200 AS dh FROM links)
SELECT page_id, k, CASE WHEN no_source THEN 'wait-source' WHEN svg THEN 'skip' WHEN NOT complete OR w = 0 THEN 'wait-load' WHEN least(dw, dh) < 48 THEN 'skip' ELSE 'scan' END AS class, CASE WHEN no_source THEN 'wait-source' WHEN svg OR least(dw, dh) < 48 THEN 'skip' ELSE 'scan' END AS painted FROM c""")
def candidate_class(spark: SparkSession, sf: str) -> DataFrame:
    """What to do with each linked image, as a picture and as a background."""
    url = F.expr("CASE (page_id + k) % 7 WHEN 0 THEN '' WHEN 1 THEN 'blob:' || word ELSE origin || '/' || word || CASE k % 5 WHEN 0 THEN '.svg' WHEN 1 THEN '.png' WHEN 2 THEN '.SVG?v=1' WHEN 3 THEN '.jpg' ELSE '' END END")
    w, dw, dh = (F.expr(x) for x in ("(length(word) * 37 + page_id) % 4", "(page_id * 13 + k * 29) % 200", "(page_id * 7 + k * 31) % 200"))
    found = X.candidate_class(url, F.expr("(page_id * 3 + k) % 4 > 0"), w, F.lit(10), dw, dh, 48)
    return _links(spark, sf).select("page_id", "k", found.alias("class"), X.painted_class(url, dw, dh, 48).alias("painted"))


@query(f"""WITH {_LINKS} SELECT page_id, coalesce(string_agg(CASE k % 3 WHEN 0 THEN origin || '/' || word || k || '.png' WHEN 2 THEN word || k || '.jpg' END, '|' ORDER BY k), '') AS urls FROM links GROUP BY page_id""")
def css_background_urls(spark: SparkSession, sf: str) -> DataFrame:
    """A page's links as one CSS value with quoted and plain tokens; every third names a vector image."""
    token = _cases("k % 3", "\"url('\" || origin || '/' || word || k || \".png')\"", "'url(' || word || '.svg)'", "'URL( \"' || word || k || '.jpg\" )'")
    css = _links(spark, sf).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", token.alias("t")))), lambda x: x["t"]), " , ").alias("css"))
    return css.select("page_id", F.array_join(X.css_urls(F.col("css")), "|").alias("urls"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 < 2 THEN l_partkey END AS first, CASE WHEN l_linenumber % 3 < 2 THEN l_partkey + l_suppkey END AS last, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey + l_orderkey END AS total FROM lineitem""")
def content_range(spark: SparkSession, sf: str) -> DataFrame:
    """Byte ranges of parts: with a total, without one, and in another unit."""
    header = _cases("l_linenumber % 3", "' bytes ' || l_partkey || '-' || (l_partkey + l_suppkey) || '/' || (l_partkey + l_orderkey) || ' '", "'BYTES ' || l_partkey || '-' || (l_partkey + l_suppkey) || '/*'", "'items ' || l_partkey || '-' || l_suppkey || '/9'")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.content_range(header).alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", "r.first", "r.last", "r.total")


@query("SELECT doc_id, contains(lower(text), 'all rights reserved') OR contains(lower(text), 'copyright') OR contains(lower(text), 'courtesy of') OR contains(lower(text), 'used with permission') OR contains(lower(text), 'trademark') AS restricted, contains(lower(text), 'cc0') OR contains(lower(text), 'public domain') OR contains(lower(text), 'pd-') OR contains(lower(text), 'no restrictions') AS free FROM documents")
def licence_markers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.has_any(F.col("text"), X.RESTRICTED).alias("restricted"), X.has_any(F.col("text"), X.FREE_LICENCES).alias("free"))


_HUD = {"images": "count(*)", "tracked": "count_if(value > 1)", "scored": "count_if(event_type = 'purchase')", "pending": "count_if(event_type = 'click')", "failed": "count_if(event_type = 'error')", "setup": "count_if(event_type = 'view')", "skipped": "count_if(value > 50)"}
_HUD_LINE = "CASE WHEN user_id % 10 > 0 THEN 'HUD dev ' || images || ' img ' || tracked || ' tracked ' || scored || ' scored ' || pending || ' pending ' || failed || ' failed ' || setup || ' setup ' || skipped || ' too-small' ELSE 'nothing to tell of ' || images END"


@query(f"SELECT user_id, {', '.join(f'CASE WHEN user_id % 10 > 0 THEN {v}::INT END AS {k}' for k, v in _HUD.items())} FROM events GROUP BY user_id")
def hud_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of each page's requests, told as a status line and read back; one page in ten tells none."""
    counts = table(spark, sf, "events").groupBy("user_id").agg(*(F.expr(v).alias(k) for k, v in _HUD.items()))
    return counts.select("user_id", X.hud_counts(F.expr(_HUD_LINE)).alias("h")).select("user_id", *(F.col(f"h.{k}") for k in _HUD))


@query(f"""WITH {_LINKS}, {_PAGES}, w AS (SELECT page_id, list(origin || '/' || word || k || '.jpg same-file' ORDER BY k DESC) FILTER (WHERE k * 150 > (page_id * 37) % 600) AS wide FROM links GROUP BY page_id),
c AS (SELECT p.page_id, (page_id * 37) % 600 AS edge, [CASE WHEN page_id % 3 = 0 THEN origin || '/w/c/a/ab/F' || page_id || '.jpg same-file' END] || coalesce(wide, []) || [CASE WHEN page_id % 2 = 0 THEN origin || '/zoom.jpg same-file' END, CASE page_id % 4 WHEN 0 THEN origin || '/full.jpg linked' WHEN 1 THEN origin || '/q.png same-file' END] AS found FROM p LEFT JOIN w USING (page_id))
SELECT page_id, CASE WHEN edge > 0 AND edge < 440 THEN array_to_string(list_filter(found, lambda x: x IS NOT NULL)[1:3], '|') ELSE '' END AS candidates FROM c""")
def upgrade_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Larger versions of a page's picture: its original, wider sources, an attribute, and what a link leads to."""
    entry = F.expr("origin || '/' || word || k || '.jpg ' || k * 150 || 'w'")
    sets = _links(spark, sf).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))), lambda x: x["e"]), ", ").alias("srcset"))
    rows = _pages(spark, sf).join(sets, "page_id", "left")
    current = F.expr("CASE WHEN page_id % 3 = 0 THEN origin || '/w/c/thumb/a/ab/F' || page_id || '.jpg/320px-F' || page_id || '.jpg' ELSE origin || '/s' || page_id || '.jpg' END")
    zoom, link = F.expr("CASE WHEN page_id % 2 = 0 THEN origin || '/zoom.jpg' END"), _cases("page_id % 4", "origin || '/full.jpg'", "'https://r.example/?imgurl=' || url_encode(origin || '/q.png')", "origin || '/page.html'")
    found = X.upgrade_candidates(current, F.expr("(page_id * 37) % 600"), 440, F.col("srcset"), F.create_map(F.lit("zoomSrc"), zoom), link)
    return rows.select("page_id", F.array_join(F.transform(found, lambda c: F.concat_ws(" ", c["url"], c["confidence"])), "|").alias("candidates"))


_NAMES = "origin || '/' || word || k || CASE (page_id + k) % 6 WHEN 0 THEN '~thumb.jpg' WHEN 1 THEN '~large.jpg' WHEN 2 THEN '~orig.JPG' WHEN 3 THEN '.json' WHEN 4 THEN '~small.png' ELSE '.jpeg' END"


@query(f"""WITH {_LINKS}, n AS (SELECT page_id, k, {_NAMES} AS u, (page_id + k) % 6 AS c FROM links), b AS (SELECT page_id, arg_min(u, (c IN (0, 4), c <> 2, c <> 1, length(u), k)) AS asset FROM n WHERE c <> 3 GROUP BY page_id)
SELECT DISTINCT page_id, asset FROM links LEFT JOIN b USING (page_id)""")
def preferred_asset(spark: SparkSession, sf: str) -> DataFrame:
    """The best picture of each page's listing."""
    lists = _links(spark, sf).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.expr(_NAMES).alias("u")))), lambda x: x["u"]).alias("urls"))
    return lists.select("page_id", X.preferred_asset(F.col("urls")).alias("asset"))


@query(f"""WITH {_PAGES}, r AS (SELECT page_id, regexp_replace(path, '^/+', '') AS r FROM p), c AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN nullif(r, '') WHEN 1 THEN r || '.JPG' WHEN 5 THEN r || '.png' END AS canonical, CASE page_id % 6 WHEN 0 THEN r WHEN 1 THEN '.jpg' WHEN 2 THEN r WHEN 3 THEN '.webp' WHEN 4 THEN '.gif' ELSE '.png' END AS tail FROM r)
SELECT page_id, canonical, CASE WHEN page_id % 7 = 0 THEN 'tiff' ELSE coalesce(replace(nullif(regexp_extract(lower(tail), '[.]([a-z0-9]+)$', 1), ''), 'jpg', 'jpeg'), 'unknown') END AS format FROM c""")
def path_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of pages as files: with backslashes, with dots, absolute, leaving their root, with a drive."""
    rows = _pages(spark, sf).withColumn("r", F.regexp_replace("path", "^/+", ""))
    path = _cases("page_id % 6", "translate(r, '/', '\\\\')", "'./' || r || '.JPG'", "'/' || r", "r || '/../x.webp'", "'C:\\\\' || r || '.gif'", "replace(r, '/', '/./') || '.png'")
    return rows.select("page_id", X.canonical_path(path).alias("canonical"), X.format_of(F.expr("CASE WHEN page_id % 7 = 0 THEN ' TIFF ' END"), path).alias("format"))


@query(f"""WITH {_LINKS}, d AS (SELECT *, coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') AS folder FROM links)
SELECT page_id, k, CASE (page_id + k) % 6 WHEN 0 THEN origin || '/' || word WHEN 1 THEN CASE WHEN word <> '' THEN origin || folder || word END WHEN 2 THEN origin || regexp_replace(folder, '[^/]+/$', '') || word WHEN 3 THEN regexp_extract(url, '^https?:') || '//cdn.example.net/' || word END AS resolved FROM d""")
def url_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """References of links against their page's address: from the root, beside it, above it, to another host, and none."""
    reference = _cases("(page_id + k) % 6", "'/' || word", "word", "'../' || word", "'//cdn.example.net/' || word", "'data:text/plain,' || word", "''")
    return _links(spark, sf).select("page_id", "k", X.resolve_url(reference, F.col("url")).alias("resolved"))


#: Letters and what their UTF-8 bytes look like when read as cp1252 (fixed values).
_SEEN = {"é": "Ã©", "ê": "Ãª", "è": "Ã¨", "ç": "Ã§", "ó": "Ã³", "ñ": "Ã±", "ä": "Ã¤", "ö": "Ã¶", "ü": "Ã¼", "ß": "ÃŸ"}


def _mojibake(text: str) -> str:
    for letter, seen in _SEEN.items():
        text = f"replace({text}, '{letter}', '{seen}')"
    return text


@query(f"""SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[^\x00-\x7F{"".join(_SEEN)}]') THEN {_mojibake("text")} ELSE text END) AS text_md5 FROM documents""")
def undo_cp1252(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that were read in the wrong code, repaired; a text with other letters as well is not such a one and stays."""
    return table(spark, sf, "documents").select("doc_id", F.md5(X.undo_cp1252(F.expr(_mojibake("text")))).alias("text_md5"))


_STEP = "CASE WHEN l_returnflag = 'R' THEN 'jpeg' ELSE 'rescale' END"
_QUALITY = "CASE WHEN l_linestatus = 'F' OR l_linenumber % 2 = 1 THEN l_quantity END"


@query(f"SELECT l_orderkey, arg_max(quality, (l_linenumber, l_partkey, l_extendedprice)) FILTER (WHERE op = 'jpeg' AND quality IS NOT NULL) AS quality FROM (SELECT *, {_STEP} AS op, {_QUALITY} AS quality FROM lineitem) GROUP BY l_orderkey")
def last_step_number(spark: SparkSession, sf: str) -> DataFrame:
    """The quality of the last lossy step of each order, of those that have one; line items stand for steps."""
    step = F.struct("l_linenumber", "l_partkey", "l_extendedprice", F.expr(_STEP).alias("op"), F.expr(_QUALITY).alias("quality"))
    steps = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return steps.select("l_orderkey", X.last_number(F.col("steps"), "jpeg", "quality").alias("quality"))
