"""Registered queries of the training-data operators, with their oracles where SQL can express one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import alignment, decontaminate, embedding, licenses, linedup, mixing, preferences, quality, search, secrets, simhash, tokens, toxicity
from scoreloom.llm.common import table


def op1_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words as the contract has them, and distinct 5-word shingles of each row, the whole sequence for 1 to 4 words.
_SHINGLES = r"""
  SELECT DISTINCT id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i
        FROM (SELECT {id} AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table})
        WHERE len(w) > 0)
"""

OP1_SQL = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
     q AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
     n AS (SELECT id, count(*) AS n FROM q GROUP BY id)
SELECT d.id AS doc_id, q.id AS item_id, count(*) AS n_shared, any_value(n.n) AS n_item
FROM d JOIN q USING (s) JOIN n ON n.id = q.id
GROUP BY d.id, q.id HAVING 5 * count(*) >= 4 * any_value(n.n)
"""


def _span_list(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")


def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preferences.format_pairs(preferences.reply_pairs(table(spark, sf_dir, "conversations")))
    digests = [F.md5(c).alias(f"{c}_md5") for c in ("prompt", "chosen", "rejected")]
    return out.select("pair_id", "n_prompt_turns", *digests, _span_list("chosen_spans").alias("chosen_spans"), _span_list("rejected_spans").alias("rejected_spans"))


OP2_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
     l AS (SELECT conv_id, max(k) AS k FROM n WHERE role = 'assistant' GROUP BY conv_id),
     r AS (SELECT n.conv_id, n.k, n.text FROM n JOIN l USING (conv_id, k)),
     p AS (SELECT a.conv_id, a.k, a.text AS reply, b.text AS other FROM r a JOIN r b ON b.conv_id = xor(a.conv_id, 1) WHERE a.text <> b.text),
     side AS (SELECT conv_id, 'chosen' AS side, n.k, role, n.text FROM p JOIN n USING (conv_id) WHERE n.k <= p.k
              UNION ALL SELECT conv_id, 'rejected', n.k, role, n.text FROM p JOIN n USING (conv_id) WHERE n.k < p.k UNION ALL SELECT conv_id, 'rejected', k, 'assistant', other FROM p),
     prefix AS (SELECT conv_id, min(a.k) - 1 AS n FROM side a JOIN side b USING (conv_id, k) WHERE a.side = 'chosen' AND b.side = 'rejected' AND (a.role <> b.role OR a.text <> b.text) GROUP BY conv_id),
     t2 AS (SELECT conv_id, side, k, role, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS t FROM side JOIN prefix USING (conv_id)),
     rest AS (SELECT *, sum(length(t)) OVER (PARTITION BY conv_id, side ORDER BY k) AS upto FROM t2 WHERE k > n),
     made AS (SELECT conv_id, side, md5(string_agg(t, '' ORDER BY k)) AS h, coalesce(string_agg((upto - length(t) + length(role) + 5)::BIGINT || ':' || upto::BIGINT, ',' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS spans FROM rest GROUP BY ALL)
SELECT c.conv_id AS pair_id, (SELECT n FROM prefix x WHERE x.conv_id = c.conv_id) AS n_prompt_turns, md5(coalesce((SELECT string_agg(t, '' ORDER BY k) FROM t2 WHERE t2.conv_id = c.conv_id AND side = 'chosen' AND k <= n), '')) AS prompt_md5,
       c.h AS chosen_md5, r.h AS rejected_md5, c.spans AS chosen_spans, r.spans AS rejected_spans
FROM made c JOIN made r USING (conv_id) WHERE c.side = 'chosen' AND r.side = 'rejected'
"""


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rates = mixing.document_rates(docs, mixing.labelled_domains(docs, table(spark, sf_dir, "labels")), mixing.TARGETS)
    return rates.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.round("rate", 6).alias("rate"))


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return labels.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


_STOPS = ", ".join(f"'{x}'" for x in quality.STOP_FORMS)
_MEASURES = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_word_ratio": "n_symbols / greatest(n_words, 1)",
    "mark_word_ratio": "len(regexp_extract_all(t, '[!?#*$%&|<>]')) / greatest(n_words, 1)",
    "capital_ratio": r"len(regexp_extract_all(t, '\p{Lu}')) / greatest(word_chars, 1)",
    "n_stop_words": "len(list_intersect(list_distinct(w), stops))",
    "stop_word_ratio": "len(list_filter(w, lambda x: list_contains(stops, x))) / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(len(l), 1)",
    "repeat_word_ratio": "n_repeat_words / greatest(n_words, 1)",
}
_RULES = " AND ".join(f"{_MEASURES[m]} {op} {v}" for m, low, high in quality.THRESHOLDS for op, v in ((">=", low), ("<=", high)) if v is not None)

OP5_SQL = rf"""
WITH a AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, [{_STOPS}] AS stops FROM documents),
     b AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM a),
     s AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
     m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM s) WHERE n > 1),
     c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM m) GROUP BY r),
     d AS (SELECT b.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN c USING (r)),
     e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_RULES} AS kept FROM e
"""


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["nr"] < len(secrets.KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k, *_ in secrets.KINDS), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), "n_live", "n_example")


def _secret_spans_sql() -> str:
    """Spans of all kinds: a hit starts after the parts before it and the hits before it."""
    kinds = [(k, p, n) for k, p, n in secrets.KINDS] + [(k, p, 1) for k, p in secrets.MORE_KINDS]
    parts = []
    for nr, (kind, pattern, least) in enumerate(kinds):
        p = pattern.replace("'", "''")
        value = "regexp_replace(hits[i], '" + secrets._KEY.replace("'", "''") + "', '')" if kind == "assign" else "hits[i]"
        parts.append(
            f"SELECT r, {nr} AS nr, '{kind}' AS kind, {value} AS value, {least} AS least, length(hits[i]) AS size,"
            f" list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS start"
            f" FROM (SELECT r, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{p}') AS hits, regexp_split_to_array(t, '{p}') AS gaps FROM a))"
        )
    return " UNION ALL ".join(parts)


OP6_SQL = f"""
WITH a AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
     s AS (SELECT r, nr, kind, value, start::BIGINT AS b, (start + size)::BIGINT AS e FROM ({_secret_spans_sql()}) WHERE length(value) >= least),
     o AS (SELECT value, n >= {secrets.WIDE_OWNERS} OR n > 1 AND m >= {secrets.WIDE_REPOSITORIES} AS wide FROM (SELECT value, count(DISTINCT owner) AS n, count(DISTINCT (owner, repo)) AS m FROM s JOIN a USING (r) GROUP BY value)),
     g AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
                  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, nr) FILTER (WHERE nr < {len(secrets.KINDS)}), '') AS base,
                  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, nr) AS spans,
                  count(*) FILTER (WHERE NOT wide) AS n_live, count(*) FILTER (WHERE wide) AS n_example
           FROM s JOIN o USING (value) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM a LEFT JOIN g USING (r)
"""


def op7_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licences(table(spark, sf_dir, "documents"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))), ",")
    spans = F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])), ",")
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), families.alias("families"), spans.alias("spans"))


def op8_patience_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.drop_repeated_lines(table(spark, sf_dir, "documents"), count_col="n_removed")
    return out.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op9_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.load_pieces())


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_suffix_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))


def op12_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op13_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
     s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
     q AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
     p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
     f AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t, n),
     i AS (SELECT r, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * n) // l)) AS impact FROM p JOIN d USING (r), s),
     x AS (SELECT item_id, r, sum(k * weight * impact)::BIGINT AS score FROM q JOIN f USING (t) JOIN i USING (t) GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x JOIN d USING (r) WHERE score > 0)
WHERE rank <= 10
"""


QUERIES = {
    "op11_suffix_transducer": op11_suffix_transducer,
    "op12_random_indexing": op12_random_indexing,
    "op13_wavelet_search": op13_wavelet_search,
    "op1_containment": op1_containment,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_ownership": op6_secret_ownership,
    "op7_license_paragraphs": op7_license_paragraphs,
    "op8_patience_lines": op8_patience_lines,
    "op9_unigram_counts": op9_unigram_counts,
    "op10_kneser_ney": op10_kneser_ney,
    "op2_preference_pairs": op2_preference_pairs,
    "op3_soft_mixing": op3_soft_mixing,
    "op4_simhash_golay": op4_simhash_golay,
}

ORACLES: dict[str, str] = {
    "op1_containment": OP1_SQL,
    "op2_preference_pairs": OP2_SQL,
    "op5_quality_rules": OP5_SQL,
    "op6_secret_ownership": OP6_SQL,
    "op13_wavelet_search": OP13_SQL,
}
