"""Boxes, viewports, dimension tables of conditions, and scores from a provider."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.functions import layout as B
from scoreloom.functions.conditions import CONDITIONS, register
from scoreloom.functions.keyed import uniform, uniform_sql
from scoreloom.plans.fixtures import table
from scoreloom.registry import query

_BOX = "SELECT user_id AS page, event_id AS id, (event_id * 37 % 1900 - 200)::DOUBLE AS l, (event_id * 53 % 1400 - 200)::DOUBLE AS t, (event_id * 37 % 1900 - 160 + event_id % 300)::DOUBLE AS r, (event_id * 53 % 1400 - 160 + event_id % 200)::DOUBLE AS b FROM events"
W, H = 1365.0, 900.0


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    d = lambda c: c.cast("double")
    rect = F.struct(d(k * 37 % 1900 - 200).alias("left"), d(k * 53 % 1400 - 200).alias("top"), d(k * 37 % 1900 - 160 + k % 300).alias("right"), d(k * 53 % 1400 - 160 + k % 200).alias("bottom"))
    return table(spark, sf, "events").select(F.col("user_id").alias("page"), k.alias("id"), rect.alias("rect"))


_VIS = f"greatest(0, least(r, {W}) - greatest(l, 0)) * greatest(0, least(b, {H}) - greatest(t, 0))"
_DIST = f"power((greatest(l, 0) + least(r, {W})) / 2 - {W / 2}, 2) + power((greatest(t, 0) + least(b, {H})) / 2 - {H / 2}, 2)"


@query(f"WITH x AS ({_BOX}) SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY {_VIS} DESC, {_DIST}, t, l, id) AS place FROM x WHERE b > 0 AND r > 0 AND t < {H} AND l < {W}")
def viewport_order(spark: SparkSession, sf: str) -> DataFrame:
    b, w, h = B.box("rect"), F.lit(W), F.lit(H)
    order = Window.partitionBy("page").orderBy(*B.viewport_order(b, w, h), "id")
    return _boxes(spark, sf).where(B.in_viewport(b, w, h)).select("page", "id", F.row_number().over(order).cast("long").alias("place"))


@query(f"WITH x AS ({_BOX}) SELECT id, l > {W} * 0.45 AND least(r - l, b - t) > 160 AS pane, l < 0 - 4 OR t < 0 - 4 OR r > {W} + 4 OR b > {H} + 4 AS occludes FROM x")
def preview_and_occlusion(spark: SparkSession, sf: str) -> DataFrame:
    b, page = B.box("rect"), (F.lit(0.0), F.lit(0.0), F.lit(W), F.lit(H))
    return _boxes(spark, sf).select("id", B.is_preview_pane(b, F.lit(W)).alias("pane"), B.occludes(page, b).alias("occludes"))


@query(f"WITH x AS ({_BOX}), a AS (SELECT id, greatest(l, 0) AS l, greatest(t, 0) AS t, least(r, {W}) AS r, least(b, {H}) AS b FROM x) SELECT id, CASE WHEN r - l > 12 AND b - t > 12 THEN least(l + 6, r) ELSE 0 END AS x, CASE WHEN r - l > 12 AND b - t > 12 THEN least(t + 6, b) ELSE 0 END AS y, r - l > 12 AND b - t > 12 AS visible FROM a")
def badge_anchor(spark: SparkSession, sf: str) -> DataFrame:
    clip = (F.lit(0.0), F.lit(0.0), F.lit(W), F.lit(H))
    return _boxes(spark, sf).select("id", B.anchor(B.box("rect"), clip, 6.0, 12.0).alias("a")).select("id", "a.*")


_FIT = "CASE p_partkey % 4 WHEN 0 THEN 'contain' WHEN 1 THEN 'none' WHEN 2 THEN 'scale-down' ELSE 'cover' END"
_FIT_W, _FIT_H = "(p_partkey * 37 % 700)::DOUBLE", "(10 + p_size * 11)::DOUBLE"


@query(f"""WITH i AS (SELECT p_partkey, {_FIT} AS fit, {_FIT_W} AS w, {_FIT_H} AS h FROM part), c AS (SELECT *, least(300 / nullif(w, 0), 200 / h) AS contain FROM i),
s AS (SELECT p_partkey, fit, coalesce(w * scale, 300) AS pw, coalesce(h * scale, 200) AS ph FROM (SELECT *, CASE fit WHEN 'contain' THEN contain WHEN 'none' THEN 1 WHEN 'scale-down' THEN least(1, contain) END AS scale FROM c)),
r AS (SELECT *, 20 + (300 - pw) * 0.25::DOUBLE AS x, 10 + (200 - ph) * 0.5::DOUBLE AS y FROM s)
SELECT p_partkey, fit, round(greatest(20, x), 6) AS "left", round(greatest(10, y), 6) AS top, round(least(320, x + pw), 6) AS "right", round(least(210, y + ph), 6) AS bottom FROM r""")
def fitted_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    """What parts, read as pictures of many sizes, paint of one box under each way of fitting."""
    w, h = (F.expr(x.replace("::DOUBLE", "").join(("cast(", " as double)"))) for x in (_FIT_W, _FIT_H))
    r = B.fitted((F.lit(20.0), F.lit(10.0), F.lit(320.0), F.lit(210.0)), w, h, F.expr(_FIT), F.lit(0.25), F.lit(0.5))
    return table(spark, sf, "part").select("p_partkey", F.expr(_FIT).alias("fit"), *(F.round(r[k], 6).alias(k) for k in ("left", "top", "right", "bottom")))


#: Transform chains and their weights; delivery conditions (dimension tables, fixed values of this library).
CHAINS = [("clean", 3.0), ("jpeg_once", 3.0), ("jpeg_twice", 2.0), ("webp", 2.0), ("rescale", 2.0), ("crop", 1.0), ("screen", 1.0), ("held_out", 0.0)]
_TOTAL = sum(w for _, w in CHAINS)


def chain_table(spark: SparkSession) -> DataFrame:
    """Chains with the cumulative range of their weight in [0, 1)."""
    low, out = 0.0, []
    for name, weight in CHAINS:
        out.append((name, low / _TOTAL, (low + weight) / _TOTAL))
        low += weight
    return spark.createDataFrame(out, "chain string, low double, high double")


_CUM = []
for _n, _w in CHAINS:
    _CUM.append((_n, sum(w for _, w in CHAINS[: len(_CUM)]) / _TOTAL, sum(w for _, w in CHAINS[: len(_CUM) + 1]) / _TOTAL))


@query(f"WITH c(chain, low, high) AS (VALUES {', '.join(f'({n!r}, {a!r}::DOUBLE, {b!r}::DOUBLE)' for n, a, b in _CUM)}), u AS (SELECT doc_id, {uniform_sql('doc_id::VARCHAR || chr(58) || 1')} AS u FROM documents) SELECT doc_id, chain FROM u JOIN c ON u >= low AND u < high")
def weighted_chain_choice(spark: SparkSession, sf: str) -> DataFrame:
    """A chain for each record by its keyed number against cumulative weights; a chain of weight 0 is never chosen."""
    u = uniform(F.concat(F.col("doc_id").cast("string"), F.lit(":1")))
    docs = table(spark, sf, "documents").select("doc_id", u.alias("u"))
    return docs.join(F.broadcast(chain_table(spark)), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("doc_id", "chain")


@query("SELECT doc_id, cell, CASE WHEN ('0x' || substr(md5(doc_id || '|' || cell), 1, 4))::INT % 2 = 0 THEN 'jpeg' ELSE 'webp' END AS codec, 60 + ('0x' || substr(md5(doc_id || '|' || cell), 5, 4))::INT % 31 AS quality FROM documents CROSS JOIN (SELECT unnest(range(0, 6)) AS cell)")
def stress_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every record in six stress cells with a codec and quality chosen by hash: a map-side expansion."""
    key = F.md5(F.concat_ws("|", "doc_id", "cell"))
    number = lambda at: F.conv(F.substring(key, at, 4), 16, 10).cast("int")
    cells = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("cell"))
    return cells.select("doc_id", F.col("cell").cast("long").alias("cell"), F.when(number(1) % 2 == 0, "jpeg").otherwise("webp").alias("codec"), (60 + number(5) % 31).alias("quality"))


_CONDITIONS = ", ".join(f"({i}, {c[0]!r}, {c[1] or 'NULL'}, {c[2] or 'NULL'}::DOUBLE, {repr(c[3]) if c[3] else 'NULL'}, {c[4] or 'NULL'})" for i, c in enumerate(CONDITIONS))
_W, _H = "p_partkey * 13 % 2400 + 1", "p_size * 40"


@query(f"""WITH c(i, condition, longest, scale, codec, quality) AS (VALUES {_CONDITIONS}), p AS (SELECT p_partkey, {_W} AS w, {_H} AS h FROM part),
s AS (SELECT *, coalesce(CASE WHEN greatest(w, h) > longest THEN longest::DOUBLE / greatest(w, h) END, scale, 1) AS f FROM p, c)
SELECT p_partkey, condition, greatest(1, round_even(w * f, 0))::INT AS width, greatest(1, round_even(h * f, 0))::INT AS height, codec, quality::INT AS quality FROM s""")
def delivery_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Every part, read as a picture, under each of the eleven conditions, by a lateral join with the table function."""
    register(spark)
    table(spark, sf, "part").selectExpr("p_partkey", f"cast({_W} as int) as w", f"{_H} as h").createOrReplaceTempView("pictures_to_deliver")
    return spark.sql("SELECT p.p_partkey, c.* FROM pictures_to_deliver p, LATERAL delivery_conditions(p.w, p.h, 'width, height, codec, quality') c")


def with_provider(rows: DataFrame, key: str, provider: Callable[[list[str]], list[dict[str, float]]], strategies: list[str]) -> DataFrame:
    """``rows(key)`` with one column for each strategy from a scoring function, called once a batch.

    The function stands for an inference engine; this library has none.
    """
    schema = f"{key} string, " + ", ".join(f"{s} double" for s in strategies)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = pd.DataFrame(provider(frame[key].tolist()), columns=strategies)
            yield pd.concat([frame[[key]].reset_index(drop=True), scores], axis=1)

    return rows.select(F.col(key).cast("string").alias(key)).mapInPandas(run, schema)


def hashed_scores(keys: list[str]) -> list[dict[str, float]]:
    out = []
    for k in keys:
        u = [int(hashlib.sha256(f"{k}|{i}".encode()).hexdigest()[:13], 16) / 2**52 for i in range(3)]
        out.append({"mean": sum(u) / 3, "max": max(u)})
    return out


_U = [uniform_sql(f"doc_id::VARCHAR || '|{i}'") for i in range(3)]


@query(f"SELECT doc_id::VARCHAR AS doc_id, ({_U[0]} + {_U[1]} + {_U[2]}) / 3 AS mean, greatest({_U[0]}, {_U[1]}, {_U[2]}) AS max FROM documents")
def provider_scores(spark: SparkSession, sf: str) -> DataFrame:
    return with_provider(table(spark, sf, "documents"), "doc_id", hashed_scores, ["mean", "max"])
