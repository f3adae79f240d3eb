"""Queries over tables whose signal lies in the rows, components or characters that a cut would leave out."""

import duckdb
from pyspark.sql import functions as F

from scoreloom import registry

registry.load()


def test_leakage_is_audited_over_all_line_items(spark, tmp_path):
    items = spark.range(800).selectExpr("id div 4 as l_orderkey", "cast(id % 4 + 1 as int) as l_linenumber").withColumn("leaks", (F.col("l_linenumber") > 1) & (F.col("l_orderkey") % 2 == 1))
    items = items.select("l_orderkey", "l_linenumber", F.when(F.col("leaks"), "R").otherwise("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), F.lit(5).alias("l_quantity"), F.lit(100.0).alias("l_extendedprice"))
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert registry.QUERIES["manifest_leakage"](spark, str(tmp_path)).first().verdict == "fail"


def test_every_component_of_an_embedding_counts(spark, tmp_path):
    label = (F.col("id") * 7 % 10).cast("int")
    signal = F.when(label >= 5, 0.5).otherwise(-0.5) + F.rand(1)
    parts = [signal if i == 40 else F.rand(i + 2) for i in range(64)]
    spark.range(400).select(F.col("id").alias("vec_id"), label.alias("label"), F.array(*parts).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = registry.QUERIES["balanced_logistic"](spark, str(tmp_path)).collect()
    assert sum((r.probability > 0.5) == (r.label == 1) for r in rows) > 0.95 * len(rows)
    assert registry.QUERIES["grouped_out_of_fold"](spark, str(tmp_path)).first().auc > 0.9


def test_slug_is_of_the_whole_text(spark, tmp_path):
    texts = [(1, "-" * 90 + "Deep Word"), (2, "a" + "! " * 60 + "b")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.slug for r in registry.QUERIES["slugify"](spark, str(tmp_path)).collect()} == {1: "deep-word", 2: "a-b"}


def against_sql(spark, folder, name):
    """A query's rows and those of its statement."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    expected = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, str(folder)).select(*expected.columns)
    return sorted(map(tuple, got.collect())), sorted(expected.fetchall())


def test_unrelated_texts_of_near_hashes_both_stay(spark, tmp_path):
    """The first 64 bits of these two texts' digests differ in 4."""
    texts = [(3, "561564"), (4, "4059114"), (5, "561564"), (70, "4059114"), (8, "other"), (9, None), (2, None)]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'s' source", "'en' lang").write.parquet(f"{tmp_path}/documents.parquet")
    got, expected = against_sql(spark, tmp_path, "greedy_dedupe")
    assert got == expected == [(2,), (3,), (4,), (8,)]


def test_unrelated_images_of_near_hashes_are_no_violation(spark, tmp_path):
    """The first 64 bits of the digests of these two keys differ in 4."""
    orders = [(561564, 1, "1-URGENT"), (4059114, 2, "1-URGENT"), (7, 2, "5-LOW"), (7, 1, "1-URGENT")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").selectExpr("*", "'F' o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "BUILDING"), (2, "MACHINERY")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got, expected = against_sql(spark, tmp_path, "split_violations")
    assert ("duplicate_id", "7") in expected
    assert [r for r in got if r[0] != "same_hash"] == expected and ("same_hash", "7") in got
