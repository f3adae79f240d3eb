"""Fitted models and raster features; most have planted-truth tests instead of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.scalars import apply_curve
from scoreloom.operators import models as L
from scoreloom.operators import raster
from scoreloom.operators.metrics import point_metrics as metrics
from scoreloom.plans.contract_queries import images
from scoreloom.plans.fixtures import SCORE_ROWS, score_rows, table
from scoreloom.registry import query


#: Components of an embedding.
WIDTH = 64


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", (F.col("label") >= 5).cast("int").alias("label"), (F.col("vec_id") % 40).alias("grp"), *(F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(WIDTH)))


@query()
def balanced_logistic(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    model = L.fit_logistic(rows, [f"x{i}" for i in range(WIDTH)])
    return rows.select("vec_id", "label", model.probability().alias("probability"))


@query()
def grouped_out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf).withColumn("grp", F.concat_ws(":", "grp", "label"))
    return L.leakage_verdict(L.out_of_fold(rows, [f"x{i}" for i in range(WIDTH)], "grp"))


@query()
def shuffled_label_control(spark: SparkSession, sf: str) -> DataFrame:
    """Labels dealt anew by cluster: the fair accuracy of a model on them shows what chance gives."""
    rows = _vectors(spark, sf).withColumn("grp", F.concat_ws(":", "grp", "label"))
    dealt = F.when(F.conv(F.substring(F.md5(F.concat(F.lit("shuffle|"), "grp")), 1, 4), 16, 10).cast("int") % 2 == 0, 1).otherwise(0)
    return L.leakage_verdict(L.out_of_fold(rows.withColumn("label", dealt), [f"x{i}" for i in range(WIDTH)], "grp"))


@query()
def platt_curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = L.fit_curve(score_rows(spark, sf).where("split = 'fit'"))
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(curve["xs"], curve["ys"], strict=True))], "knot int, x double, y double")


@query()
def curve_held_out(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy at 0.65 of rows the curve was not fitted on."""
    rows = score_rows(spark, sf)
    curve = L.fit_curve(rows.where("split = 'fit'"))
    return metrics(rows.where("split = 'eval'").withColumn("score", apply_curve(F.col("score"), curve["xs"], curve["ys"])), 0.65)


@query(f"""WITH {SCORE_ROWS}, d AS (SELECT image_id, CASE WHEN noise < 0.1 THEN NULL WHEN noise < 0.2 THEN 'nan'::DOUBLE ELSE score END AS x, split FROM score_rows), m AS (SELECT coalesce(quantile_cont(x, 0.5::DOUBLE), 0) AS m FROM d WHERE split = 'fit' AND x IS NOT NULL AND NOT isnan(x))
SELECT image_id, CASE WHEN x IS NULL OR isnan(x) THEN m ELSE x END AS x FROM d, m""")
def median_imputation(spark: SparkSession, sf: str) -> DataFrame:
    rows = score_rows(spark, sf).withColumn("x", F.when(F.col("noise") < 0.1, None).when(F.col("noise") < 0.2, F.lit(float("nan"))).otherwise(F.col("score")))
    return L.impute_medians(rows, ["x"], F.col("split") == "fit").select("image_id", "x")


@query()
def manifest_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Can the degradation metadata alone tell the label? Line items stand for records, orders for sources."""
    items = table(spark, sf, "lineitem")
    step = F.struct(F.when(F.col("l_returnflag") == "R", "jpeg").otherwise("rescale").alias("op"), F.lit(None).cast("string").alias("codec"), F.col("l_quantity").cast("double").alias("quality"), F.lit(512.0).alias("target"), F.lit(None).cast("double").alias("factor"), F.lit(None).cast("double").alias("device_pixel_ratio"))
    rows = items.select(
        F.col("l_orderkey").alias("source"), (F.col("l_orderkey") % 2).cast("int").alias("label"), F.col("l_returnflag").alias("chain"), F.lit("png").alias("source_format"), F.col("l_linestatus").alias("output_format"), F.array(step).alias("steps"), F.lit(1).alias("lossy_encode_count"),
        *(F.lit(640).alias(c) for c in ("source_width", "source_height", "output_width", "output_height")), F.col("l_extendedprice").alias("source_bytes"), F.col("l_extendedprice").alias("output_bytes"),
    )
    rows, columns = L.manifest_features(rows)
    return L.leakage_verdict(L.out_of_fold(rows.select("source", "label", *columns), columns, "source", balanced=False, alike=True))


@query()
def raster_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of vectors read as 64 x 64 grey images."""
    return images(spark, sf).select("vec_id", raster.extract(F.col("image"), F.lit(4096).cast("long")).alias("f")).select("vec_id", "f.*")


@query()
def pack_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """What appearance, spectra, block energies and weak statistics of the images tell of their label, each and together."""
    f = images(spark, sf).select("vec_id", raster.extract(F.col("image"), F.lit(4096).cast("long")).alias("f")).select("vec_id", "f.*")
    rows = f.withColumns({f"fft_{i}": F.get("fft_bands", i) for i in range(7)} | {f"dct_{i}": F.get("dct_bands", i) for i in range(5)})
    packs = {"geometry": ["log_pixels", "log_bytes", "log_density"], "appearance": ["luma_mean", "luma_std", "contrast_range", "noise_lapvar", "edge_x", "edge_y", "luma_entropy"], "fft_bands": [f"fft_{i}" for i in range(7)], "dct_bands": [f"dct_{i}" for i in range(5)], "weak": ["pixel_luma_mean", "pixel_luma_std", "pixel_edge_x", "pixel_clipped_fraction"]}
    packs["all_nuisance"] = sorted({c for p in packs.values() for c in p})
    labels = table(spark, sf, "embeddings").select("vec_id", (F.col("label") >= 5).cast("int").alias("label"), F.when(F.col("vec_id") % 2 == 0, "fit").otherwise("eval").alias("split"))
    return L.pack_nulls(rows.join(labels, "vec_id"), packs)
