"""Strict readers and writers of score tables, manifests, splits, curves, caches and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.operators.evidence import canonical_json, fixed
from scoreloom.sources.quoted import quoted_records

REQUIRED = ("image_id", "path", "label", "generator", "split", "score", "phash", "degradation", "cluster_id")
STEP = "array<struct<op:string,quality:int,subsampling:int,codec:string,target:string,factor:double,fraction:array<double>,device_pixel_ratio:double>>"
MANIFEST = f"records array<struct<src:string,out:string,chain:string,chain_index:int,lossy_encode_count:int,source_format:string,source_sha256:string,output_format:string,output_sha256:string,source_width:long,source_height:long,source_bytes:long,output_width:long,output_height:long,output_bytes:long,steps:{STEP}>>"
SPLITS = "phash_threshold int, ratios array<double>, group_assignment map<string,string>, splits map<string,array<struct<path:string,label:int,`group`:string,phash:string>>>"
CURVE = "id string, xs array<double>, ys array<double>, fittedOn string, tStar double, target double, modelSha256 string"


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file as written, byte-order mark removed; repeated and blank names are an error."""
    first = spark.read.option("lineSep", "\n").text(path).limit(1).first()
    if first is None:
        raise ValueError("the file is empty")
    parsed = spark.createDataFrame([(first[0].lstrip("﻿").rstrip("\r"),)], "line string")
    one = parsed.select(F.from_csv("line", ", ".join(f"c{i} string" for i in range(first[0].count(",") + 1)), {"escape": '"'}).alias("h")).first()["h"]
    names = [n for n in one if n is not None]
    if len({n.lower() for n in names}) < len(names) or any(not n.strip() for n in names):
        raise ValueError("column names must be distinct and not blank")
    return names


def read_score_csv(spark: SparkSession, path: str, required: Sequence[str] = REQUIRED, score: str = "score", file_col: str | None = None) -> DataFrame:
    """Score rows with typed columns, extras kept as text, and the score's own text in ``<score>_text``.

    A missing column or a ragged row fails; bad values become null, for the
    violations frame to report with their keys. Quoted line breaks do not keep
    several tasks from reading one file. ``file_col`` names a column for the
    file that a row comes from.
    """
    names = header_of(spark, path)
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = F.from_csv("record", schema, {"mode": "FAILFAST", "escape": '"'})
    raw = quoted_records(spark, path).select(parsed.alias("row"), *([F.col("file").alias(file_col)] if file_col else [])).select("row.*", *([file_col] if file_col else []))
    number = F.col(score).try_cast("double")
    return raw.withColumns({f"{score}_text": F.col(score), score: number, "label": F.col("label").try_cast("int")})


def read_many(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """Several score files in one frame, each row with the file it came from."""
    parts = [read_score_csv(spark, p, file_col="source_file", **options) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_score_csv(rows: DataFrame, path: str, generated: Sequence[str] = ()) -> None:
    """CSV with generated columns last and as fixed text of ten decimals."""
    kept = [F.col(c) for c in rows.columns if c not in generated]
    rows.select(*kept, *(fixed(F.col(c)).alias(c) for c in generated)).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def manifest_records(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, MANIFEST).select(F.inline("records"))


def split_records(documents: DataFrame) -> DataFrame:
    """One row for each record of a splits document."""
    return documents.select(F.explode("splits").alias("split", "records")).select("split", F.inline("records"))


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """``(path, label)`` of a JSON object from paths to 0 or 1."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("path", "label"))


def read_cache(spark: SparkSession, paths: Sequence[str], schema: str, key: str) -> DataFrame:
    """JSON lines of several files, the last file (and line) of a key winning."""
    parts = [spark.read.json(p, schema=schema).withColumn("_file", F.lit(i)).withColumn("_line", F.monotonically_increasing_id()) for i, p in enumerate(paths)]
    every = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy(key).orderBy(F.desc("_file"), F.desc("_line"))
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_file", "_line")


def read_npy(spark: SparkSession, content: DataFrame) -> DataFrame:
    """``(path, i, value)`` of one-dimensional ``.npy`` arrays given as ``binaryFile`` rows."""
    import io

    import numpy as np
    import pandas as pd

    def load(frames):
        for frame in frames:
            for path, data in frame[["path", "content"]].itertuples(index=False):
                values = np.load(io.BytesIO(data), allow_pickle=False).ravel().astype(float)
                yield pd.DataFrame({"path": path, "i": np.arange(len(values)), "value": values})

    return content.select("path", "content").mapInPandas(load, "path string, i long, value double")


def merge_indexes(*parts: DataFrame) -> DataFrame:
    """One snapshot of several indexes; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_report(row: DataFrame, path: str) -> None:
    """One row as JSON text with sorted keys."""
    columns: dict[str, Column] = {c: F.col(c) for c in row.columns}
    row.select(canonical_json(columns).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_log(spark: SparkSession, path: str, payload: str) -> dict[str, str]:
    """Append a record to a hash-chained log of JSON lines; a log whose tail does not match its own hash is refused."""
    import hashlib
    import json

    schema = "n long, payload string, previous_sha256 string, entry_sha256 string"
    try:
        tail = spark.read.json(path, schema=schema).orderBy(F.desc("n")).first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        tail = None
    digest = lambda before, text: hashlib.sha256(f"{before}|{text}".encode()).hexdigest()
    if tail is not None and tail.entry_sha256 != digest(tail.previous_sha256, tail.payload):
        raise ValueError("the log's tail does not match its hash")
    before = tail.entry_sha256 if tail else ""
    entry = {"n": tail.n + 1 if tail else 0, "payload": payload, "previous_sha256": before, "entry_sha256": digest(before, payload)}
    spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("append").text(path)
    return entry


def markdown(rows: DataFrame, title: str, most: int = 200) -> str:
    """A small result as a Markdown table."""
    head = f"## {title}\n\n| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else f'{v:.4f}' if isinstance(v, float) else str(v) for v in r)} |\n" for r in rows.limit(most).collect())
