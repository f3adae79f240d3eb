"""The corpus pipeline: five stages from raw documents to a weighted training mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm import decontaminate, linedup, mixing, simhash, toxicity
from scoreloom.llm.common import forget, stage, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; null and empty texts are scored as texts without a word. Nothing is rejected without labels of both classes."""
    return toxicity.drop_toxic(docs, docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less blocks of lines that an earlier one has; null and empty texts and rows without an id stay as they are."""
    return linedup.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group; of texts without a word one, of an id with texts in several groups a row of each, of groups without any id all."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows are decided alike."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a positive rate with the column ``rate``; null and empty texts have the rate of the mean posterior, an empty table gives none."""
    return mixing.mixed(docs, mixing.labelled_domains(docs, table(spark, sf_dir, "labels")), mixing.TARGETS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]

#: Trained scores, alignment and iterated components have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in turn, each written before the next one reads it; what a stage left behind is deleted then."""
    docs, since = table(spark, sf_dir, "documents"), len(written)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        forget(spark, since)
    return docs
