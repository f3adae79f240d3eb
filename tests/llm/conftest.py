import pytest
from samples import prose

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, removed string, fp string, key string, spans string, "
    "n_words string, kept string, contaminated string, posterior string, rate double, held_out string, h1 int, words int, lines int, extra int, join_id int"
)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, 0, 9.0, "r", "f", "k", "sp", "w", "kept", "c", "p", 7.0, "h", 1, 2, 3, 4, 5)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    long = prose(1, 60_000)
    return [
        row(1, prose(2, 80)), row(1, prose(2, 80)), row(2, prose(2, 80)), row(3, None), row(4, ""), row(5, " \n\t "), row(None, prose(3, 70)), row(None, None, None, None),
        row(6, long), row(7, long), row(8, "é😀 word"), row(9, prose(4, 60), None, None), row(9, prose(5, 60)),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
