"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the text contracts define it.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch that goes to a Python worker inside ``small_batches``.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may run without the setting; it then gets a temporary
    folder. On a cluster a missing setting is an error, because a machine-local
    folder would lose data there.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (conf.get("spark.master") or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="scoreloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet, with the writer's ``options``, in the shared folder and return it as read back.

    Cuts lineage: what comes after survives the loss of executors without
    computing ``df`` anew.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scoreloom-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches for Python end at ``BATCH_BYTES`` or with one larger row, for queries that run inside.

    Spark by itself counts 10,000 rows, so long rows make batches of any size,
    which the executor and its worker both hold.
    """
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


#: Paths of the tables that this driver has written, in order.
written: list[str] = []


def forget(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Delete the tables written after the first ``since`` ones, but for the ``keep`` last: nothing may read them any more."""
    end = len(written) - keep
    for path in written[since:end]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del written[since:end]


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The names ``wanted``, each with underscores put in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
