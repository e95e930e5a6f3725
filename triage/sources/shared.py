"""Tables in the folder that all executors share: they cut the lineage of loops and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset: one folder of our own for an application whose driver and executors are one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="triage-shared-")
    return _OWN[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/triage/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_and_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``written``, and how many rows that were, which the write itself counts."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


#: Rows of a bucket of ``bucketed``, about.
BUCKET = 200_000


def bucketed(df: DataFrame, name: str, key: str, rows: int) -> tuple[str, int]:
    """``df`` as a table of the catalog in the shared folder, dealt by ``key``: (the table's name, its number of buckets).

    What is dealt into as many parts by the same key is joined with it without moving it again. ``rows``: about how many there are.
    """
    n, table = max(1, -(-rows // BUCKET)), f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", f"{shared_dir(df.sparkSession)}/triage/{table}").saveAsTable(table)
    return table, n


@contextmanager
def joined_as_dealt(spark: SparkSession) -> Iterator[None]:
    """What is written within is planned so that two sides that are dealt alike by one of a join's keys stay as they lie; else both would be moved by all keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
