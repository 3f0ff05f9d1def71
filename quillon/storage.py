"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a local session (as in tests) gets a folder of its own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillon-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this, jobs hand rows to Python workers in batches of ``rows``: for rows of many kilobytes each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
