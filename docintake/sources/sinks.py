"""Sinks: JSON listings, batch-idempotent appends, and the shared folder for what queries write down."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). A local session may leave it
    unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="docintake-"))
    return f"{base.rstrip('/')}/docintake-{label}-{uuid.uuid4().hex}"


def write_listing(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    df.write.mode("overwrite").json(path)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def append_batch(path: str):
    """A foreachBatch function that writes each micro-batch into a folder of its own, so that a batch run again
    after a failure replaces itself instead of doubling its rows."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def upsert_snapshot(old: DataFrame, path: str) -> DataFrame:
    """Write a new snapshot of a state table and read it back; the old one stays until it is dropped by its owner."""
    old.write.mode("errorifexists").parquet(path)
    return old.sparkSession.read.schema(old.schema).parquet(path)
