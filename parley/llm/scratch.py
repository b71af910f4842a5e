"""Intermediate tables in the shared checkpoint folder.

A table that is read more than once (or whose lineage should be cut) is
written as Parquet below the folder the cluster names in
``spark.checkpoint.dir`` and read back.  Every executor can read it, so a
lost executor costs a re-read and no recomputation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parley.session import ensure_checkpoint_dir, ship_package


BATCH_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder known, package importable in the Python workers, and
    Arrow batches of whole texts kept small (unless the session says otherwise)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(_ROWS, "10000") == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to shared storage and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
