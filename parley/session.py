"""Session helpers: a tuned SparkSession and a reliable checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid
import warnings
import zipfile

from pyspark.sql import DataFrame, SparkSession


# tables written by `materialize` and its like: a name and a uuid
SCRATCH_NAME = re.compile(r"^[A-Za-z].*-[0-9a-f]{32}(-tail|-clock)?$")


def get_spark(master: str | None = None, app: str = "parley",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with AQE, skew-join handling and Arrow on.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    shuffle partition count then stays whatever the cluster configured.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoint files of materialised tables are removed once unreferenced
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = "16g"   # local mode: the driver is the executor
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Only a local run (one machine)
    may go without: it gets a private folder under the temp dir."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="parley-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


def materialize(df: DataFrame) -> DataFrame:
    """``df`` stored once as Parquet in the shared checkpoint folder and read back.

    Used where a table is read several times (split, batches): readers take
    only the columns they need, and a lost executor re-reads instead of
    recomputing from the raw input.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession, older_than_hours: float = 24.0) -> int:
    """Remove the tables that jobs have left in the checkpoint folder and that were
    not written to for so long; returns how many.  A result that is still read
    needs its tables, so leave more time than the longest job takes."""
    base = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    before, gone = (time.time() - older_than_hours * 3600) * 1000, 0
    for f in fs.listStatus(base) if fs.exists(base) else []:
        if SCRATCH_NAME.search(f.getPath().getName()) and f.getModificationTime() < before:
            gone += bool(fs.delete(f.getPath(), True))
    return gone


def parallelism(spark: SparkSession) -> int:
    try:
        return max(1, spark.sparkContext.defaultParallelism)
    except Exception:  # pragma: no cover - connect sessions
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``parley`` importable in the Python workers (pandas UDFs, state
    functions) whatever their working directory: the package is zipped once
    per application and added with ``addPyFile``."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    try:
        out = os.path.join(tempfile.mkdtemp(prefix="parley-pkg-"), "parley.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for base, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(base, f)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(out)
    except Exception as ex:  # noqa: BLE001 - JVM-only queries still work without it
        warnings.warn(f"could not ship the parley package to the workers: {ex}")
        return
    _SHIPPED.add(app)
