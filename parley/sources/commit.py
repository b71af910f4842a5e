"""Folders that are replaced as a whole: write beside, then swap.

A table is written to a hidden folder next to its own, and takes its place by
renames only when every task has succeeded, so a failed write leaves the old
rows as they were and a job may read the table it replaces.  While the swap is
under way the old folder is kept under a hidden name; a swap that was cut
short is taken back by the next reader or writer (``settle``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _beside(spark: SparkSession, p, tag: str):
    return spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{tag}-{p.getName()}")


def settle(spark: SparkSession, path: str) -> None:
    """Put the old folder back if a swap ended between its two renames."""
    fs, p = _folder(spark, path)
    old = _beside(spark, p, "replaced")
    if fs.exists(old):
        if fs.exists(p):
            fs.delete(old, True)
        elif not fs.rename(old, p):
            raise OSError(f"could not restore {p} from {old}")


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """``write(folder)`` fills a new folder, which then takes the place of ``path``."""
    fs, p = _folder(spark, path)
    settle(spark, path)
    new, old = _beside(spark, p, f"staged-{uuid.uuid4().hex}"), _beside(spark, p, "replaced")
    try:
        write(new.toString())
        had = fs.exists(p)
        if had and not fs.rename(p, old):
            raise OSError(f"could not move {p} away")
        if not fs.rename(new, p):
            if had:
                fs.rename(old, p)
            raise OSError(f"could not move {new} to {p}")
        if had:
            fs.delete(old, True)
    finally:
        if fs.exists(new):
            fs.delete(new, True)


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def missing(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return not fs.exists(p)
