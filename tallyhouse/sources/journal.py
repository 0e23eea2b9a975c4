"""Tables to which a batch of changes is applied once, however often it is delivered.

A table is a row of versions.  A change writes the next version's table and,
when that is complete, its journal: the ids of all batches applied so far.  The
version with the newest complete journal is the current one, so after a failure
between the two writes the old one stays current and the next try overwrites
what was left.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import folders


def create(table: DataFrame, folder: str) -> None:
    """Version 0; a table that is there already stays."""
    if not folders.numbers(table.sparkSession, f"{folder}/journal", "version", committed=True):
        _write(table.sparkSession, folder, 0, table, None)


def current(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/table/version={_newest(spark, folder)}")


def applied(spark: SparkSession, folder: str) -> DataFrame:
    """(batch_id) of all batches in the current version."""
    return spark.read.schema("batch_id string").parquet(f"{folder}/journal/version={_newest(spark, folder)}")


def apply_once(spark: SparkSession, folder: str, batch_id: str, change: Callable[[DataFrame], DataFrame], keep: int = 2) -> bool:
    """Apply ``change`` to the current table unless the batch has been; the
    last ``keep`` versions stay, for readers that have begun.  False for a repeat."""
    if not applied(spark, folder).filter(F.col("batch_id") == batch_id).isEmpty():
        return False
    newest = _newest(spark, folder)
    _write(spark, folder, newest + 1, change(current(spark, folder)), batch_id)
    for old in folders.numbers(spark, f"{folder}/journal", "version"):
        if old <= newest + 1 - keep:
            folders.remove(spark, f"{folder}/journal/version={old}")
            folders.remove(spark, f"{folder}/table/version={old}")
    return True


def _newest(spark: SparkSession, folder: str) -> int:
    return folders.numbers(spark, f"{folder}/journal", "version", committed=True)[-1]


def _write(spark: SparkSession, folder: str, version: int, table: DataFrame, batch_id: str | None) -> None:
    table.write.mode("overwrite").parquet(f"{folder}/table/version={version}")
    ids = spark.createDataFrame([(batch_id,)] if batch_id is not None else [], "batch_id string")
    if version:
        ids = applied(spark, folder).unionByName(ids)
    ids.coalesce(1).write.mode("overwrite").parquet(f"{folder}/journal/version={version}")
