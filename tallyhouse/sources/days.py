"""Tables kept in one folder per day, of which a change rewrites the touched days only.

Reading one needs no more than the days asked for: the reports' ``day``
argument prunes folders.  A row's day comes from one of its times; rows without
it have a folder of their own.  One writer at a time; run a failed change again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from . import folders

#: Spark's folder for rows whose day is null.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def with_day(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("day", F.col(column).cast("date"))


def _dealt(dated: DataFrame, key: str) -> DataFrame:
    """Ranges of (day, key): a hot day is several tasks and files, and quiet days share a task."""
    return dated.repartitionByRange(int(dated.sparkSession.conf.get("spark.sql.shuffle.partitions")), "day", F.xxhash64(key))


def write_days(dated: DataFrame, folder: str, key: str) -> None:
    """Write a table that has its ``day`` and a ``key``."""
    _dealt(dated, key).write.mode("overwrite").partitionBy("day").parquet(folder)


def read_days(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)


def in_days(days: list[dt.date | None]) -> Column:
    known = [d for d in days if d is not None]
    found = F.col("day").isin(known) if known else F.lit(False)
    return found | F.col("day").isNull() if None in days else found


def touched(*parts: DataFrame) -> list[dt.date | None]:
    """The days of some tables, one row each on the driver."""
    days = parts[0].select("day")
    for part in parts[1:]:
        days = days.unionByName(part.select("day"))
    return [r["day"] for r in days.distinct().collect()]


def replace_days(spark: SparkSession, folder: str, rows: DataFrame, days: list[dt.date | None], key: str) -> None:
    """Put ``rows`` in place of all rows of ``days``, the only days they may have.  Days without rows lose their folder."""
    if not days:
        return
    left = {r["day"] for r in rows.select("day").distinct().collect()}
    if left:
        _dealt(rows, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)
    for day in days:
        if day not in left:
            folders.remove(spark, f"{folder}/day={NO_DAY if day is None else day}")


def change_rows(spark: SparkSession, folder: str, schema: StructType | str, key: str, old: DataFrame, new: DataFrame) -> list[dt.date | None]:
    """Put the rows ``new`` in place of the rows with the keys of ``old`` (key,
    day) or of their own.  Gives the days that were read and rewritten; running it again changes nothing."""
    days = touched(old, new)
    held = read_days(spark, folder, schema).filter(in_days(days))
    gone = old.select(key).unionByName(new.select(key)).distinct()
    replace_days(spark, folder, held.join(gone, key, "left_anti").select(*held.columns).unionByName(new.select(*held.columns)), days, key)
    return days
