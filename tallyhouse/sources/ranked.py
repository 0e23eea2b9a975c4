"""Sorted copies of a table for deep pages.

The copy is one sorted file per ``SORTED_ROWS`` rows, whatever the length of a
range; every row carries its place (file and line), and Parquet pages of
``range_rows`` rows let a filter on the place skip the rest.  A rank table holds
each file's row count and the number of rows before it.  A page then reads the
ranges it lies in, usually one, however deep it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

RANGE_ROWS = 100_000
#: Rows of a sorted file.  Files, and with them the tasks and the sampled keys that the driver sees, number one per so many rows.
SORTED_ROWS = 250_000
#: Bits of a place that number the rows of a file; those above number the files.
LINE_BITS = 33


def write_ranked(df: DataFrame, order: list[Column], folder: str, range_rows: int = RANGE_ROWS) -> None:
    """``order`` has to end in a unique key.  Ranges hold about ``range_rows`` rows."""
    spark, schema = df.sparkSession, df.schema
    files = max(1, -(-df.count() // SORTED_ROWS))
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()) \
        .write.mode("overwrite").option("parquet.page.row.count.limit", range_rows).parquet(f"{folder}/rows")
    # Counted in what was written, so that the ranks fit it.
    counts = spark.read.schema(_placed(schema)).parquet(f"{folder}/rows") \
        .groupBy(F.shiftright("_place", LINE_BITS).alias("file_no")).agg(F.count(F.lit(1)).alias("held"))
    # A window over one row per file.
    before = Window.partitionBy(F.lit(1)).orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    counts.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranks")


def _placed(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("_place", LongType())])


def read_page(spark: SparkSession, folder: str, schema: StructType, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """The page by position, in ``order``; the same rows as ``ordering.page``.  ``schema`` is that of the table."""
    first, last = (number - 1) * size, number * size
    start = F.shiftleft("file_no", LINE_BITS)
    begin, end = spark.read.schema("file_no bigint, held bigint, before bigint").parquet(f"{folder}/ranks") \
        .filter((F.col("before") < last) & (F.col("before") + F.col("held") > first)) \
        .agg(F.min(start + F.greatest(first - F.col("before"), F.lit(0))),
             F.max(start + F.least(last - F.col("before"), F.col("held")) - 1)).first()
    # Places ascend with the order, so the page lies between two of them; past the end there is none.
    rows = spark.read.schema(_placed(schema)).parquet(f"{folder}/rows")
    inside = F.lit(False) if begin is None else F.col("_place").between(begin, end)
    return rows.filter(inside).drop("_place").orderBy(*order).limit(size)
