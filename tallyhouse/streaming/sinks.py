"""Running a stream into a table below the shared folder.

Every micro-batch overwrites its own ``batch=N`` folder, so a batch that is
replayed after a failure replaces itself.  The checkpoint lies beside the table.

``fold`` puts the batches up to one, reduced to the newest row per key, into a
base table of their own and removes them, so readers open a bounded number of
folders.  A base counts once it is complete; readers take the newest one and the
batches after it, so they see either the old or the new, and a folded batch
that is replayed is not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.skew import top_n_per_key
from ..sources import folders


def write_batches(stream: DataFrame, mode: str, folder: str, **trigger) -> StreamingQuery:
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(store) \
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def run(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Process all that is there, then give the table of batches."""
    spark = stream.sparkSession
    schema = stream.schema
    write_batches(stream, mode, folder).awaitTermination()
    return batches(spark, folder, schema)


def batches(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All rows with their batch number, those of folded batches as the base keeps them."""
    numbered = StructType([*schema.fields, StructField("batch", LongType())])
    bases = folders.numbers(spark, f"{folder}/base", "upto", committed=True)
    base = bases[-1] if bases else -1
    later = [n for n in folders.numbers(spark, f"{folder}/table", "batch") if n > base]
    paths = [f"{folder}/table/batch={n}" for n in later]
    new = spark.read.schema(numbered).option("basePath", f"{folder}/table").parquet(*paths) if paths else spark.createDataFrame([], numbered)
    return spark.read.schema(numbered).parquet(f"{folder}/base/upto={base}").unionByName(new) if bases else new


def fold(spark: SparkSession, folder: str, schema: StructType, keys: list[str], upto: int) -> None:
    """Fold the batches up to ``upto``, which have to be complete, into a new
    base.  The folders of the base before the last, and the batches it holds,
    go; readers of the last one may go on."""
    bases = folders.numbers(spark, f"{folder}/base", "upto", committed=True)
    if bases and bases[-1] >= upto:
        return
    table = batches(spark, folder, schema).filter(F.col("batch") <= upto)
    top_n_per_key(table, keys, [F.col("batch").desc()], 1, rank="_rank").drop("_rank").write.mode("overwrite").parquet(f"{folder}/base/upto={upto}")
    for old in bases[:-1]:
        folders.remove(spark, f"{folder}/base/upto={old}")
    for n in folders.numbers(spark, f"{folder}/table", "batch"):
        if bases and n <= bases[-1]:
            folders.remove(spark, f"{folder}/table/batch={n}")


def last_complete(table: DataFrame) -> DataFrame:
    """The result of a complete-mode stream: its last batch."""
    newest = table.agg(F.max("batch").alias("batch"))
    return table.join(F.broadcast(newest), "batch").drop("batch")  # one row


def latest_per_key(table: DataFrame, keys: list[str]) -> DataFrame:
    """The result of an update-mode stream: the newest row of each key."""
    return top_n_per_key(table, keys, [F.col("batch").desc()], 1, rank="_rank").drop("_rank", "batch")


def appended(table: DataFrame) -> DataFrame:
    """The result of an append-mode stream."""
    return table.drop("batch")
