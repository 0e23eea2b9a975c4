"""Point balances kept up to date by a stream, without state that grows with an hour's entries.

Every micro-batch adds its entries to one table and, per (user, hour) it
touches, writes that hour's new state to another: entries, sum, lowest running
sum, and the last entry counted.  Entries that all come after the last one
extend the old state (sums add up, lows compare).  Where an entry comes late,
that (user, hour) alone is computed again from its stored entries, however late it is.

Folders are ``day=D/batch=N``; a replayed batch overwrites its own and reads
only older ones, so it gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import balances_from_buckets, hour_number
from ..operators.skew import RANGE_ROWS, bucket_starts, cut_buckets

KEY = ["day", "user_id", "hour"]
ENTRIES = "user_id bigint, entry_id bigint, created_at timestamp_ntz, amount bigint, hour bigint, day date, batch bigint"
STATES = ("user_id bigint, hour bigint, entries bigint, total bigint, low bigint, "
          "last struct<created_at: timestamp_ntz, entry_id: bigint>, day date, batch bigint")


def hour_states(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per (day, user, hour): first and last entry, entries, sum and lowest running sum."""
    order = ["created_at", "entry_id"]
    cut = cut_buckets(rows.withColumn("_owner", F.struct(*KEY)), "_owner", order, F.col("hour"), range_rows)
    inside = Window.partitionBy("_owner", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = cut.withColumn("_sum", F.sum("amount").over(inside)).groupBy("_owner", "_bucket").agg(
        F.sum("amount").alias("total"), F.min("_sum").alias("low"), F.count(F.lit(1)).alias("entries"),
        F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))
    return bucket_starts(ranges, "_owner").groupBy("_owner").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("entries").alias("entries"),
        F.sum("total").alias("total"), F.min("_low").alias("low")).select("_owner.*", "first", "last", "entries", "total", "low")


def table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def newest(states: DataFrame) -> DataFrame:
    """The newest state of each (day, user, hour)."""
    return states.groupBy(*KEY).agg(F.max_by(F.struct("entries", "total", "low", "last"), "batch").alias("_s")).select(*KEY, "_s.*")


def store(spark: SparkSession, folder: str, batch: DataFrame, number: int, range_rows: int = RANGE_ROWS) -> None:
    """Take one micro-batch of entries (user_id, entry_id, created_at, amount) in.  Days are listed on the driver, one row each."""
    def put(df: DataFrame, name: str) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("day", "batch").parquet(f"{folder}/{name}")

    put(batch.select("user_id", "entry_id", "created_at", F.col("amount").cast("bigint").alias("amount"), hour_number().alias("hour"),
                     F.col("created_at").cast("date").alias("day")), "entries")
    if not _there(spark, f"{folder}/entries"):
        return
    stored = table(spark, folder, "entries", ENTRIES)
    days = [r["day"] for r in stored.filter(F.col("batch") == number).select("day").distinct().collect()]
    stored = stored.filter(F.col("day").isin(days) & (F.col("batch") <= number))
    new = hour_states(stored.filter(F.col("batch") == number), range_rows)
    if not _there(spark, f"{folder}/states"):
        put(new.drop("first"), "states")
        return
    old = newest(table(spark, folder, "states", STATES).filter(F.col("day").isin(days) & (F.col("batch") < number)))
    old = old.select(*KEY, *(F.col(c).alias(f"old_{c}") for c in ("entries", "total", "low", "last")))
    met = new.join(old, KEY, "left")
    late = F.coalesce(F.col("first") <= F.col("old_last"), F.lit(False))
    zero = F.lit(0).cast("bigint")
    extended = met.filter(~late).select(
        *KEY, "last", (F.coalesce("old_entries", zero) + F.col("entries")).alias("entries"),
        (F.coalesce("old_total", zero) + F.col("total")).alias("total"),
        F.least("old_low", F.coalesce("old_total", zero) + F.col("low")).alias("low"))
    again = hour_states(stored.join(met.filter(late).select(*KEY), KEY, "left_semi"), range_rows).drop("first")
    put(extended.unionByName(again), "states")


def _there(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def maintain(entries: DataFrame, folder: str, range_rows: int = RANGE_ROWS, **trigger) -> StreamingQuery:
    """Run a stream of entries into the tables below ``folder``."""
    return entries.writeStream.foreachBatch(lambda batch, n: store(batch.sparkSession, folder, batch, n, range_rows)) \
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The state of every (user, hour), for ``balances_from_buckets``."""
    return newest(table(spark, folder, "states", STATES)).withColumnRenamed("hour", "_bucket")


def balances(spark: SparkSession, folder: str) -> DataFrame:
    """Balance per user over all entries taken in so far."""
    return balances_from_buckets(buckets(spark, folder))
