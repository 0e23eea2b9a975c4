"""Rate limits whose windows start at a client's first request, in batch.

A window starts with the first request after the end of the one before.  So
the requests that start windows form a chain: from a start to the first
request at or after its end.  The chain is followed by pointer doubling over
all clients at once, a round per doubling, and begins anew after every pause
of a window's length; quiet clients thus need no round at all.

A hot client is no single task: requests of one microsecond count as one row,
and the search for a pointer's target stays within a small piece of time, of which a
client has ``PIECES`` a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import run_dir
from .skew import join_measured

PIECES = 16


def micros(column: str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session's time zone."""
    at = F.col(column)
    second = F.expr(f"CAST(date_part('SECOND', `{column}`) * 1000000 AS BIGINT)")
    return F.unix_date(at.cast("date")).cast("bigint") * 86_400_000_000 + F.hour(at).cast("bigint") * 3_600_000_000 \
        + F.minute(at).cast("bigint") * 60_000_000 + second


def time_of(us: Column) -> Column:
    """The zone-free timestamp of microseconds since 1970."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(us.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def pointers(times: DataFrame, client: str, length: int) -> DataFrame:
    """(client, us, n, starts, target) from times (client, us, n): whether a
    pause of a window's length lies before, and the first request at or after
    ``us`` + ``length``."""
    piece = lambda us: F.floor(us * PIECES / length).cast("bigint")
    us = F.col("us")
    none = F.lit(None).cast("bigint")
    real = times.select(client, piece(us).alias("piece"), us.alias("at"), us.alias("real"), none.alias("asks"), "n")
    asks = times.select(client, piece(us + length).alias("piece"), (us + length).alias("at"), none.alias("real"), us.alias("asks"), none.alias("n"))
    both = real.unionByName(asks)
    # Within a piece the targets come from below, the requests before from above.
    own = Window.partitionBy(client, "piece")
    falling = own.orderBy(F.col("at").desc(), F.col("real").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    rising = own.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_target", F.last("real", ignorenulls=True).over(falling)) \
        .withColumn("_before", F.last("real", ignorenulls=True).over(rising))
    # Across pieces: one row per piece and client.
    pieces = both.groupBy(client, "piece").agg(F.min("real").alias("first"), F.max("real").alias("last"))
    along = Window.partitionBy(client)
    pieces = pieces.select(
        client, "piece", F.min("first").over(along.orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_next"),
        F.max("last").over(along.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)).alias("_prior"))
    found = join_measured(both, pieces, [client, "piece"])
    before = F.coalesce("_before", "_prior")
    return found.groupBy(client, F.coalesce("real", "asks").alias("us")).agg(
        F.max("n").alias("n"),
        F.bool_or(F.when(F.col("real").isNotNull(), before.isNull() | (F.col("real") - before >= length))).alias("starts"),
        F.max(F.when(F.col("asks").isNotNull(), F.coalesce("_target", "_next"))).alias("target"))


def window_starts(found: DataFrame, client: str) -> DataFrame:
    """(client, us) of all requests that start a window, from ``pointers``."""
    spark, folder = found.sparkSession, run_dir(found.sparkSession, "limits")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    sure = found.filter("starts").select(client, "us")
    # A pointer to a request after a pause leads nowhere new.
    jumps = found.filter("target IS NOT NULL").select(client, "us", "target") \
        .join(sure.withColumnRenamed("us", "target"), [client, "target"], "left_anti").select(client, "us", "target")
    jumps, reached, n = written(jumps, "jumps-0"), written(sure, "starts-0"), 0
    parts = [f"{folder}/starts-0"]
    while not jumps.isEmpty():
        n += 1
        new = reached.join(jumps, [client, "us"]).select(client, F.col("target").alias("us")).distinct()
        written(new.join(reached, [client, "us"], "left_anti"), f"starts-{n}")
        parts.append(f"{folder}/starts-{n}")
        reached = spark.read.schema(sure.schema).parquet(*parts)
        further = jumps.select(client, F.col("us").alias("target"), F.col("target").alias("_further"))
        jumps = written(jumps.join(further, [client, "target"]).select(client, "us", F.col("_further").alias("target")), f"jumps-{n}")
    return reached


def anchored_windows(requests: DataFrame, client: str, length_seconds: int, at: str = "created_at") -> DataFrame:
    """(window_start, client, requests) of every window.  Requests without a client or time do not count.
    Runs at once: every doubling is written to the shared folder."""
    length = length_seconds * 1_000_000
    times = requests.filter(F.col(client).isNotNull() & F.col(at).isNotNull()) \
        .groupBy(client, micros(at).alias("us")).agg(F.count(F.lit(1)).alias("n"))
    folder = run_dir(requests.sparkSession, "pointers")
    found = pointers(times, client, length)
    found.write.parquet(folder)
    found = requests.sparkSession.read.schema(found.schema).parquet(folder)
    starts = window_starts(found, client)
    # A slot of a window's length holds one start at most, and a window reaches into the next slot.
    slot = F.floor(F.col("us") / length)
    held = starts.withColumn("slot", slot).select(client, "us", "slot", F.explode(F.array(F.lit(0), F.lit(1))).alias("_later")) \
        .groupBy(client, (F.col("slot") + F.col("_later")).alias("slot")) \
        .agg(F.max(F.when(F.col("_later") == 0, F.col("us"))).alias("_own"), F.max(F.when(F.col("_later") == 1, F.col("us"))).alias("_earlier"))
    placed = join_measured(found.select(client, "us", "n", slot.alias("slot")), held, [client, "slot"])
    start = F.when(F.col("_own") <= F.col("us"), F.col("_own")).otherwise(F.col("_earlier"))
    return placed.groupBy(start.alias("_start"), client).agg(F.sum("n").alias("requests")) \
        .select(time_of(F.col("_start")).alias("window_start"), client, "requests")


def breaches(requests: DataFrame, client: str, limit: int, length_seconds: int, at: str = "created_at") -> DataFrame:
    """Windows with more than ``limit`` requests."""
    return anchored_windows(requests, client, length_seconds, at).filter(F.col("requests") > limit)
