"""Stream transformations.  All are built-in operators; none runs Python per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_event_time(df: DataFrame, column: str = "created_at", delay: str | None = None, name: str = "at") -> DataFrame:
    """Event time as TIMESTAMP (streams do not take zone-free ones), with a
    watermark where a delay is given."""
    timed = df.withColumn(name, F.col(column).cast("timestamp"))
    return timed.withWatermark(name, delay) if delay else timed


def rate_limit_breaches(requests: DataFrame, client: str, limit: int, window: str, delay: str | None = None) -> DataFrame:
    """Clients with more than ``limit`` requests in a tumbling window.  Works on
    tables and streams alike (streams: complete or update mode)."""
    timed = with_event_time(requests, delay=delay)
    return timed.groupBy(F.window("at", window).alias("w"), client).agg(F.count(F.lit(1)).alias("requests")) \
        .filter(F.col("requests") > limit) \
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), client, "requests")


def counters(events: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """Events per key and day, for update mode.  Days behind the watermark
    leave the state; their rows stay in the sink."""
    return with_event_time(events, delay=delay).groupBy(F.window("at", "1 day").alias("w"), key) \
        .agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at")) \
        .select(F.col("w.start").cast("timestamp_ntz").alias("day"), key, "n", "last_at")


def counter_totals(latest: DataFrame, key: str) -> DataFrame:
    """Totals from the newest row per (day, key)."""
    return latest.groupBy(key).agg(F.sum("n").alias("n"), F.max("last_at").cast("timestamp_ntz").alias("last_at"))


def daily_sales(orders: DataFrame) -> DataFrame:
    """Paid orders per day, for complete mode; equals the batch report."""
    paid = with_event_time(orders.filter(F.col("status") == "paid"), "paid_at")
    return paid.groupBy(F.window("at", "1 day").alias("w")) \
        .agg(F.count(F.lit(1)).alias("order_count"), F.sum("final_amount").alias("amount")) \
        .select(F.col("w.start").cast("timestamp_ntz").cast("date").alias("day"), "order_count", "amount")


def like_toggles(toggles: DataFrame) -> DataFrame:
    """Toggle count per (item, fingerprint), for update mode; an odd count is a
    like.  The state is one counter per pair, kept for good, as likes are."""
    return toggles.groupBy("item_id", "fingerprint").agg(F.count(F.lit(1)).alias("n"))


def likes_from_toggles(latest: DataFrame) -> DataFrame:
    return latest.filter(F.col("n") % 2 == 1).groupBy("item_id").agg(F.count(F.lit(1)).alias("likes"))


def match_payments(orders: DataFrame, payments: DataFrame, within: str = "3 days", delay: str = "1 day") -> DataFrame:
    """Orders with the PAID payment of their amount that follows ``within`` the
    given time, for append mode.  Orders that stay without one are emitted
    with nulls once the watermark rules a payment out; orders newer than that
    are still waiting and not in the output."""
    waiting = with_event_time(orders.select("order_id", "final_amount", "created_at"), delay=delay, name="ordered_at") \
        .drop("created_at")
    paid = with_event_time(
        payments.filter(F.col("payment_status") == "PAID")
        .select(F.col("order_id").alias("paid_order"), "payment_id", "amount", "paid_at"), "paid_at", delay, "payment_at") \
        .drop("paid_at")
    in_time = (F.col("payment_at") >= F.col("ordered_at")) \
        & (F.col("payment_at") <= F.col("ordered_at") + F.expr(f"INTERVAL {within}"))
    same = (F.col("order_id") == F.col("paid_order")) & (F.col("final_amount") == F.col("amount"))
    return waiting.join(paid, same & in_time, "left").select(
        "order_id", "final_amount", "ordered_at", "payment_id", "payment_at")
