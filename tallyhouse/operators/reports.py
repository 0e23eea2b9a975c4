"""Sales reports: day and month figures, charts, settlement, payment mix.

Two revenue notions exist and are kept apart: the dashboard counts paid orders
only, the settlement counts every settled status and splits off refunds.

``day`` names the date of ``paid_at`` as a DATE column of orders, if it has one; date
ranges then prune the scan by it (see ``functions.dates``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates
from ..functions.fixed_values import REFUND_STATUSES, SETTLED_STATUSES, VALID_STATUSES
from ..functions.money import MONEY
from . import joins
from .ordering import top_k


def _sum(col: str | Column) -> Column:
    return F.coalesce(F.sum(col), F.lit(0).cast(MONEY))


def _when(condition: Column, col: str = "final_amount") -> Column:
    return _sum(F.when(condition, F.col(col)))


def _paid(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status") == "paid")


def day_kpi(orders: DataFrame, as_of, day: str | None = None) -> DataFrame:
    return _paid(orders).filter(dates.on_day(F.col("paid_at"), as_of, day)) \
        .agg(F.count(F.lit(1)).alias("order_count"), _sum("final_amount").alias("amount"))


def month_kpi(orders: DataFrame, as_of, day: str | None = None) -> DataFrame:
    return _paid(orders).filter(dates.in_month_of(F.col("paid_at"), as_of, day)) \
        .agg(F.count(F.lit(1)).alias("order_count"), _sum("final_amount").alias("amount"))


def pending_count(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status") == "pending").agg(F.count(F.lit(1)).alias("pending"))


def daily_sales(orders: DataFrame, as_of, days: int = 7, day: str | None = None) -> DataFrame:
    """Paid orders per date from ``as_of`` minus ``days`` up to ``as_of``; touches days + 1 dates."""
    now = dates.as_datetime(as_of)
    paid_at, first = F.col("paid_at"), now - dt.timedelta(days=days)
    return _paid(orders) \
        .filter((paid_at >= dates.ntz(first)) & (paid_at <= dates.ntz(now)) & dates.days_between(day, first, now)) \
        .groupBy(paid_at.cast("date").alias("day")) \
        .agg(F.count(F.lit(1)).alias("order_count"), _sum("final_amount").alias("amount"))


def daily_sales_filled(orders: DataFrame, as_of, days: int = 7, day: str | None = None) -> DataFrame:
    """Exactly ``days`` dates ending today, zero-filled, each relative to the
    largest amount (at least 1)."""
    today = dates.as_datetime(as_of).date()
    first = today - dt.timedelta(days=days - 1)
    sold = _paid(orders).filter(dates.in_days(F.col("paid_at"), first, today, day)) \
        .groupBy(F.col("paid_at").cast("date").alias("day")) \
        .agg(F.count(F.lit(1)).alias("order_count"), _sum("final_amount").alias("amount"))
    return filled_days(sold, as_of, days)


def filled_days(sold: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Sales per day (day, order_count, amount) on the ``days`` dates ending today."""
    today = dates.as_datetime(as_of).date()
    first = today - dt.timedelta(days=days - 1)
    calendar = sold.sparkSession.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    filled = calendar.join(sold, "day", "left").select(
        "day", dates.chart_label(F.col("day")).alias("label"),
        F.coalesce("order_count", F.lit(0)).alias("order_count"),
        F.coalesce("amount", F.lit(0).cast(MONEY)).alias("amount"),
        (F.col("day") == F.lit(today)).alias("is_today"))
    # A window over ``days`` rows, not over orders.
    largest = F.greatest(F.max("amount").over(Window.partitionBy(F.lit(1))), F.lit(1).cast(MONEY))
    return filled.withColumn("relative", F.col("amount").cast("double") / largest.cast("double"))


def top_products(items: DataFrame, orders: DataFrame, products: DataFrame, k: int = 3) -> DataFrame:
    """Best sellers among paid orders.  Summed per product before the product
    join, so the join sees one row per product."""
    sold = items.join(_paid(orders).select("order_id"), "order_id", "left_semi") \
        .groupBy("product_id").agg(F.count(F.lit(1)).alias("sales"), _sum("price").alias("revenue"))
    best = top_k(sold.join(products.select("product_id", "name"), "product_id"),
                 [F.col("sales").desc(), F.col("product_id").asc()], k)
    # Ranks k rows.
    return best.withColumn("position", F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(F.col("sales").desc(), F.col("product_id").asc())))


def item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"))


def order_item_counts(orders: DataFrame, items: DataFrame) -> DataFrame:
    return orders.select("order_id").join(item_counts(items), "order_id", "left") \
        .withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def settled(orders: DataFrame, first, last, day: str | None = None) -> DataFrame:
    """Settled orders of the days from first to last; of all time if both are None."""
    chosen = orders.filter(F.col("status").isin(SETTLED_STATUSES))
    return chosen if first is None and last is None else chosen.filter(dates.in_days(F.col("paid_at"), first, last, day))


def _is_refund(col: str = "status") -> Column:
    return F.col(col).isin(REFUND_STATUSES)


def settlement_summary(orders: DataFrame, first, last, day: str | None = None) -> DataFrame:
    """One row; ``gross`` includes refunded orders."""
    return settled(orders, first, last, day).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(~_is_refund()).alias("valid_count"),
        F.count_if(_is_refund()).alias("refund_count"),
        _sum("final_amount").alias("gross"),
        _when(_is_refund()).alias("refund_amount"))


def settlement_monthly(orders: DataFrame, year: int, day: str | None = None) -> DataFrame:
    """Months with settled orders only."""
    return orders.filter(F.col("status").isin(SETTLED_STATUSES) & dates.in_year(F.col("paid_at"), year, day)) \
        .groupBy(F.month("paid_at").alias("month")).agg(
            F.count_if(~_is_refund()).alias("valid_count"),
            F.count_if(_is_refund()).alias("refund_count"),
            _when(~_is_refund()).alias("amount"),
            _when(_is_refund()).alias("refund_amount"))


def settlement_by_product(items: DataFrame, orders: DataFrame, products: DataFrame, first, last, day: str | None = None) -> DataFrame:
    """Item-level settlement per product; partial refunds count.

    Orders only filter (their id is unique), products only name, so the sums
    are taken per product id before the product join.
    """
    lines = items.join(settled(orders, first, last, day).select("order_id"), "order_id", "left_semi")
    active, refunded = F.col("item_status") == "active", F.col("item_status") == "refunded"
    sums = lines.groupBy("product_id").agg(
        F.count_if(active).alias("sale_count"),
        F.count_if(refunded).alias("refund_count"),
        _when(active, "price").alias("gross"),
        _when(refunded, "price").alias("refund_amount"))
    return sums.join(products.select("product_id", "name"), "product_id")


def payment_mix(orders: DataFrame, first, last, day: str | None = None) -> DataFrame:
    """Settled orders without refunds per payment method, with each one's share."""
    mix = orders.filter(F.col("status").isin(VALID_STATUSES) & dates.in_days(F.col("paid_at"), first, last, day)) \
        .groupBy("payment_method").agg(F.count(F.lit(1)).alias("order_count"), _sum("final_amount").alias("amount"))
    # A window over one row per payment method.
    total = F.sum("amount").over(Window.partitionBy(F.lit(1))).cast("double")
    return mix.withColumn("share", F.when(total > 0, F.col("amount").cast("double") / total))


def alerts(pending: DataFrame, unanswered: DataFrame) -> DataFrame:
    """Rows for the conditions that hold.  Inputs are one-row counts."""
    orders = pending.filter(F.col("pending") > 0) \
        .select(F.lit("pending_orders").alias("alert"), F.col("pending").alias("n"))
    asked = unanswered.filter(F.col("unanswered") > 0) \
        .select(F.lit("unanswered_inquiries").alias("alert"), F.col("unanswered").alias("n"))
    return orders.unionByName(asked)


def dashboard_kpis(orders: DataFrame, as_of, day: str | None = None) -> DataFrame:
    """Day, month and pending figures: from one pass over the orders, or with
    ``day`` from the month's days, beside a pass over the states alone."""
    paid = F.col("status") == "paid"
    today = paid & dates.on_day(F.col("paid_at"), as_of)
    month = paid & dates.in_month_of(F.col("paid_at"), as_of)
    pending = F.col("status") == "pending"
    if day:
        of_month = orders.filter(paid & dates.in_month_of(F.col("paid_at"), as_of, day)) \
            .select("status", "paid_at", "final_amount")
        waiting = orders.filter(pending).select("status", F.lit(None).cast("timestamp_ntz").alias("paid_at"),
                                                F.lit(None).cast(orders.schema["final_amount"].dataType).alias("final_amount"))
        orders = of_month.unionByName(waiting)
    return orders.filter(pending | month).agg(
        F.count_if(today).alias("today_count"), _when(today).alias("today_amount"),
        F.count_if(month).alias("month_count"), _when(month).alias("month_amount"),
        F.count_if(pending).alias("pending"))


def dashboard(orders: DataFrame, users: DataFrame, items: DataFrame, products: DataFrame, inquiries: DataFrame,
              as_of, day: str | None = None) -> dict[str, DataFrame]:
    """The dashboard's parts.  Cache ``orders`` first if all are to be shown, or name its ``day``."""
    from .catalog import inquiry_summary
    kpis = dashboard_kpis(orders, as_of, day)
    return {
        "kpis": kpis,
        "chart": daily_sales_filled(orders, as_of, day=day),
        "recent_orders": joins.recent_orders(orders, users, items, products),
        "top_products": top_products(items, orders, products),
        "alerts": alerts(kpis.select("pending"), inquiry_summary(inquiries).select("unanswered")),
    }
