"""Customer measures, grades, segments and the per-customer record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import customer, dates
from ..functions.fixed_values import GRADES, REFUND_STATUSES
from ..functions.money import MONEY
from . import joins
from .skew import join_measured, top_n_per_key


def rfm(orders: DataFrame, as_of) -> DataFrame:
    """Spend, order count, this month's spend, last purchase and refunds per
    user with orders, in one grouped pass.  Counts what happened up to ``as_of``."""
    at = F.col("paid_at")
    paid = F.col("status") == "paid"
    this_month = paid & (at >= dates.ntz(dates.month_start(as_of)))
    zero = F.lit(0).cast(MONEY)
    return orders.filter((at <= dates.ntz(as_of)) & F.col("status").isin(["paid", *REFUND_STATUSES])) \
        .groupBy("user_id").agg(
            F.coalesce(F.sum(F.when(paid, F.col("final_amount"))), zero).alias("total_spent"),
            F.count_if(paid).alias("total_orders"),
            F.coalesce(F.sum(F.when(this_month, F.col("final_amount"))), zero).alias("monthly_amount"),
            F.max(F.when(paid, at)).alias("last_purchased_at"),
            F.min(F.when(paid, at)).alias("first_purchased_at"),
            F.count_if(F.col("status").isin(REFUND_STATUSES)).alias("refund_count"))


def customer_rfm(users: DataFrame, orders: DataFrame, as_of) -> DataFrame:
    """Measures of every customer; where users have a ``role``, staff is left out."""
    zero = F.lit(0).cast(MONEY)
    customers = users.filter(F.col("role") == "user") if "role" in users.columns else users
    return customers.join(rfm(orders, as_of), "user_id", "left") \
        .withColumn("total_spent", F.coalesce("total_spent", zero)) \
        .withColumn("monthly_amount", F.coalesce("monthly_amount", zero)) \
        .withColumn("total_orders", F.coalesce("total_orders", F.lit(0))) \
        .withColumn("refund_count", F.coalesce("refund_count", F.lit(0)))


def customer_grades(users: DataFrame, orders: DataFrame, as_of,
                    limits: customer.GradeLimits = customer.GradeLimits(),
                    honour_manual: bool = True) -> DataFrame:
    """With ``honour_manual`` a grade set by hand wins and inactive users stay;
    without it grades are computed for active users only."""
    measured = customer_rfm(users if honour_manual else users.filter("is_active"), orders, as_of)
    manual = F.col("manual_grade") if honour_manual else None
    return measured.withColumn(
        "grade", customer.grade(F.col("total_orders"), F.col("monthly_amount"), limits, manual))


def customer_rules(graded: DataFrame, as_of) -> DataFrame:
    """Days since the last purchase, recency risk and account state."""
    days = dates.whole_days_between(F.col("last_purchased_at"), as_of)
    return graded.withColumn("days_since", days) \
        .withColumn("risk", customer.recency_risk(F.col("total_orders"), F.col("days_since"))) \
        .withColumn("state", customer.account_state(F.col("is_active"), F.col("is_dormant")))


def grade_distribution(graded: DataFrame) -> DataFrame:
    """One row: total and a count per computed grade, zeros included; ``mid``
    is sprout and regular together."""
    counts = [F.count_if(F.col("grade") == g).alias(g) for g in GRADES]
    return graded.agg(F.count(F.lit(1)).alias("total"), *counts) \
        .withColumn("mid", F.col("sprout") + F.col("regular"))


def customer_kpis(graded: DataFrame, as_of, joined_at: str = "first_purchased_at") -> DataFrame:
    """Never having bought counts as infinitely long ago."""
    days = dates.whole_days_between(F.col("last_purchased_at"), as_of)
    return graded.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(dates.in_month_of(F.col(joined_at), as_of)).alias("new_this_month"),
        F.count_if(F.col("grade").isin("vip", "vvip")).alias("vip_plus"),
        F.count_if(days <= 30).alias("active_30d"),
        F.count_if((days > 90) & (F.col("total_orders") > 0)).alias("churn_90d"))


def latest_orders(orders: DataFrame, n: int = 30) -> DataFrame:
    return top_n_per_key(orders, ["user_id"], [F.col("created_at").desc(), F.col("order_id").desc()], n)


def latest_points(ledger: DataFrame, n: int = 30) -> DataFrame:
    return top_n_per_key(ledger, ["user_id"], [F.col("created_at").desc(), F.col("entry_id").desc()], n)


def customer_360(users: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, reviews: DataFrame,
                 ledger: DataFrame, notes: DataFrame, coupons: DataFrame, as_of,
                 limits: customer.GradeLimits = customer.GradeLimits(), n: int = 30) -> DataFrame:
    """The record of every customer, as rows of sections.

    The ``profile`` row holds grade and measures and, as lists, the newest
    ``n`` orders and ledger entries.  Reviews, notes and coupons have no bound
    and come as one row each, with ``created_at``, ``entry_id`` and a struct
    named like the section; sorted by these, a customer's rows are the record.
    """
    recent = latest_orders(orders.select("order_id", "user_id", "final_amount", "status", "payment_method", "created_at"), n)
    recent = recent.join(listed_items(recent, items, products), "order_id", "left") \
        .withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    order_list = _capped_list(recent, "orders", ["order_id", "final_amount", "status", "payment_method", "created_at",
                                                 "first_product", "item_count"])
    point_list = _capped_list(latest_points(ledger, n), "points", ["entry_id", "amount", "type", "created_at"])
    profile = customer_grades(users, orders, as_of, limits).drop("created_at") \
        .join(order_list, "user_id", "left").join(point_list, "user_id", "left").withColumn("section", F.lit("profile"))
    named = joins.order_items_detail(reviews, products, ["name"])
    entries = [section(named, "reviews", "review_id", ["product_id", "name", "rating"]),
               section(notes, "notes", "note_id", ["content"]),
               section(coupons, "coupons", "claim_id", ["coupon_event_id", "is_used"])]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [profile, *(e.join(users.select("user_id"), "user_id", "left_semi") for e in entries)])


def listed_items(recent: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Number of items and first known product per order in ``recent``, from one
    grouping of these orders' items only."""
    lines = join_measured(items.select("order_id", "line_no", "product_id"), recent.select("order_id"), ["order_id"], "left_semi")
    named = lines.join(products.select("product_id", "name", F.lit(True).alias("_known")), "product_id", "left")
    first = F.min(F.when(F.col("_known"), F.struct("line_no", "product_id", "name")))
    return named.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"), first.alias("_f")) \
        .select("order_id", "item_count", F.col("_f.name").alias("first_product"))


def section(rows: DataFrame, name: str, entry_id: str, columns: list[str], at: str = "created_at") -> DataFrame:
    """Rows of one kind of child, with the same leading columns for all kinds."""
    return rows.select("user_id", F.lit(name).alias("section"), F.col(at).alias("created_at"),
                       F.col(entry_id).cast("string").alias("entry_id"), F.struct(*columns).alias(name))


def _capped_list(ranked: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """At most n rows per user are left here, so the list is small."""
    return ranked.groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("position", *columns))).alias(name))
