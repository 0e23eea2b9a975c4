"""Coupon claims, quotes and order pricing over whole request tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import money, text
from ..functions.money import MONEY
from . import filters
from .joins import coupon_for_order
from .skew import join_measured

OFFER = ["coupon_event_id", "discount_type", "discount_value", "min_order_amount", "applicable_categories"]


def _offers(requests: DataFrame, claims: DataFrame, coupon_events: DataFrame) -> DataFrame:
    """At most one usable coupon per request, as a struct."""
    usable = coupon_for_order(requests.select("request_id", "user_id", "claim_id", "created_at"), claims, coupon_events)
    return usable.select("request_id", F.struct("claim_id", *OFFER).alias("offer"))


def price_orders(requests: DataFrame, request_lines: DataFrame, products: DataFrame, claims: DataFrame,
                 coupon_events: DataFrame) -> DataFrame:
    """Turn order requests into priced orders.

    A request is rejected when it has no lines or when a product is unknown,
    inactive or asked for twice.  A coupon that does not apply is ignored.  The
    category test passes if any line matches; the discount is on the whole total.
    """
    asked = request_lines.groupBy("request_id", "product_id").agg(F.count(F.lit(1)).alias("copies"))
    lines = asked.join(filters.active_only(products).select("product_id", "price", "category"), "product_id", "left")
    # A request's categories are no more than the shop has; its offer meets them once per request, not on every line.
    totals = lines.groupBy("request_id").agg(
        F.sum("copies").alias("_asked"), F.count("price").alias("_found"),
        F.sum("price").cast(MONEY).alias("_total"), F.collect_set("category").alias("_categories"))
    offers = _offers(requests, claims, coupon_events).withColumnRenamed("offer", "_offer")
    limit_to = F.col("_offer.applicable_categories")
    matches = limit_to.isNull() | (F.size(limit_to) == 0) | F.arrays_overlap(limit_to, F.col("_categories"))
    reason = F.when(F.col("_asked").isNull(), "no_products") \
        .when(F.col("_asked") != F.col("_found"), "invalid_products")
    zero = F.lit(0).cast(MONEY)
    applies = F.col("_offer").isNotNull() & F.coalesce(matches, F.lit(False)) \
        & (F.col("_total") >= F.coalesce(F.col("_offer.min_order_amount"), zero))
    discount = F.when(applies, money.coupon_discount(F.col("_offer.discount_type"), F.col("_offer.discount_value"),
                                                     F.col("_total"))).otherwise(zero)
    accepted = F.col("reject_reason").isNull()
    return requests.join(totals, "request_id", "left").join(offers, "request_id", "left").withColumn("reject_reason", reason) \
        .withColumn("_discount", discount).select(
            "request_id", "user_id", "reject_reason",
            F.when(accepted, F.col("_total")).alias("total_amount"),
            F.when(accepted, F.col("_discount")).alias("discount_amount"),
            F.when(accepted, money.final_amount(F.col("_total"), F.col("_discount"))).alias("final_amount"),
            F.when(accepted & applies, F.col("_offer.claim_id")).alias("claim_id"))


def placed_orders(priced: DataFrame) -> DataFrame:
    """The accepted requests as pending orders; an order's id is its request's."""
    return priced.filter(F.col("reject_reason").isNull()).select(
        F.col("request_id").alias("order_id"), "user_id", F.lit("pending").alias("order_status"),
        "total_amount", "discount_amount", "final_amount", "claim_id")


def placed_items(priced: DataFrame, request_lines: DataFrame, products: DataFrame) -> DataFrame:
    """The items of the accepted requests at the products' list prices.  An
    accepted request names every product once, so its prices add up to its total."""
    accepted = priced.filter(F.col("reject_reason").isNull()).select("request_id")
    lines = request_lines.select("request_id", "product_id").join(accepted, "request_id", "left_semi")
    return lines.join(filters.active_only(products).select("product_id", "price"), "product_id") \
        .select(F.col("request_id").alias("order_id"), "product_id", "price")


def quote_coupons(requests: DataFrame, claims: DataFrame, coupon_events: DataFrame) -> DataFrame:
    """Discount or rejection reason per request.  Unlike pricing, the category
    test is skipped when the request names no categories."""
    offered = requests.join(_offers(requests, claims, coupon_events), "request_id", "left")
    least = F.coalesce(F.col("offer.min_order_amount"), F.lit(0).cast(MONEY))
    names_none = F.col("categories").isNull() | (F.size("categories") == 0)
    reason = F.when(F.col("claim_id").isNull() | (F.coalesce("amount", F.lit(0)) == 0), "missing_input") \
        .when(F.col("offer").isNull(), "unusable") \
        .when((least > 0) & (F.col("amount") < least), "below_minimum") \
        .when(~names_none & ~text.categories_allowed(F.col("offer.applicable_categories"), F.col("categories")),
              "category_mismatch")
    discount = money.coupon_discount(F.col("offer.discount_type"), F.col("offer.discount_value"), F.col("amount"))
    return offered.withColumn("reject_reason", reason).select(
        "request_id", "user_id", "claim_id", "amount", "reject_reason",
        F.when(F.col("reject_reason").isNull(), discount).alias("discount"),
        F.col("offer.coupon_event_id").alias("coupon_event_id"))


def claim_coupons(requests: DataFrame, coupon_events: DataFrame, existing: DataFrame) -> DataFrame:
    """Grant one claim per (user, coupon event) inside the event's window; the
    earliest valid request wins, the others say why not."""
    key = ["user_id", "coupon_event_id"]
    held = existing.select(*key).distinct().withColumn("_held", F.lit(True))
    windows = coupon_events.select("coupon_event_id", "start_date", "end_date")
    checked = join_measured(requests.join(windows, "coupon_event_id", "left"), held, key, "left") \
        .withColumn("_runs", F.coalesce(filters.runs_on(F.col("created_at").cast("date")), F.lit(False))) \
        .withColumn("_held", F.coalesce("_held", F.lit(False)))
    # Winners by aggregate, then matched on the unique request id: a hot
    # (user, event) never becomes one window partition.
    winners = checked.filter(F.col("_runs") & ~F.col("_held")).groupBy(*key) \
        .agg(F.min(F.struct("created_at", "request_id")).alias("_w")) \
        .select(F.col("_w.request_id").alias("request_id"), F.lit(True).alias("_won"))
    outcome = F.when(~F.col("_runs"), "not_running").when(F.col("_held") | F.col("_won").isNull(), "already_claimed") \
        .otherwise("granted")
    return checked.join(winners, "request_id", "left") \
        .select("request_id", *key, "created_at", outcome.alias("outcome"))
