"""Selections over orders, products, coupons, customers and inquiries.

Optional arguments that are None (or 'all') add no condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, text


def _chosen(value) -> bool:
    return value not in (None, "", "all")


def filter_orders(orders: DataFrame, status=None, payment_method=None,
                  date_from=None, date_to=None, day: str | None = None) -> DataFrame:
    """Order list conditions; the date range covers whole days, half-open.
    ``day`` names the date of ``created_at`` as a DATE column, by which the scan prunes."""
    if _chosen(status):
        orders = orders.filter(F.col("status") == status)
    if _chosen(payment_method):
        orders = orders.filter(F.col("payment_method") == payment_method)
    if _chosen(date_from):
        orders = orders.filter((F.col("created_at") >= dates.ntz(date_from)) & dates.days_between(day, date_from, None))
    if _chosen(date_to):
        end = dates.day_start(date_to) + dates.dt.timedelta(days=1)
        orders = orders.filter((F.col("created_at") < dates.ntz(end)) & dates.days_between(day, None, date_to))
    return orders


def matches_wild(columns: list[str], pattern: str | None) -> Column:
    """Case-insensitive substring in any column, wildcards live; no pattern matches all, a null value nothing."""
    if not _chosen(pattern):
        return F.lit(True)
    return F.coalesce(text.any_of([text.contains_wild(F.col(c), pattern) for c in columns]), F.lit(False))


def search_wild(df: DataFrame, columns: list[str], pattern: str | None) -> DataFrame:
    return df.filter(matches_wild(columns, pattern))


def matches_keyword(columns: list[str], keyword: str) -> Column:
    """Literal case-insensitive substring in any column; a blank keyword matches nothing."""
    keyword = keyword.strip()
    return text.any_of([text.contains_literal(F.col(c), keyword) for c in columns]) if keyword else F.lit(False)


def search_keyword(df: DataFrame, columns: list[str], keyword: str) -> DataFrame:
    return df.filter(matches_keyword(columns, keyword))


def name_contains(df: DataFrame, keyword: str, column: str = "name") -> DataFrame:
    """Literal substring on one column; a blank keyword keeps everything."""
    keyword = keyword.strip()
    return df.filter(text.contains_literal(F.col(column), keyword)) if keyword else df


def with_price(products: DataFrame, price) -> DataFrame:
    return products.filter(F.col("price") == int(price)) if _chosen(price) else products


def active_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_active"))


def in_category(products: DataFrame, category) -> DataFrame:
    products = active_only(products)
    return products.filter(F.col("category") == category) if _chosen(category) else products


def status_in(df: DataFrame, statuses: list[str]) -> DataFrame:
    return df.filter(F.col("status").isin(statuses))


def runs_on(day: Column, start: str = "start_date", end: str = "end_date") -> Column:
    """Inclusive at both ends, on dates."""
    return day.between(F.col(start), F.col(end))


def running_on(events: DataFrame, day) -> DataFrame:
    return events.filter(runs_on(F.lit(dates.as_datetime(day).date())))


def usable_coupons(user_coupons: DataFrame, coupons: DataFrame, as_of) -> DataFrame:
    """Unused coupons not yet expired, per owner by expiry; no expiry sorts last."""
    alive = coupons.filter(F.col("expires_at").isNull() | (F.col("expires_at") > dates.ntz(as_of)))
    return user_coupons.filter(~F.col("is_used")).join(alive, "coupon_id") \
        .orderBy("user_id", F.col("expires_at").asc_nulls_last(), "user_coupon_id")


def claimed_coupons(claims: DataFrame, events: DataFrame, as_of, show_all: bool = False) -> DataFrame:
    """Claims with their coupon event, unused first, newest first; without
    ``show_all`` only unused ones whose window has not ended."""
    found = claims.join(events, "coupon_event_id")
    if not show_all:
        today = F.lit(dates.as_datetime(as_of).date())
        found = found.filter(~F.col("is_used") & (F.col("end_date") >= today))
    return found.orderBy("user_id", F.col("is_used").asc(), F.col("created_at").desc(), F.col("claim_id").desc())


def customer_segment(graded: DataFrame, keyword: str = "", segment: str = "all", as_of=None) -> DataFrame:
    """Keyword on name or e-mail, and a grade or the computed 'churn' segment."""
    if keyword.strip():
        graded = search_keyword(graded, ["name", "email"], keyword)
    if segment == "churn":
        days = dates.whole_days_between(F.col("last_purchased_at"), as_of)
        return graded.filter((days > 90) & (F.col("total_orders") > 0))
    return graded.filter(F.col("grade") == segment) if _chosen(segment) else graded


def inquiries_of(inquiries: DataFrame, kind: str = "all") -> DataFrame:
    """'unanswered' is a state, every other value an inquiry type."""
    if kind == "unanswered":
        return inquiries.filter(~F.col("answered"))
    return inquiries.filter(F.col("type") == kind) if _chosen(kind) else inquiries


def request_completeness(request_lines: DataFrame, products: DataFrame) -> DataFrame:
    """Per request: asked lines, active products found, and whether all are
    found exactly once.  Copies of a line are combined before the shuffle."""
    asked = request_lines.groupBy("request_id", "product_id").agg(F.count(F.lit(1)).alias("asked"))
    known = active_only(products).select("product_id", F.lit(True).alias("known"))
    return asked.join(known, "product_id", "left").groupBy("request_id").agg(
        F.sum("asked").alias("asked"),
        F.count("known").alias("found"),
    ).withColumn("complete", F.col("asked") == F.col("found"))
