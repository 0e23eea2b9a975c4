"""Sales figures kept as sums per day, so reports read some rows a day in place of all orders.

A change of orders is folded in as the sums of the rows after it less those of
the rows before it, so a late refund mends its own day.  All sums are exact,
and a group whose count falls to 0 goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import dates
from ..functions.fixed_values import REFUND_STATUSES, SETTLED_STATUSES, VALID_STATUSES
from ..functions.money import MONEY
from ..sources import days

ORDER_GROUPS = ["day", "status", "payment_method"]
LINE_GROUPS = ["day", "product_id", "status", "item_status"]
SCHEMA = "n bigint, amount decimal(38,0)"


def _sums(rows: DataFrame, groups: list[str], amount: str) -> DataFrame:
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(amount).cast(MONEY)), F.lit(0)).cast("decimal(38,0)").alias("amount"))


def order_sums(orders: DataFrame) -> DataFrame:
    """Orders and their amounts per day, state and payment method."""
    return _sums(days.with_day(orders, "paid_at"), ORDER_GROUPS, "final_amount")


def line_sums(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines and their prices per day, product, order state and line state."""
    dated = days.with_day(orders, "paid_at").select("order_id", "status", "day")
    return _sums(items.join(dated, "order_id"), LINE_GROUPS, "price")


def changed(sums: DataFrame, before: DataFrame, after: DataFrame, groups: list[str]) -> DataFrame:
    """The sums after a change, from the sums of the changed rows as they were and as they are."""
    back = before.withColumns({"n": -F.col("n"), "amount": -F.col("amount")})
    every = sums.select(*groups, "n", "amount").unionByName(back.select(*groups, "n", "amount")).unionByName(after.select(*groups, "n", "amount"))
    return every.groupBy(*groups).agg(F.sum("n").cast("bigint").alias("n"), F.sum("amount").cast("decimal(38,0)").alias("amount")).filter("n != 0")


def fold_changes(spark: SparkSession, folder: str, before: DataFrame, after: DataFrame, groups: list[str]) -> list:
    """Fold a change into sums kept by ``days.write_days``, as for many
    products; gives the days that were read and rewritten.  Fold each change
    once.  Small sums are better kept whole by ``journal``, which tells repeats apart."""
    touched = days.touched(before, after)
    kinds = {f.name: f.dataType.simpleString() for f in before.schema}
    schema = ", ".join(f"{g} {kinds[g]}" for g in groups if g != "day") + f", {SCHEMA}, day date"
    held = days.read_days(spark, folder, schema).filter(days.in_days(touched))
    days.replace_days(spark, folder, changed(held, before, after, groups), touched, "n")
    return touched


# Reports from the sums ------------------------------------------------------

def _count(condition: Column | None = None) -> Column:
    return F.coalesce(F.sum("n" if condition is None else F.when(condition, F.col("n"))), F.lit(0)).alias("order_count")


def _amount(condition: Column | None = None) -> Column:
    return F.coalesce(F.sum("amount" if condition is None else F.when(condition, F.col("amount"))), F.lit(0).cast(MONEY)).alias("amount")


def _paid(sums: DataFrame) -> DataFrame:
    return sums.filter(F.col("status") == "paid")


def day_kpi(sums: DataFrame, as_of) -> DataFrame:
    return _paid(sums).filter(dates.days_between("day", as_of, as_of)).agg(_count(), _amount())


def month_kpi(sums: DataFrame, as_of) -> DataFrame:
    return _paid(sums).filter(dates.days_between("day", dates.month_start(as_of), dates.month_end_day(as_of))).agg(_count(), _amount())


def dashboard_kpis(sums: DataFrame, as_of) -> DataFrame:
    paid = F.col("status") == "paid"
    today = paid & dates.days_between("day", as_of, as_of)
    month = paid & dates.days_between("day", dates.month_start(as_of), dates.month_end_day(as_of))
    return sums.agg(_count(today).alias("today_count"), _amount(today).alias("today_amount"), _count(month).alias("month_count"),
                    _amount(month).alias("month_amount"), _count(F.col("status") == "pending").alias("pending"))


def sold_by_day(sums: DataFrame, first, last) -> DataFrame:
    """Paid orders per day, for ``reports.filled_days``."""
    return _paid(sums).filter(dates.days_between("day", first, last)).groupBy("day").agg(_count(), _amount())


def _is_refund() -> Column:
    return F.col("status").isin(REFUND_STATUSES)


def settlement_summary(sums: DataFrame, first, last) -> DataFrame:
    settled = sums.filter(F.col("status").isin(SETTLED_STATUSES) & dates.days_between("day", first, last))
    return settled.agg(_count().alias("total_count"), _count(~_is_refund()).alias("valid_count"), _count(_is_refund()).alias("refund_count"),
                       _amount().alias("gross"), _amount(_is_refund()).alias("refund_amount"))


def settlement_monthly(sums: DataFrame, year: int) -> DataFrame:
    settled = sums.filter(F.col("status").isin(SETTLED_STATUSES) & dates.days_between("day", f"{year}-01-01", f"{year}-12-31"))
    return settled.groupBy(F.month("day").alias("month")).agg(
        _count(~_is_refund()).alias("valid_count"), _count(_is_refund()).alias("refund_count"),
        _amount(~_is_refund()), _amount(_is_refund()).alias("refund_amount"))


def settlement_by_product(sums: DataFrame, products: DataFrame, first, last) -> DataFrame:
    """From ``line_sums``; of all time if both days are None."""
    settled = sums.filter(F.col("status").isin(SETTLED_STATUSES) & dates.days_between("day", first, last))
    active, refunded = F.col("item_status") == "active", F.col("item_status") == "refunded"
    per_product = settled.groupBy("product_id").agg(
        _count(active).alias("sale_count"), _count(refunded).alias("refund_count"),
        _amount(active).alias("gross"), _amount(refunded).alias("refund_amount"))
    return per_product.join(products.select("product_id", "name"), "product_id")


def payment_mix(sums: DataFrame, first, last) -> DataFrame:
    mix = sums.filter(F.col("status").isin(VALID_STATUSES) & dates.days_between("day", first, last)) \
        .groupBy("payment_method").agg(_count(), _amount())
    # A window over one row per payment method.
    total = F.sum("amount").over(Window.partitionBy(F.lit(1))).cast("double")
    return mix.withColumn("share", F.when(total > 0, F.col("amount").cast("double") / total))
