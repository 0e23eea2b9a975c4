"""Orders as the outcome of their events, whatever order these arrive in.

``events`` holds event_id, order_id, user_id, kind, amount, payment_key, method,
provider, line_no and at.  Kinds: ``paid`` (the gateway's, which has to carry
the order's amount), ``capture`` (the wallet's) and ``confirm`` (plain) pay an
order; ``virtual_account`` waits for money; ``customer_refund`` gives all back,
``admin_refund`` a line or, without ``line_no``, all.  Events of another user
than the order's are ignored.

Every step takes the first event by (at, event_id) that counts, so repeats and
late arrivals change nothing: the events of all batches together, in any
order, give the tables that processing them in time order gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..functions.money import MONEY
from .skew import join_measured

PAYING = ["paid", "capture", "confirm"]


def _moment() -> Column:
    return F.struct("at", "event_id")


def payments_of(orders: DataFrame, events: DataFrame) -> DataFrame:
    """Orders with ``_paid``, the first event that pays them, and ``_waits``,
    the first virtual account.  Events are combined per order and amount before the join."""
    what = F.struct("at", "event_id", "kind", "payment_key", "method", "provider")
    relevant = F.col("kind").isin([*PAYING, "virtual_account"])
    # Only the gateway's payments have to match the amount.
    fits = F.when(F.col("kind") == "paid", F.col("amount"))
    known = events.filter(relevant & ~((F.col("kind") == "paid") & F.col("amount").isNull())) \
        .groupBy("order_id", "user_id", fits.alias("_amount")).agg(
            F.min(F.when(F.col("kind").isin(PAYING), what)).alias("_p"), F.min(F.when(F.col("kind") == "virtual_account", what)).alias("_v"))
    right = known.join(orders.select("order_id", "user_id", "final_amount"), ["order_id", "user_id"]) \
        .filter(F.col("_amount").isNull() | (F.col("_amount") == F.col("final_amount"))) \
        .groupBy("order_id").agg(F.min("_p").alias("_paid"), F.min("_v").alias("_waits"))
    return join_measured(orders, right, ["order_id"], "left")


def refunds_of(paid: DataFrame, events: DataFrame) -> DataFrame:
    """(order_id, line_no, _admin, _customer): the first refunds after the
    payment; a null line stands for the whole order."""
    wishes = events.filter(F.col("kind").isin("customer_refund", "admin_refund"))
    payer = paid.filter(F.col("_paid.payment_key").isNotNull()).select("order_id", F.col("user_id").alias("_buyer"), F.struct("_paid.at", "_paid.event_id").alias("_since"))
    by_customer = F.col("kind") == "customer_refund"
    found = join_measured(wishes.withColumn("_at", _moment()), payer, ["order_id"]) \
        .filter((F.col("_at") > F.col("_since")) & (~by_customer | (F.col("user_id") == F.col("_buyer"))))
    line = F.when(~by_customer, F.col("line_no")).alias("line_no")
    return found.groupBy("order_id", line).agg(F.min(F.when(~by_customer, F.col("_at"))).alias("_admin"),
                                               F.min(F.when(by_customer, F.col("_at"))).alias("_customer"))


def item_states(items: DataFrame, paid: DataFrame, refunds: DataFrame) -> DataFrame:
    """Items with ``item_status`` and ``refunded_at``.  ``paid`` and ``refunds``
    come from ``payments_of`` and ``refunds_of``."""
    whole = refunds.filter("line_no IS NULL").select("order_id", F.col("_admin").alias("_all"), "_customer")
    lines = refunds.filter("line_no IS NOT NULL").select("order_id", "line_no", "_admin")
    found = join_measured(join_measured(items, whole, ["order_id"], "left"), lines, ["order_id", "line_no"], "left")
    refunded = F.least("_all", "_admin", "_customer")
    return found.withColumn("item_status", F.when(refunded.isNotNull(), "refunded").otherwise("active")) \
        .withColumn("refunded_at", refunded["at"]).withColumn("_gone", refunded).drop("_all", "_admin", "_customer")


def order_states(paid: DataFrame, refunds: DataFrame, states: DataFrame) -> DataFrame:
    """Orders with status, payment columns, ``refund_amount`` and
    ``refunded_by`` ('customer' or 'admin', once nothing is left of them)."""
    customer = refunds.filter("line_no IS NULL").select("order_id", "_customer")
    lines = states.groupBy("order_id").agg(
        F.count_if(F.col("_gone").isNull()).alias("_left"), F.max("_gone").alias("_last"),
        F.sum(F.when(F.col("_gone").isNotNull(), F.col("price"))).alias("_back"))
    found = paid.join(customer, "order_id", "left").join(lines, "order_id", "left")
    closed = (F.col("_customer").isNotNull()) | (F.col("_left") == 0)
    kind, provider = F.col("_paid.kind"), text.payment_provider
    is_paid, waits = F.col("_paid").isNotNull(), F.col("_waits").isNotNull()
    # A customer's refund counts unless all lines had gone before it.
    by_customer = F.col("_customer").isNotNull() & (F.col("_last").isNull() | (F.col("_customer") <= F.col("_last")))
    own = [c for c in paid.columns if c not in ("_paid", "_waits", "status", "payment_key", "payment_method", "pg_provider", "paid_at")]
    return found.select(
        *own,
        F.when(is_paid & F.coalesce(closed, F.lit(False)), "refund").when(is_paid, "paid").when(waits, "vbank_pending").otherwise("pending").alias("status"),
        F.when(is_paid, F.col("_paid.payment_key")).otherwise(F.col("_waits.payment_key")).alias("payment_key"),
        F.when(kind == "paid", text.clean_payment_method(F.col("_paid.method"))).when(kind == "capture", "PAYPAL")
        .otherwise(F.col("_paid.method")).alias("payment_method"),
        F.when(kind == "paid", provider(F.col("_paid.provider"))).when(kind == "capture", "paypal")
        .when(~is_paid & waits, provider(F.col("_waits.provider"))).alias("pg_provider"),
        F.col("_paid.at").alias("paid_at"),
        F.coalesce(F.col("_back").cast(MONEY), F.lit(0).cast(MONEY)).alias("refund_amount"),
        F.when(closed, F.when(by_customer, "customer").otherwise("admin")).alias("refunded_by"))


def fold(orders: DataFrame, items: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders and items as all ``events`` leave them.  ``orders`` holds
    order_id, user_id and final_amount, ``items`` order_id, line_no and price; other columns stay."""
    paid = payments_of(orders, events)
    refunds = refunds_of(paid, events)
    states = item_states(items, paid, refunds)
    return order_states(paid, refunds, states), states.drop("_gone")


def use_coupons(coupons: DataFrame, orders: DataFrame, coupon: str, order: str | None = None) -> DataFrame:
    """Coupons (user_id, ``coupon``, is_used, ...) with those used that paid
    orders of ``fold`` carry: ``used_at`` is when the first of them was paid and
    ``order`` the column, if any, that names it.  Coupons used before stay as they are."""
    used = orders.filter(F.col("paid_at").isNotNull() & F.col(coupon).isNotNull()) \
        .groupBy("user_id", coupon).agg(F.min(F.struct("paid_at", "order_id")).alias("_use"))
    found = join_measured(coupons, used, ["user_id", coupon], "left")
    was = F.col("is_used")

    def kept(name, new):
        old = F.col(name) if name in coupons.columns else F.lit(None)
        return F.when(was, old).otherwise(new)

    found = found.withColumn("used_at", kept("used_at", F.col("_use.paid_at")))
    if order:
        found = found.withColumn(order, kept(order, F.col("_use.order_id")))
    return found.withColumn("is_used", was | F.col("_use").isNotNull()).drop("_use")
