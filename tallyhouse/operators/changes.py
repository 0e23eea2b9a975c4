"""State changes as jobs: old table and change table in, new table out.

Each function can be run again on its own output with the same changes and
then changes nothing more, unless its doc says otherwise.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates, text
from ..functions.fixed_values import VALID_STATUSES
from ..functions.money import MONEY
from .skew import RANGE_ROWS, bucket_starts, cut_buckets, join_measured, running_sums, top_n_per_key

REFUNDABLE = [s for s in VALID_STATUSES if s != "done"]


# Payments ------------------------------------------------------------------

def apply_payments(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Pending orders with a PAID payment of exactly their amount become paid;
    those with only a virtual account issued become 'vbank_pending'.

    Payments are combined per (order, amount) first: the earliest counts,
    repeats change nothing.  Adds ``newly_paid``.
    """
    first = F.min(F.struct("paid_at", "payment_id", "method", "provider")).alias("_p")
    good = payments.filter(F.col("payment_status") == "PAID") \
        .groupBy("order_id", F.col("amount").alias("final_amount")).agg(first)
    issued = payments.filter(F.col("payment_status") == "VIRTUAL_ACCOUNT_ISSUED").groupBy("order_id") \
        .agg(F.min(F.struct("paid_at", "payment_id", "provider")).alias("_v"))
    pending = F.col("status") == "pending"
    paid, waits = pending & F.col("_p").isNotNull(), pending & F.col("_p").isNull() & F.col("_v").isNotNull()

    def changed(column, when_paid, when_waiting=None):
        new = F.when(paid, when_paid)
        if when_waiting is not None:
            new = new.when(waits, when_waiting)
        return new.otherwise(F.col(column))

    provider = text.payment_provider
    return orders.join(good, ["order_id", "final_amount"], "left").join(issued, "order_id", "left").select(
        *[c for c in orders.columns if c not in ("status", "payment_key", "payment_method", "pg_provider", "paid_at", "newly_paid")],
        changed("status", F.lit("paid"), F.lit("vbank_pending")).alias("status"),
        changed("payment_key", F.col("_p.payment_id"), F.col("_v.payment_id")).alias("payment_key"),
        changed("payment_method", text.clean_payment_method(F.col("_p.method"))).alias("payment_method"),
        changed("pg_provider", provider(F.col("_p.provider")), provider(F.col("_v.provider"))).alias("pg_provider"),
        changed("paid_at", F.col("_p.paid_at")).alias("paid_at"),
        F.coalesce(paid, F.lit(False)).alias("newly_paid"))


def newly_bought(paid_orders: DataFrame, items: DataFrame) -> DataFrame:
    """(user, product) pairs of newly paid orders, with the lowest order of each."""
    new = paid_orders.filter("newly_paid").select("order_id", "user_id")
    return items.select("order_id", "product_id").join(new, "order_id") \
        .groupBy("user_id", "product_id").agg(F.min("order_id").alias("order_id"))


def grant_downloads(downloads: DataFrame, paid_orders: DataFrame, items: DataFrame) -> DataFrame:
    """Add (user, product) rights from newly paid orders where absent."""
    return insert_if_absent(downloads.select("user_id", "product_id", "order_id"),
                            newly_bought(paid_orders, items), ["user_id", "product_id"], [F.col("order_id")])


def clear_cart(cart: DataFrame, paid_orders: DataFrame, items: DataFrame) -> DataFrame:
    """Drop cart rows whose product the same user has just bought."""
    return cart.join(newly_bought(paid_orders, items), ["user_id", "product_id"], "left_anti")


def _own(df: DataFrame, name: str) -> Column:
    """A column the table may have already; null where it has not."""
    return F.col(name) if name in df.columns else F.lit(None)


def use_claims(claims: DataFrame, paid_orders: DataFrame) -> DataFrame:
    """Mark the claims that newly paid orders carry as used."""
    used = paid_orders.filter(F.col("newly_paid") & F.col("claim_id").isNotNull()) \
        .groupBy("claim_id", "user_id").agg(F.min("order_id").alias("_order"))
    return claims.join(used, ["claim_id", "user_id"], "left") \
        .withColumn("used_by_order", F.when(~F.col("is_used"), F.col("_order")).otherwise(_own(claims, "used_by_order"))) \
        .withColumn("is_used", F.col("is_used") | F.col("_order").isNotNull()).drop("_order")


# Refunds -------------------------------------------------------------------

def refund_requests(orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """One accepted request per order.  ``refunds`` holds order_id, line_no
    (null: the whole order) and path ('admin' or 'customer').  Customers can
    only return paid orders, and always whole.  Each path is judged by itself,
    so a wish that is not admissible takes nothing from one that is.  Where
    orders hold ``payment_key``, one without it cannot be refunded."""
    wanted = refunds.withColumn("by_customer", F.coalesce(F.col("path") == "customer", F.lit(False))) \
        .groupBy("order_id", "by_customer").agg(F.bool_or(F.col("line_no").isNull()).alias("whole"))
    paid_by = F.col("payment_key").isNotNull() if "payment_key" in orders.columns else F.lit(True)
    states = orders.filter(F.col("status").isin(REFUNDABLE) & paid_by).select("order_id", "status")
    return wanted.join(states, "order_id").filter(~F.col("by_customer") | (F.col("status") == "paid")) \
        .groupBy("order_id").agg(F.bool_or(F.col("whole") | F.col("by_customer")).alias("whole"),
                                 F.bool_or("by_customer").alias("by_customer"))


def refund_items(items: DataFrame, accepted: DataFrame, refunds: DataFrame) -> DataFrame:
    """Items with their state after the refunds; ``refunded_now`` marks the change."""
    by_admin = F.coalesce(F.col("path") != "customer", F.lit(True))
    lines = refunds.filter(F.col("line_no").isNotNull() & by_admin).select("order_id", "line_no").distinct() \
        .withColumn("_named", F.lit(True))
    found = join_measured(items, accepted.select("order_id", "whole"), ["order_id"], "left")
    found = join_measured(found, lines, ["order_id", "line_no"], "left")
    hit = F.col("whole").isNotNull() & (F.col("whole") | F.coalesce("_named", F.lit(False))) \
        & (F.col("item_status") == "active")
    return found.withColumn("refunded_now", hit) \
        .withColumn("item_status", F.when(hit, "refunded").otherwise(F.col("item_status"))) \
        .drop("whole", "_named")


def refund_orders(orders: DataFrame, refunded_items: DataFrame, accepted: DataFrame) -> DataFrame:
    """Orders after the refunds: 'refund' once no item is active, or on a
    customer's request; with the amount paid back, which adds up over several
    runs.  A partial refund leaves the order's own amount as it was."""
    zero = F.lit(0).cast(MONEY)
    # Summed per order before the join, which then sees one row per order.
    touched = refunded_items.groupBy("order_id").agg(
        F.count_if("refunded_now").alias("_refunded"),
        F.count_if(F.col("item_status") == "active").alias("_left"),
        F.sum(F.when(F.col("refunded_now"), F.col("price"))).alias("_back"))
    found = orders.join(accepted.select("order_id", "by_customer"), "order_id", "left").join(touched, "order_id", "left")
    closed = F.coalesce("by_customer", F.lit(False)) | ((F.col("_refunded") > 0) & (F.col("_left") == 0))
    return found.withColumn("status", F.when(closed, "refund").otherwise(F.col("status"))) \
        .withColumn("refund_amount", F.coalesce(_own(orders, "refund_amount").cast(MONEY), zero) + F.coalesce("_back", zero)) \
        .drop("_refunded", "_left", "_back", "by_customer")


def revoke_downloads(downloads: DataFrame, accepted: DataFrame) -> DataFrame:
    """Customer refunds take the rights back; admin refunds leave them."""
    return join_measured(downloads, accepted.filter("by_customer").select("order_id"), ["order_id"], "left_anti")


# Likes, points, counters ---------------------------------------------------

def like_counts(toggles: DataFrame) -> DataFrame:
    """Likes per item; every second toggle by the same fingerprint takes it
    back.  Order does not matter.  Apply to the whole toggle log."""
    odd = toggles.groupBy("item_id", "fingerprint").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") % 2 == 1)
    return odd.groupBy("item_id").agg(F.count(F.lit(1)).alias("likes"))


def entry_type(amount: Column) -> Column:
    return F.when(amount > 0, "admin_add").otherwise("admin_deduct")


def hour_number(column: str = "created_at") -> Column:
    """Hours since 1970 of a zone-free timestamp; the default ledger bucket."""
    at = F.col(column)
    return F.unix_date(at.cast("date")).cast("bigint") * 24 + F.hour(at)


def running_balances(ledger: DataFrame, bucket: Column | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Balance after every entry, starting at 0 and never below 0.

    Clamping at every step equals the running sum less its lowest value so far
    (at most 0), so no sequential code is needed.
    """
    summed = running_sums(ledger, "user_id", ["created_at", "entry_id"], hour_number() if bucket is None else bucket, "amount", range_rows)
    return summed.withColumn("balance", F.col("running_sum") - F.col("running_min")).drop("running_sum", "running_min")


def point_buckets(ledger: DataFrame, bucket: Column | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per (user, bucket): entries, sum and lowest running sum.  Very full buckets are cut into several."""
    inside = Window.partitionBy("user_id", "_bucket").orderBy("created_at", "entry_id") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut_buckets(ledger, "user_id", ["created_at", "entry_id"], hour_number() if bucket is None else bucket, range_rows) \
        .withColumn("_sum", F.sum("amount").over(inside)) \
        .groupBy("user_id", "_bucket") \
        .agg(F.sum("amount").alias("total"), F.min("_sum").alias("low"), F.count(F.lit(1)).alias("entries"))


def balances_from_buckets(buckets: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Final clamped balance per user from bucket sums and lows, from 0 or
    from ``opening`` (user_id, balance), whose users without entries keep theirs."""
    sums = bucket_starts(buckets, "user_id").groupBy("user_id").agg(
        F.sum("entries").alias("entries"), F.sum("total").alias("_total"), F.min("_low").alias("_low"))
    if opening is None:
        return sums.select("user_id", "entries", (F.col("_total") - F.least(F.lit(0), F.col("_low"))).alias("balance"))
    zero = F.lit(0)
    start, total, low = F.coalesce("_start", zero), F.coalesce("_total", zero), F.coalesce("_low", zero)
    return sums.join(opening.select("user_id", F.col("balance").alias("_start")), "user_id", "full").select(
        "user_id", F.coalesce("entries", zero).cast("bigint").alias("entries"),
        (start + total - F.least(zero, start + low)).alias("balance"))


def point_balances(ledger: DataFrame, bucket: Column | None = None, opening: DataFrame | None = None) -> DataFrame:
    """Final balance per user.  With the balances of an earlier run as
    ``opening``, ``ledger`` needs the entries since that run only."""
    return balances_from_buckets(point_buckets(ledger, bucket), opening)


def review_rewards(reviews: DataFrame, points: int) -> DataFrame:
    """Ledger entries earned by writing reviews."""
    return reviews.select("user_id", F.lit("earn_review").alias("type"), F.lit(points).cast(MONEY).alias("amount"),
                          F.col("review_id").alias("entry_id"), "created_at")


def add_counters(base: DataFrame, events: DataFrame, key: str, counter: str, last: str = "last_at") -> DataFrame:
    """Add the number of events per key to a counter, with the latest time.
    Apply each event table once (``journal.apply_once`` sees to it)."""
    return _counted(base, events, [key], counter, last)


def _counted(base: DataFrame, events: DataFrame, keys: list[str], counter: str, last: str | None) -> DataFrame:
    seen = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("created_at").alias("_last"))
    found = join_measured(base, seen, keys, "left") \
        .withColumn(counter, F.coalesce(F.col(counter), F.lit(0)) + F.coalesce("_n", F.lit(0)))
    if last:
        found = found.withColumn(last, F.greatest(F.col(last), F.col("_last")) if last in base.columns else F.col("_last"))
    return found.drop("_n", "_last")


def count_downloads(rights: DataFrame, products: DataFrame, downloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rights and products after ``downloads`` (user_id, product_id, created_at) of files: both count the downloads
    by users who hold the right, and the right keeps the last time.  Downloads without a right are refused.
    Apply each table of downloads once."""
    allowed = downloads.join(rights.select("user_id", "product_id"), ["user_id", "product_id"], "left_semi")
    counted = rights if "download_count" in rights.columns else rights.withColumn("download_count", F.lit(0).cast("bigint"))
    return (_counted(counted, allowed, ["user_id", "product_id"], "download_count", "last_downloaded_at"),
            _counted(products, allowed, ["product_id"], "download_count", None))


# Generic table changes -----------------------------------------------------

def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert or replace by key; of several new rows the first by ``order`` counts."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return top_n_per_key(both, keys, [F.col("_new").desc(), *order], 1, rank="_rank").drop("_new", "_rank")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add the new rows whose key is not there yet, the first by ``order`` of
    each key.  Repeats go before the join."""
    first = top_n_per_key(new, keys, order, 1, rank="_rank").drop("_rank")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def replace_children(links: DataFrame, parents: DataFrame, new_links: DataFrame, parent: str) -> DataFrame:
    """Give the listed parents a new, de-duplicated set of links."""
    kept = links.join(parents.select(parent), parent, "left_anti")
    wanted = new_links.distinct().join(parents.select(parent), parent, "left_semi")
    return kept.unionByName(wanted)


def soft_delete(df: DataFrame, ids: DataFrame, key: str, flag: str = "is_active") -> DataFrame:
    gone = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    return df.join(gone, key, "left").withColumn(flag, F.col(flag) & F.col("_gone").isNull()).drop("_gone")


def toggle_active(df: DataFrame, toggles: DataFrame, key: str, flag: str = "is_active") -> DataFrame:
    """Flip the flag once per toggle.  Apply each toggle table once."""
    odd = toggles.groupBy(key).agg((F.count(F.lit(1)) % 2 == 1).alias("_odd"))
    return df.join(odd, key, "left") \
        .withColumn(flag, F.col(flag) != F.coalesce("_odd", F.lit(False))).drop("_odd")


def bulk_reorder(df: DataFrame, positions: DataFrame, key: str, column: str = "sort_order") -> DataFrame:
    """New positions from (key, position, seq); the last one per key counts."""
    last = positions.groupBy(key).agg(F.max(F.struct("seq", "position")).alias("_p"))
    return df.join(last, key, "left") \
        .withColumn(column, F.coalesce(F.col("_p.position"), F.col(column))).drop("_p")


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key), key, "left_anti")


def set_null_on_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    gone = deleted.select(key).distinct().withColumn("_gone", F.lit(True))
    return join_measured(children, gone, [key], "left") \
        .withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


# Accounts ------------------------------------------------------------------

def flag_dormant(users: DataFrame, logins: DataFrame, as_of) -> DataFrame:
    """Active accounts whose last login is over a year old become dormant as of
    now; a login within the year that is later than ``dormant_at`` clears the
    flag, so a suspension stays; no login changes nothing."""
    now = dates.as_datetime(as_of)
    limit = now.replace(year=now.year - 1) if (now.month, now.day) != (2, 29) else dt.datetime(now.year - 1, 2, 28)
    last = logins.filter(F.col("created_at") <= dates.ntz(now)).groupBy("user_id").agg(F.max("created_at").alias("_login"))
    seen = F.greatest("_login", "last_login_at") if "last_login_at" in users.columns else F.col("_login")
    since = _own(users, "dormant_at")
    found = users.join(last, "user_id", "left").withColumn("last_login_at", seen).drop("_login")
    lapsed = F.col("is_active") & (F.col("last_login_at") < dates.ntz(limit))
    current = (F.col("last_login_at") >= dates.ntz(limit)) & (since.isNull() | (F.col("last_login_at") > since))
    if "dormant_at" in users.columns:
        found = found.withColumn("_since", F.when(lapsed, F.coalesce(since, dates.ntz(now))).when(~current | current.isNull(), since))
    found = found.withColumn("is_dormant", F.when(lapsed, True).when(current, False).otherwise(F.col("is_dormant")))
    return found.withColumn("dormant_at", F.col("_since")).drop("_since") if "dormant_at" in users.columns else found


def account_actions(users: DataFrame, actions: DataFrame) -> DataFrame:
    """Suspend, restore and deactivate.  The latest suspend or restore decides
    dormancy; one deactivation is final.  Other actions are ignored."""
    dormancy = F.col("action").isin("suspend", "restore")
    latest = actions.filter(F.col("action").isin("suspend", "restore", "deactivate")).groupBy("user_id").agg(
        F.max(F.when(dormancy, F.struct("created_at", "action_id", "action"))).alias("_last"),
        F.bool_or(F.col("action") == "deactivate").alias("_off"))
    last_action = F.col("_last.action")
    return users.join(latest, "user_id", "left") \
        .withColumn("dormant_at", F.when(last_action == "suspend", F.col("_last.created_at"))
                    .when(last_action.isNull(), _own(users, "dormant_at"))) \
        .withColumn("is_dormant", F.coalesce(last_action == "suspend", F.col("is_dormant"))) \
        .withColumn("is_active", F.col("is_active") & ~F.coalesce("_off", F.lit(False))) \
        .drop("_last", "_off")


def rejected_actions(actions: DataFrame) -> DataFrame:
    return actions.filter(~F.col("action").isin("suspend", "restore", "deactivate"))
