"""Join shapes used by the shop's pages.

Sizes are not assumed: no join here carries a broadcast hint, so Spark picks
the strategy from measured sizes and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from . import filters
from .skew import PAGE_LINES, collect_pages, join_measured, page_of


def order_items_detail(items: DataFrame, products: DataFrame, columns: list[str]) -> DataFrame:
    """Items with product attributes."""
    return items.join(products.select("product_id", *columns), "product_id")


def first_item_per_order(items: DataFrame, products: DataFrame) -> DataFrame:
    """One product name per order: the lowest line, then the lowest product."""
    named = order_items_detail(items.select("order_id", "line_no", "product_id"), products, ["name"])
    first = F.min(F.struct("line_no", "product_id", "name"))
    return named.groupBy("order_id").agg(first.alias("_f")).select("order_id", F.col("_f.name").alias("first_product"))


def recent_orders(orders: DataFrame, users: DataFrame, items: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """The n newest orders that have a buyer, with the buyer and the first product.
    ``user_id`` refers to a user or is null, so the n orders are taken before any join."""
    newest = orders.filter(F.col("user_id").isNotNull()).orderBy(F.col("created_at").desc(), F.col("order_id").desc()).limit(n)
    latest = newest.join(users.select("user_id", F.col("name").alias("buyer_name"), F.col("email").alias("buyer_email")), "user_id")
    # At most n rows, a number the caller names: a page, not a table.
    wanted = items.join(F.broadcast(newest.select("order_id")), "order_id", "left_semi")
    return latest.join(first_item_per_order(wanted, products), "order_id", "left")


def orders_with_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Every order, with or without items.

    An outer join cannot split a hot order on the items' side, so the orders
    with items are joined inner and the others added.  Both joins hash the
    narrow side, one row per order, and let the other pass: sorted, a task
    would hold all of its items and its orders twice at once.
    """
    filled = orders.hint("shuffle_hash").join(items, "order_id")
    empty = orders.join(items.select("order_id").distinct().hint("shuffle_hash"), "order_id", "left_anti")
    return filled.unionByName(empty, allowMissingColumns=True)


def order_list(orders: DataFrame, users: DataFrame, items: DataFrame, products: DataFrame, search: str | None = None,
               page_lines: int = PAGE_LINES, **conditions) -> DataFrame:
    """Order list with buyer and product names.

    The search runs on buyer name, e-mail and product name before the names
    are gathered, so an order found by product lists the matching ones only.
    Names stand in the order of the lines, one row per page of ``page_lines``
    line numbers (``page_no``); an order without named items is one row of page 0.
    """
    chosen = filters.filter_orders(orders, **conditions).join(
        users.select("user_id", F.col("name").alias("buyer_name"), F.col("email").alias("buyer_email")), "user_id")
    # The buyer is judged once per order, and only lines of chosen orders travel on.
    chosen = chosen.withColumn("_by_buyer", filters.matches_wild(["buyer_name", "buyer_email"], search))
    lines = join_measured(items.select("order_id", "line_no", "product_id"), chosen.select("order_id", "_by_buyer"), ["order_id"])
    named = order_items_detail(lines, products.filter(F.col("name").isNotNull()), ["name"]) \
        .filter(F.col("_by_buyer") | filters.matches_wild(["name"], search)) \
        .withColumn("page_no", page_of(page_lines=page_lines))
    pages = collect_pages(named, ["order_id"], F.struct("line_no", "product_id", "name"), "_names") \
        .withColumn("product_names", F.array_join("_names.name", ", ")).drop("_names")
    # An order found by its buyer stays without pages; one found by product has at least one.
    return join_measured(chosen, pages, ["order_id"], "left") \
        .filter(F.col("_by_buyer") | F.col("page_no").isNotNull()) \
        .withColumn("page_no", F.coalesce("page_no", F.lit(0).cast("bigint"))).drop("_by_buyer")


def left_with_filtered_right(left: DataFrame, right: DataFrame, on: list[str], condition: Column) -> DataFrame:
    """LEFT JOIN whose extra predicate belongs to ON: filter the right side first."""
    return left.join(right.filter(condition), on, "left")


def settlement_lines(items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Items with their order's state and their product's name."""
    return items.join(orders.select("order_id", "user_id", "status", "paid_at"), "order_id") \
        .join(products.select("product_id", "name"), "product_id")


def child_list(children: DataFrame, parents: DataFrame, parent_key: str, columns: list[str],
               order: list[Column]) -> DataFrame:
    """Children with attributes of their parent, all owners at once, sorted.
    The sort ranges over all of ``order``, so a hot owner spans partitions."""
    return children.join(parents.select(parent_key, *columns), parent_key).orderBy(*order)


def coupon_for_order(requests: DataFrame, claims: DataFrame, coupon_events: DataFrame, day: str = "created_at") -> DataFrame:
    """The coupon a request may use: its own, unused, claimed by the same user,
    and inside the event's window on the day of the request."""
    open_claims = claims.filter(~F.col("is_used")).select("claim_id", "user_id", "coupon_event_id")
    return requests.join(open_claims, ["claim_id", "user_id"]) \
        .join(coupon_events, "coupon_event_id") \
        .filter(filters.runs_on(F.col(day).cast("date")))


def verified_only(reviews: DataFrame, owned: DataFrame) -> DataFrame:
    """Reviews by users who own the product."""
    return reviews.join(owned.select("user_id", "product_id"), ["user_id", "product_id"], "left_semi")


def not_yet_owned(wanted: DataFrame, owned: DataFrame, keys: list[str] = ("user_id", "product_id")) -> DataFrame:
    return wanted.join(owned.select(*keys), list(keys), "left_anti")


def link_identities(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Match sign-in profiles, one per (provider, provider_id), to accounts.

    By (provider, provider_id), else by e-mail; an account found by e-mail that
    has no provider id yet gets this one ('link').  Profiles without an account
    create one.  Of several profiles with one e-mail the first by
    ``profile_no`` links or creates and the later ones follow it.
    """
    by_id = users.filter(F.col("provider_id").isNotNull()).groupBy("provider", "provider_id") \
        .agg(F.min("user_id").alias("_by_id"))
    by_email = users.filter(F.col("email").isNotNull()).groupBy("email") \
        .agg(F.min(F.struct("user_id", "provider_id")).alias("_by_email"))
    found = profiles.join(by_id, ["provider", "provider_id"], "left")
    # One row per address, so that the profiles meet their e-mail in one join.
    addresses = found.filter(F.col("_by_id").isNull() & F.col("email").isNotNull()) \
        .groupBy("email").agg(F.min("profile_no").alias("_first")).join(by_email, "email", "left")
    found = join_measured(found, addresses, ["email"], "left")
    is_first = F.coalesce(F.col("_first") == F.col("profile_no"), F.lit(True))
    user_id = F.coalesce(F.col("_by_id"), F.col("_by_email.user_id"))
    action = F.when(F.col("_by_id").isNotNull(), "match") \
        .when(user_id.isNotNull() & is_first & F.col("_by_email.provider_id").isNull(), "link") \
        .when(user_id.isNotNull(), "match") \
        .when(is_first, "create").otherwise("join")
    address = F.coalesce(F.col("email"), text.fallback_email(F.col("provider"), F.col("provider_id")))
    return found.select("profile_no", "provider", "provider_id", user_id.alias("user_id"),
                        address.alias("email"), action.alias("action"))


def reconcile_payments(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders against the gateway's feed, one row per order id on either side.

    The feed is combined per order first, so repeated payments cost nothing in
    the join and show up as 'duplicate'.
    """
    fed = payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("payments"),
        F.count_if(F.col("payment_status") == "PAID").alias("paid_payments"),
        F.min(F.when(F.col("payment_status") == "PAID", F.col("amount"))).alias("paid_low"),
        F.max(F.when(F.col("payment_status") == "PAID", F.col("amount"))).alias("paid_high"))
    both = orders.select("order_id", "final_amount", F.lit(True).alias("_known")).join(fed, "order_id", "full")
    # A null amount equals no payment.
    same = F.col("paid_low").eqNullSafe(F.col("final_amount")) & F.col("paid_high").eqNullSafe(F.col("final_amount"))
    result = F.when(F.col("_known").isNull(), "missing_order") \
        .when(F.col("payments").isNull(), "missing_payment") \
        .when(F.col("paid_payments") == 0, "unpaid") \
        .when(~same | F.col("final_amount").isNull(), "mismatch") \
        .when(F.col("paid_payments") > 1, "duplicate") \
        .otherwise("ok")
    return both.withColumn("result", result).drop("_known")


def attach_stats(products: DataFrame, stats: DataFrame) -> DataFrame:
    """Live counters where there are any, else the stored ones, else 0."""
    live = stats.select("product_id", F.col("view_count").alias("_views"), F.col("purchase_count").alias("_sales"))
    return products.join(live, "product_id", "left") \
        .withColumn("views", F.coalesce("_views", "view_count", F.lit(0))) \
        .withColumn("downloads", F.coalesce("_sales", "download_count", F.lit(0))) \
        .drop("_views", "_sales")


def attach_label(df: DataFrame, labels: DataFrame, code: str, label: str = "label") -> DataFrame:
    """Label from a dimension (code, label), falling back to the code."""
    dim = labels.select(F.col("code").alias(code), F.col("label").alias("_label"))
    return df.join(dim, code, "left").withColumn(label, F.coalesce("_label", code)).drop("_label")

