"""Product statistics, reviews, carts, links, inquiries, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.money import MONEY, one_decimal_mean
from .skew import PAGE_LINES, collect_pages, join_measured, page_of, top_n_per_key


def paid_order_counts(items: DataFrame, orders: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct paid orders per product.  The exact count is taken by
    (product, order) first, in a shuffle of its own, so that neither a hot
    product nor a hot order stays in one task."""
    paid = join_measured(items.select("order_id", "product_id"),
                         orders.filter(F.col("status") == "paid").select("order_id"), ["order_id"], "left_semi")
    count = F.approx_count_distinct("order_id") if approximate else F.count_distinct("order_id")
    return paid.groupBy("product_id").agg(count.alias("purchase_count"))


def product_stats(products: DataFrame, items: DataFrame, orders: DataFrame, approximate: bool = False) -> DataFrame:
    return products.filter("is_active").select("product_id", "view_count") \
        .join(paid_order_counts(items, orders, approximate), "product_id", "left") \
        .withColumn("purchase_count", F.coalesce("purchase_count", F.lit(0)))


def review_summary(products: DataFrame, reviews: DataFrame, empty: str | None = "0.0", shown_only: bool = False) -> DataFrame:
    """Count, mean with one decimal and a count per star; ``empty`` is the mean of no reviews.
    ``shown_only`` leaves out reviews that are not active, as a product's page does."""
    reviews = reviews.filter("is_active") if shown_only else reviews
    stars = [F.count_if(F.col("rating") == s).alias(f"stars_{s}") for s in range(1, 6)]
    sums = reviews.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("rating").cast("bigint")).alias("_sum"), *stars)
    zero = F.lit(0).cast("bigint")
    return products.select("product_id").join(sums, "product_id", "left").select(
        "product_id",
        F.coalesce("total", zero).alias("total"),
        F.when(F.col("total") > 0, one_decimal_mean(F.col("_sum"), F.col("total"))).otherwise(F.lit(empty)).alias("average"),
        *[F.coalesce(f"stars_{s}", zero).alias(f"stars_{s}") for s in range(1, 6)])


def cart_totals(cart: DataFrame, owner: str = "user_id") -> DataFrame:
    """Whole cart and checked part per owner."""
    zero = F.lit(0).cast(MONEY)
    return cart.groupBy(owner).agg(
        F.count(F.lit(1)).alias("item_count"), F.sum("price").alias("total"),
        F.count_if("checked").alias("checked_count"),
        F.coalesce(F.sum(F.when(F.col("checked"), F.col("price"))), zero).alias("checked_total"))


def linked_ids(parents: DataFrame, links: DataFrame, parent: str, child: str) -> DataFrame:
    """One row per link of a parent, and one with a null child for a parent
    without any.  Flat, so that a parent with very many links is no list in one task."""
    found = links.filter(F.col(child).isNotNull()).select(parent, child)
    bare = parents.join(found.select(parent).distinct(), parent, "left_anti")
    return join_measured(parents, found, [parent]).unionByName(bare, allowMissingColumns=True)


def orders_with_items(orders: DataFrame, items: DataFrame, products: DataFrame, page_lines: int = PAGE_LINES) -> DataFrame:
    """Orders that have items, with a nested item list per page of ``page_lines`` line numbers (``page_no``)."""
    rows = items.select("order_id", "line_no", "product_id", "price") \
        .join(products.select("product_id", "name", "category"), "product_id") \
        .withColumn("page_no", page_of(page_lines=page_lines))
    pages = collect_pages(rows, ["order_id"], F.struct("line_no", "product_id", "name", "price", "category"), "items")
    return join_measured(orders, pages, ["order_id"])


def items_json(items_column: str = "items"):
    return F.to_json(F.col(items_column))


def inquiry_summary(inquiries: DataFrame) -> DataFrame:
    return inquiries.agg(F.count_if(~F.col("answered")).alias("unanswered"),
                         F.count_if("answered").alias("answered"),
                         F.count(F.lit(1)).alias("total"))


def category_counts(products: DataFrame) -> DataFrame:
    return products.filter("is_active").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def category_preview(products: DataFrame, n: int = 4) -> DataFrame:
    return top_n_per_key(products.filter("is_active"), ["category"], [F.col("product_id").asc()], n)


def settings_map(settings: DataFrame, owner: list[str]) -> DataFrame:
    """Key/value rows to one map per owner.  The latest value of a key wins, so
    a map holds each key once and stays as small as the set of keys."""
    latest = settings.groupBy(*owner, "key").agg(F.max_by("value", "updated_at").alias("value"))
    pairs = F.sort_array(F.collect_list(F.struct("key", "value")))
    return latest.groupBy(*owner).agg(F.map_from_entries(pairs).alias("settings"))


def state_after_refund(orders: DataFrame, items: DataFrame) -> DataFrame:
    """An order none of whose items is active any more becomes 'refund';
    orders without items keep their state."""
    left = items.groupBy("order_id").agg(F.count_if(F.col("item_status") == "active").alias("remaining"))
    return orders.join(left, "order_id", "left") \
        .withColumn("new_status", F.when(F.col("remaining") == 0, "refund").otherwise(F.col("status")))


def catalog_view(products: DataFrame, stats: DataFrame) -> DataFrame:
    """Public projection of the active products with defaults and statistics."""
    from ..functions import money
    from ..functions.fixed_values import DEFAULT_SALE_TYPE
    from .joins import attach_stats
    live = attach_stats(products.filter("is_active"), stats)
    return live.select(
        "product_id", "name", F.col("category").alias("cat"), "price",
        F.coalesce("discount_price", F.lit(0).cast(MONEY)).alias("discount"),
        money.default_if_falsy(F.col("sale_type"), DEFAULT_SALE_TYPE, empty="").alias("type"),
        F.coalesce("description", F.lit("")).alias("desc"),
        money.shown_price(F.col("price"), F.col("discount_price")).alias("shown_price"),
        money.badge(F.col("new_badge"), F.col("best_badge")).alias("badge"),
        "views", "downloads")
