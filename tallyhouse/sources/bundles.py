"""Per-user data bundles for export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import ntz
from ..operators.catalog import orders_with_items
from ..operators.customers import section
from ..operators.joins import order_items_detail
from ..operators.skew import PAGE_LINES


def user_bundles(users: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, downloads: DataFrame,
                 reviews: DataFrame, ledger: DataFrame, exported_at, page_lines: int = PAGE_LINES) -> DataFrame:
    """Profile, orders with items, downloads, reviews and points per user, as rows of sections.

    One row per profile, page of an order's items, download, review and point
    entry, each in the struct named like its section.  Orders without items are left out.
    Rows of unknown users go before names and items widen them.
    """
    def known(rows):
        return rows.join(users.select("user_id"), "user_id", "left_semi")

    full = orders_with_items(known(orders.select("order_id", "user_id", "final_amount", "status", "paid_at", "created_at")),
                             items, products, page_lines)
    rights, written = (order_items_detail(known(rows), products, ["name"]) for rows in (downloads, reviews))
    entries = [section(full, "orders", "order_id", ["order_id", "page_no", "final_amount", "status", "paid_at", "items"]),
               section(rights, "downloads", "product_id", ["product_id", "name"]),
               section(written, "reviews", "review_id", ["name", "rating"]),
               section(known(ledger), "point_history", "entry_id", ["type", "amount"])]
    profile = users.select("user_id", F.lit("profile").alias("section"),
                           F.struct("user_id", "email", "name", "provider").alias("profile"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [profile, *entries]) \
        .withColumn("exported_at", ntz(exported_at))


def write_bundles(bundles: DataFrame, path: str, buckets: int = 64) -> None:
    """JSON lines, packed by gzip, in ``buckets`` folders by user, so one user's rows lie together.
    Every row repeats the keys and most names, so packing leaves about a tenth."""
    bundles.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets))) \
        .write.mode("errorifexists").partitionBy("bucket").json(path, compression="gzip")
