"""Whitelisted sort orders, top-k and paging.  Every order ends in the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates


def sort_products(products: DataFrame, mode: str = "newest") -> DataFrame:
    modes = {
        "price_asc": [F.col("price").asc()],
        "price_desc": [F.col("price").desc()],
        "popular": [F.col("download_count").desc()],
        "newest": [F.col("created_at").desc()],
    }
    return products.orderBy(*modes.get(mode, modes["newest"]), F.col("product_id").asc())


def sort_by_price(products: DataFrame, mode: str, position: str = "product_id") -> DataFrame:
    """Stable price sort of a shown list; any other mode keeps its order."""
    modes = {"price-asc": [F.col("price").asc()], "price-desc": [F.col("price").desc()]}
    return products.orderBy(*modes.get(mode, []), F.col(position).asc())


def sort_reviews(reviews: DataFrame, mode: str = "popular") -> DataFrame:
    newest = F.col("created_at").desc()
    modes = {
        "popular": [F.col("likes_count").desc(), newest],
        "latest": [newest],
        "rating": [F.col("rating").desc(), newest],
    }
    return reviews.orderBy(*modes.get(mode, modes["popular"]), F.col("review_id").asc())


def manual_order(df: DataFrame, key: str, newest_first: bool) -> DataFrame:
    created = F.col("created_at").desc() if newest_first else F.col("created_at").asc()
    return df.orderBy(F.col("sort_order").asc(), created, F.col(key).asc())


def newest_first(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), F.col(key).desc())


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """Page by position.  Spark keeps number * size rows, so use ``page_after``
    or a copy from ``sources.ranked`` for deep pages."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, created_at, key, size: int = 50, key_column: str = "order_id", day: str | None = None) -> DataFrame:
    """The page that follows the row (created_at, key) in newest-first order.
    Only ``size`` rows per task survive, however deep the page.  ``day`` names
    the date of ``created_at``, if there is a column for it; newer days are then not read."""
    last = F.lit(created_at).cast("timestamp_ntz")
    later = (F.col("created_at") < last) | ((F.col("created_at") == last) & (F.col(key_column) < key))
    later = later & dates.days_between(day, last=created_at)
    return newest_first(df.filter(later), key_column).limit(size)
