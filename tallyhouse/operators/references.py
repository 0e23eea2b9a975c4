"""Deleting rows along all references between tables.

A reference says what a deletion of its parent does: ``cascade`` deletes the
children too, ``null`` empties their column, and ``keep`` forbids it as long as a
child stays.  A wish whose rows, or rows that would go with them, are held by a
``keep`` is refused as a whole; the others are carried out, in the order of the
references.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import run_dir
from .skew import join_measured


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str
    on_delete: str  # cascade, null or keep


# The shop's references, table and column by table.
SHOP_REFERENCES = [Reference(*r) for r in [
    ("cart_items", "user_id", "users", "cascade"),
    ("cart_items", "product_id", "products", "cascade"),
    ("orders", "user_id", "users", "keep"),
    ("order_items", "order_id", "orders", "cascade"),
    ("order_items", "product_id", "products", "keep"),
    ("downloads", "user_id", "users", "keep"),
    ("downloads", "product_id", "products", "keep"),
    ("downloads", "order_id", "orders", "keep"),
    ("reviews", "user_id", "users", "null"),
    ("user_coupons", "user_id", "users", "keep"),
    ("user_coupons", "coupon_id", "coupons", "keep"),
    ("point_history", "user_id", "users", "keep"),
    ("coupon_events", "created_by", "users", "keep"),
    ("coupon_event_products", "coupon_event_id", "coupon_events", "cascade"),
    ("coupon_event_downloads", "user_id", "users", "cascade"),
    ("coupon_event_downloads", "coupon_event_id", "coupon_events", "cascade"),
    ("site_events", "created_by", "users", "keep"),
    ("site_event_products", "site_event_id", "site_events", "cascade"),
    ("admin_notes", "user_id", "users", "cascade"),
    ("admin_notes", "created_by", "users", "keep"),
]]


def parents_first(tables: list[str], references: list[Reference]) -> list[str]:
    """The tables so that every parent stands before its children."""
    left, out = set(tables), []
    while left:
        free = sorted(t for t in left if not any(r.child == t and r.parent in left for r in references))
        if not free:
            raise ValueError(f"references go round among {sorted(left)}")
        out += free
        left -= set(free)
    return out


def _any(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames).distinct()


def doomed_by(tables: dict[str, DataFrame], references: list[Reference], keys: dict[str, str], wishes: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Per table the keys (key) that go: those wished for and, from parent to child, those that cascade."""
    gone: dict[str, DataFrame] = {}
    for name in parents_first(list(tables), references):
        found = [tables[name].select(F.col(keys[name]).alias("key")).join(wishes[name], "key", "left_semi")] if name in wishes else []
        for r in references:
            if r.child == name and r.on_delete == "cascade" and r.parent in gone:
                rows = tables[name].select(F.col(keys[name]).alias("key"), F.col(r.column).alias("_parent"))
                found.append(join_measured(rows, gone[r.parent].withColumnRenamed("key", "_parent"), ["_parent"], "left_semi").select("key"))
        if found:
            gone[name] = _any(found)
    return gone


def held(tables: dict[str, DataFrame], references: list[Reference], keys: dict[str, str], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Per table the keys among ``gone`` that may not go: a child that stays
    holds them, or one that would go with them is held itself."""
    out: dict[str, DataFrame] = {}
    for name in reversed(parents_first(list(tables), references)):
        found = []
        for r in references:
            if r.parent != name or name not in gone or r.on_delete == "null" or r.child not in tables:
                continue
            rows = tables[r.child].filter(F.col(r.column).isNotNull()).select(F.col(keys[r.child]).alias("_child"), F.col(r.column).alias("key"))
            if r.on_delete == "keep":
                stay = rows if r.child not in gone else rows.join(gone[r.child].withColumnRenamed("key", "_child"), "_child", "left_anti")
                # Once per parent before the join, so that a hot parent is one row in it.
                found.append(stay.select("key").distinct().join(gone[name], "key", "left_semi"))
            elif r.child in out:
                found.append(rows.join(out[r.child].withColumnRenamed("key", "_child"), "_child", "left_semi").select("key").distinct()
                             .join(gone[name], "key", "left_semi"))
        if found:
            out[name] = _any(found)
    return out


def delete_rows(tables: dict[str, DataFrame], references: list[Reference], keys: dict[str, str],
                wishes: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables after the deletion of the rows whose key ``wishes`` (key) name,
    and the refused wishes.  ``keys`` names each table's key.

    Refusing one wish can leave a row that holds another, so wishes are judged
    until none more is refused; each round's are written to the shared folder.
    """
    references = [r for r in references if r.child in tables and r.parent in tables]
    spark = next(iter(tables.values())).sparkSession
    folder, rounds = run_dir(spark, "deletion"), 0
    left = {name: frame.select("key").distinct() for name, frame in wishes.items()}
    while True:
        gone = doomed_by(tables, references, keys, left)
        stuck = held(tables, references, keys, gone)
        refused = False
        for name in list(left):
            if name not in stuck:
                continue
            kept = left[name].join(stuck[name], "key", "left_anti")
            path = f"{folder}/{name}-{rounds}"
            kept.write.parquet(path)
            kept = spark.read.schema(kept.schema).parquet(path)
            refused = refused or not left[name].join(kept, "key", "left_anti").isEmpty()
            left[name] = kept
        rounds += 1
        if not refused:
            break
    out = {}
    for name, table in tables.items():
        kept = table
        if name in gone:
            kept = kept.join(gone[name].withColumnRenamed("key", keys[name]), keys[name], "left_anti")
        for r in references:
            if r.child == name and r.on_delete == "null" and r.parent in gone:
                lost = gone[r.parent].select(F.col("key").alias(r.column), F.lit(True).alias("_lost"))
                kept = join_measured(kept, lost, [r.column], "left") \
                    .withColumn(r.column, F.when(F.col("_lost").isNull(), F.col(r.column))).drop("_lost")
        out[name] = kept.select(*table.columns)
    return out, {name: frame.select("key").distinct().join(left[name], "key", "left_anti") for name, frame in wishes.items()}
