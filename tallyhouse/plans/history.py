"""Queries over order histories, deletions, day copies and sums, journals and ranked copies."""

from pyspark.sql import functions as F

from ..functions.fixed_values import REFUND_STATUSES, SETTLED_STATUSES, VALID_STATUSES
from ..operators import changes, daysums, history, references, reports
from ..session import run_dir
from ..sources import days, journal, ranked
from .output import plain
from .registry import query
from .shop import ORDERS_AS_OF

FIRST, LAST = "2001-06-01", "2001-06-30"


# Orders as the outcome of their events

@query("M2 M3", sql="""
SELECT order_id, user_id, final_amount, status, payment_key, payment_method, pg_provider, paid_at, refund_amount::BIGINT AS refund_amount, refunded_by
FROM shop_history
""")
def order_history(shop):
    states, _ = history.fold(shop.ordered, shop.items, shop.order_events)
    return plain(states, "order_id", "user_id", "final_amount", "status", "payment_key", "payment_method", "pg_provider", "paid_at", "refund_amount",
                 "refunded_by")


@query("M3", sql="""
SELECT order_id, line_no::BIGINT AS line_no, product_id, CASE WHEN refunded_at IS NULL THEN 'active' ELSE 'refunded' END AS item_status, refunded_at
FROM shop_line_history
""")
def item_history(shop):
    _, states = history.fold(shop.ordered, shop.items, shop.order_events)
    return plain(states, "order_id", "line_no", "product_id", "item_status", "refunded_at")


@query("M2", sql="""
SELECT c.claim_id, c.user_id, c.is_used OR h.order_id IS NOT NULL AS is_used, CASE WHEN NOT c.is_used THEN h.paid_at END AS used_at,
       CASE WHEN NOT c.is_used THEN h.order_id END AS used_by_order
FROM shop_claims c
LEFT JOIN (SELECT claim_id, user_id, min(paid_at) AS paid_at, arg_min(order_id, (paid_at, order_id)) AS order_id
           FROM shop_history WHERE paid_at IS NOT NULL GROUP BY claim_id, user_id) h ON h.claim_id = c.claim_id AND h.user_id = c.user_id
""")
def claims_used(shop):
    states, _ = history.fold(shop.ordered, shop.items, shop.order_events)
    return history.use_coupons(shop.claims, states, "claim_id", "used_by_order").select("claim_id", "user_id", "is_used", "used_at", "used_by_order")


@query("M2", sql="""
WITH held AS (SELECT user_id, user_id % 50 AS coupon_id, user_id % 9 = 0 AS is_used FROM shop_users
              UNION ALL SELECT user_id, user_id % 50 + 50, false FROM shop_users)
SELECT k.user_id, k.coupon_id, k.is_used OR h.paid_at IS NOT NULL AS is_used, CASE WHEN NOT k.is_used THEN h.paid_at END AS used_at
FROM held k LEFT JOIN (SELECT user_id, coupon_id, min(paid_at) AS paid_at FROM shop_history WHERE paid_at IS NOT NULL GROUP BY ALL) h
  ON h.user_id = k.user_id AND h.coupon_id = k.coupon_id
""")
def user_coupons_used(shop):
    states, _ = history.fold(shop.ordered, shop.items, shop.order_events)
    return history.use_coupons(shop.user_coupons, states, "coupon_id").select("user_id", "coupon_id", "is_used", "used_at")


# Deletions along the references

# A user goes unless an order, a right or a point entry holds it, with its claims; an order goes with its lines unless a right holds it.
DELETION = """
WITH wished AS (SELECT user_id FROM shop_users WHERE NOT is_active),
stuck AS (SELECT user_id FROM shop_orders UNION SELECT user_id FROM shop_downloads UNION SELECT user_id FROM shop_ledger),
gone AS (SELECT user_id FROM wished WHERE user_id NOT IN (SELECT user_id FROM stuck)),
orders_gone AS (SELECT order_id FROM shop_orders WHERE status = 'refund' AND order_id NOT IN (SELECT order_id FROM shop_downloads)),
events_gone AS (SELECT coupon_event_id FROM shop_coupon_events WHERE coupon_event_id % 2 = 0),
claims_left AS (SELECT * FROM shop_claims WHERE user_id NOT IN (SELECT user_id FROM gone)
                AND (coupon_event_id IS NULL OR coupon_event_id NOT IN (SELECT coupon_event_id FROM events_gone)))
SELECT 'users' AS name, (SELECT count(*) FROM shop_users) - (SELECT count(*) FROM gone) AS n_rows,
       (SELECT count(*) FROM wished) - (SELECT count(*) FROM gone) AS refused
UNION ALL
SELECT 'orders', (SELECT count(*) FROM shop_orders) - (SELECT count(*) FROM orders_gone),
       (SELECT count(*) FROM shop_orders WHERE status = 'refund') - (SELECT count(*) FROM orders_gone)
UNION ALL SELECT 'order_items', count(*), 0 FROM shop_items WHERE order_id NOT IN (SELECT order_id FROM orders_gone)
UNION ALL SELECT 'downloads', count(*), 0 FROM shop_downloads
UNION ALL SELECT 'point_history', count(*), 0 FROM shop_ledger
UNION ALL SELECT 'coupon_events', count(*), 0 FROM shop_coupon_events WHERE coupon_event_id % 2 = 1
UNION ALL SELECT 'coupon_event_downloads', count(*), 0 FROM claims_left
"""


def _deletion(shop):
    rights = shop.downloads.withColumn("download_id", F.concat_ws("-", "user_id", "product_id"))
    items = shop.items.withColumn("item_id", F.concat_ws("-", "order_id", "line_no"))
    tables = {"users": shop.users, "orders": shop.orders, "order_items": items, "downloads": rights, "point_history": shop.ledger,
              "coupon_events": shop.coupon_events, "coupon_event_downloads": shop.claims}
    keys = {"users": "user_id", "orders": "order_id", "order_items": "item_id", "downloads": "download_id", "point_history": "entry_id",
            "coupon_events": "coupon_event_id", "coupon_event_downloads": "claim_id"}
    wishes = {"users": shop.users.filter(~F.col("is_active")).select(F.col("user_id").alias("key")),
              "orders": shop.orders.filter("status = 'refund'").select(F.col("order_id").alias("key")),
              "coupon_events": shop.coupon_events.filter("coupon_event_id % 2 = 0").select(F.col("coupon_event_id").alias("key"))}
    # The test tables have no author of a coupon event and no catalog of their rights' products.
    known = [r for r in references.SHOP_REFERENCES if r.column not in ("created_by", "product_id")]
    return tables, *references.delete_rows(tables, known, keys, wishes)


@query("M15 Q4", sql=DELETION)
def delete_with_references(shop):
    tables, left, refused = _deletion(shop)
    counts = [left[name].agg(F.count(F.lit(1)).alias("n_rows")).withColumn("name", F.lit(name)) for name in tables]
    wishes = [refused[name].agg(F.count(F.lit(1)).alias("refused")).withColumn("name", F.lit(name)) for name in refused]

    def stacked(frames):
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    return stacked(counts).join(stacked(wishes), "name", "left").select("name", "n_rows", F.coalesce("refused", F.lit(0).cast("bigint")).alias("refused"))


# Reports from a copy in one folder per day

def day_copy(shop):
    """The orders in one folder per day of payment."""
    folder = run_dir(shop.spark, "orders-by-day")
    dated = days.with_day(shop.orders, "paid_at")
    days.write_days(dated, folder, "order_id")
    return days.read_days(shop.spark, folder, dated.schema)


@query("A28 A1 A2 A3", like="dashboard_kpis")
def dashboard_kpis_by_day(shop):
    return plain(reports.dashboard_kpis(day_copy(shop), ORDERS_AS_OF, "day"))


@query("A13", like="settlement_summary")
def settlement_summary_by_day(shop):
    return plain(reports.settlement_summary(day_copy(shop), FIRST, LAST, "day"))


@query("A14", like="settlement_monthly")
def settlement_monthly_by_day(shop):
    return plain(reports.settlement_monthly(day_copy(shop), 2001, "day"))


# Reports from sums that are kept up to date

REFUNDED = f"""
refunded AS (
  SELECT o.* REPLACE (CASE WHEN o.status = 'paid' AND o.payment_method = '1-URGENT' THEN 'refund' ELSE o.status END AS status) FROM shop_orders o)
"""


def _refunded(shop):
    """Orders before and after all urgent ones are given back: the changed rows alone."""
    before = shop.orders.filter((F.col("status") == "paid") & (F.col("payment_method") == "1-URGENT"))
    return before, before.withColumn("status", F.lit("refund"))


def kept_sums(shop):
    """Sums of the orders as they were, with the change folded in; it is delivered twice."""
    folder = run_dir(shop.spark, "day-sums")
    journal.create(daysums.order_sums(shop.orders), folder)
    before, after = (daysums.order_sums(rows) for rows in _refunded(shop))
    for _ in range(2):
        journal.apply_once(shop.spark, folder, "refunds", lambda sums: daysums.changed(sums, before, after, daysums.ORDER_GROUPS))
    return journal.current(shop.spark, folder)


@query("A1 A2 A4 A13", sql=f"""
WITH {REFUNDED}
SELECT CAST(CAST(paid_at AS DATE) AS VARCHAR) AS day, status, payment_method, count(*)::BIGINT AS n, sum(final_amount)::DOUBLE AS amount FROM refunded GROUP BY ALL
""")
def day_sums_after_refunds(shop):
    return plain(kept_sums(shop), "day", "status", "payment_method", "n", "amount")


def whole(df):
    """Whole amounts as bigint."""
    return plain(df.select(*[F.col(f.name).cast("bigint").alias(f.name) if f.dataType.simpleString().startswith("decimal") else f.name for f in df.schema]))


def _in(statuses):
    return "(" + ", ".join(f"'{s}'" for s in statuses) + ")"


JUNE = "CAST(paid_at AS DATE) BETWEEN DATE '2001-06-01' AND DATE '2001-06-30'"


@query("A13", sql=f"""
WITH {REFUNDED}
SELECT count(*)::BIGINT AS total_count, (count(*) FILTER (status IN {_in(VALID_STATUSES)}))::BIGINT AS valid_count,
       (count(*) FILTER (status IN {_in(REFUND_STATUSES)}))::BIGINT AS refund_count, coalesce(sum(final_amount), 0)::BIGINT AS gross,
       coalesce(sum(final_amount) FILTER (status IN {_in(REFUND_STATUSES)}), 0)::BIGINT AS refund_amount
FROM refunded WHERE status IN {_in(SETTLED_STATUSES)} AND {JUNE}
""")
def settlement_summary_from_sums(shop):
    return whole(daysums.settlement_summary(kept_sums(shop), FIRST, LAST))


@query("A14", sql=f"""
WITH {REFUNDED}
SELECT month(paid_at)::BIGINT AS month, (count(*) FILTER (status NOT IN {_in(REFUND_STATUSES)}))::BIGINT AS valid_count,
       (count(*) FILTER (status IN {_in(REFUND_STATUSES)}))::BIGINT AS refund_count,
       coalesce(sum(final_amount) FILTER (status NOT IN {_in(REFUND_STATUSES)}), 0)::BIGINT AS amount,
       coalesce(sum(final_amount) FILTER (status IN {_in(REFUND_STATUSES)}), 0)::BIGINT AS refund_amount
FROM refunded WHERE status IN {_in(SETTLED_STATUSES)} AND year(paid_at) = 2001 GROUP BY ALL
""")
def settlement_monthly_from_sums(shop):
    return whole(daysums.settlement_monthly(kept_sums(shop), 2001))


@query("A28 A1 A2 A3", sql=f"""
WITH {REFUNDED}
SELECT (count(*) FILTER (status = 'paid' AND CAST(paid_at AS DATE) = DATE '2001-06-30'))::BIGINT AS today_count,
  coalesce(sum(final_amount) FILTER (status = 'paid' AND CAST(paid_at AS DATE) = DATE '2001-06-30'), 0)::BIGINT AS today_amount,
  (count(*) FILTER (status = 'paid' AND {JUNE}))::BIGINT AS month_count,
  coalesce(sum(final_amount) FILTER (status = 'paid' AND {JUNE}), 0)::BIGINT AS month_amount,
  (count(*) FILTER (status = 'pending'))::BIGINT AS pending
FROM refunded
""")
def dashboard_kpis_from_sums(shop):
    return whole(daysums.dashboard_kpis(kept_sums(shop), ORDERS_AS_OF))


@query("A5", like="daily_sales_filled")
def daily_sales_filled_from_sums(shop):
    sold = daysums.sold_by_day(daysums.order_sums(shop.orders), "2001-06-24", ORDERS_AS_OF)
    return whole(reports.filled_days(sold, ORDERS_AS_OF))


@query("A16", sql=f"""
WITH {REFUNDED},
methods AS (SELECT payment_method, count(*) AS n, sum(final_amount) AS won FROM refunded WHERE status IN {_in(VALID_STATUSES)} AND {JUNE} GROUP BY ALL)
SELECT payment_method, n::BIGINT AS order_count, won::BIGINT AS amount, won::DOUBLE / (SELECT sum(won) FROM methods)::DOUBLE AS share FROM methods
""")
def payment_mix_from_sums(shop):
    return whole(daysums.payment_mix(kept_sums(shop), FIRST, LAST))


@query("A15", like="settlement_by_product")
def settlement_by_product_from_sums(shop):
    found = daysums.settlement_by_product(daysums.line_sums(shop.items, shop.orders), shop.products, FIRST, LAST)
    return whole(found.select("product_id", "name", "sale_count", "refund_count", "gross", "refund_amount"))


# Changes that are applied once

@query("M11 M9", like="add_counters")
def add_counters_once(shop):
    """The views come in two halves, the second of which is delivered twice."""
    folder = run_dir(shop.spark, "counters")
    journal.create(shop.products.select("product_id", "view_count", F.lit(None).cast("timestamp_ntz").alias("last_at")), folder)
    for batch in (0, 1, 1):
        views = shop.events_of("view").filter(F.col("event_id") % 2 == batch).select(F.col("item_id").alias("product_id"), "created_at")
        journal.apply_once(shop.spark, folder, f"views-{batch}",
                           lambda table, views=views: changes.add_counters(table, views, "product_id", "view_count"))
    return journal.current(shop.spark, folder)


# Deep pages

@query("T5", sql="""
SELECT order_id, user_id, created_at FROM shop_orders ORDER BY created_at DESC, order_id DESC LIMIT 50 OFFSET (SELECT count(*) // 100 * 50 FROM shop_orders)
""")
def order_page_deep(shop):
    """The page in the middle of all orders, from a ranked copy."""
    order = [F.col("created_at").desc(), F.col("order_id").desc()]
    rows, folder = shop.orders.select("order_id", "user_id", "created_at"), run_dir(shop.spark, "ranked")
    ranked.write_ranked(rows, order, folder, range_rows=1_000)
    return ranked.read_page(shop.spark, folder, rows.schema, order, rows.count() // 100 + 1, 50)
