"""State-change queries."""

from pyspark.sql import functions as F

from ..operators import changes
from ..functions.fixed_values import REVIEW_POINTS
from .output import plain
from .registry import query
from .shop import ORDERS_AS_OF


def _paid(shop):
    return changes.apply_payments(shop.open_orders, shop.payments)


@query("M2 J12 X24", sql="""
SELECT order_id, user_id, status, payment_key, payment_method, pg_provider, paid_at, newly_paid FROM shop_paid
""")
def apply_payments(shop):
    return _paid(shop).select("order_id", "user_id", "status", "payment_key", "payment_method", "pg_provider", "paid_at",
                              "newly_paid")


@query("M2 M7", sql="""
SELECT user_id, product_id, order_id FROM shop_downloads
UNION ALL
SELECT user_id, product_id, order_id FROM shop_bought b
WHERE NOT EXISTS (SELECT 1 FROM shop_downloads d WHERE d.user_id = b.user_id AND d.product_id = b.product_id)
""")
def grant_downloads(shop):
    return changes.grant_downloads(shop.downloads, _paid(shop), shop.items)


@query("M2 J10", sql="""
SELECT o.user_id, i.product_id, i.order_id, i.line_no::BIGINT AS line_no
FROM shop_items i JOIN shop_orders o ON o.order_id = i.order_id
WHERE o.status = 'refund' AND NOT EXISTS (SELECT 1 FROM shop_bought b WHERE b.user_id = o.user_id AND b.product_id = i.product_id)
""")
def clear_cart(shop):
    cart = shop.items.join(shop.orders.filter(F.col("status") == "refund").select("order_id", "user_id"), "order_id") \
        .select("user_id", "product_id", "order_id", "line_no")
    return plain(changes.clear_cart(cart, _paid(shop), shop.items), "user_id", "product_id", "order_id", "line_no")


@query("M2", sql="""
SELECT c.claim_id, c.user_id, c.coupon_event_id, c.is_used OR u.order_id IS NOT NULL AS is_used,
       CASE WHEN NOT c.is_used THEN u.order_id END AS used_by_order
FROM shop_claims c
LEFT JOIN (SELECT claim_id, user_id, min(order_id) AS order_id FROM shop_paid WHERE newly_paid GROUP BY claim_id, user_id) u
  ON u.claim_id = c.claim_id AND u.user_id = c.user_id
""")
def use_claims(shop):
    return changes.use_claims(shop.claims, _paid(shop)) \
        .select("claim_id", "user_id", "coupon_event_id", "is_used", "used_by_order")


def _refunds(shop):
    accepted = changes.refund_requests(shop.orders, shop.refunds)
    return accepted, changes.refund_items(shop.items, accepted, shop.refunds)


@query("M3", sql="""
SELECT order_id, product_id, line_no::BIGINT AS line_no, price::BIGINT AS price,
       CASE WHEN refunded_now THEN 'refunded' ELSE item_status END AS item_status, refunded_now
FROM shop_refunded_items
""")
def refund_items(shop):
    return plain(_refunds(shop)[1], "order_id", "product_id", "line_no", "price", "item_status", "refunded_now")


@query("M3 A25 X8", sql="""
WITH touched AS (SELECT order_id, count(*) FILTER (WHERE refunded_now) AS refunded,
                        count(*) FILTER (WHERE item_status = 'active' AND NOT refunded_now) AS remaining,
                        sum(CASE WHEN refunded_now THEN price ELSE 0 END) AS refund_amount
                 FROM shop_refunded_items GROUP BY order_id)
SELECT o.order_id, o.final_amount::BIGINT AS final_amount,
       CASE WHEN o.status = 'paid' AND (o.payment_method = '1-URGENT' OR (t.refunded > 0 AND t.remaining = 0)) THEN 'refund'
            ELSE o.status END AS status,
       coalesce(t.refund_amount, 0)::BIGINT AS refund_amount,
       ((CAST(coalesce(t.refund_amount, 0) AS BIGINT) * 200 + 1350) // 2700) / 100.0::DOUBLE AS refund_usd
FROM shop_orders o LEFT JOIN touched t ON t.order_id = o.order_id
""")
def refund_orders(shop):
    from ..functions.money import in_usd
    accepted, items = _refunds(shop)
    after = changes.refund_orders(shop.orders, items, accepted)
    return plain(after.withColumn("refund_usd", in_usd(F.col("refund_amount"))),
                 "order_id", "final_amount", "status", "refund_amount", "refund_usd")


@query("M3", sql="""
SELECT d.user_id, d.product_id, d.order_id FROM shop_bought d
WHERE d.order_id NOT IN (SELECT order_id FROM shop_orders WHERE status = 'paid' AND payment_method = '1-URGENT')
UNION ALL
SELECT d.user_id, d.product_id, d.order_id FROM shop_downloads d LEFT JOIN shop_orders o ON o.order_id = d.order_id
WHERE NOT coalesce(o.status = 'paid' AND o.payment_method = '1-URGENT', false)
""")
def revoke_downloads(shop):
    bought = changes.newly_bought(_paid(shop), shop.items)
    rights = bought.unionByName(shop.downloads.select("user_id", "product_id", "order_id"))
    accepted = changes.refund_requests(shop.orders, shop.refunds)
    return changes.revoke_downloads(rights, accepted).select("user_id", "product_id", "order_id")


@query("M4", sql="""
SELECT item_id, count(*)::BIGINT AS likes FROM (
  SELECT item_id, user_id FROM shop_events WHERE event_type = 'click' GROUP BY item_id, user_id HAVING count(*) % 2 = 1)
GROUP BY item_id
""")
def like_counts(shop):
    return changes.like_counts(shop.toggles)


RUNNING = """
sums AS (SELECT *, sum(amount) OVER (PARTITION BY user_id ORDER BY created_at, entry_id) AS s FROM shop_ledger),
lows AS (SELECT *, least(0, min(s) OVER (PARTITION BY user_id ORDER BY created_at, entry_id)) AS low FROM sums)
"""


@query("M5 X20", sql=f"""
WITH {RUNNING}
SELECT user_id, count(*)::BIGINT AS entries, (sum(amount) - min(low))::BIGINT AS balance FROM lows GROUP BY user_id
""")
def point_balances(shop):
    return plain(changes.point_balances(shop.ledger), "user_id", "entries", "balance")


@query("W5 M5", sql=f"""
WITH {RUNNING}
SELECT user_id, entry_id, amount::BIGINT AS amount, CASE WHEN amount > 0 THEN 'admin_add' ELSE 'admin_deduct' END AS type,
       (s - low)::BIGINT AS balance FROM lows
""")
def point_balance_running(shop):
    return plain(changes.running_balances(shop.typed_ledger), "user_id", "entry_id", "amount", "type", "balance")


@query("M5 J9", sql=f"""
SELECT o.user_id, count(*)::BIGINT AS entries, (count(*) * {REVIEW_POINTS})::BIGINT AS points
FROM shop_reviews r JOIN shop_orders o ON o.order_id = r.order_id WHERE o.status = 'paid' GROUP BY o.user_id
""")
def review_rewards(shop):
    reviews = shop.reviews.join(shop.orders.filter(F.col("status") == "paid").select("order_id", "user_id"), "order_id")
    earned = changes.review_rewards(reviews, REVIEW_POINTS)
    return plain(earned.groupBy("user_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("amount").alias("points")))


@query("M6", sql="""
WITH old AS (SELECT user_id, item_id, event_id FROM shop_events WHERE event_type = 'view'),
new AS (SELECT user_id, item_id, event_id FROM shop_events WHERE event_type = 'click')
SELECT user_id, item_id, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY gen DESC, event_id DESC) AS n
  FROM (SELECT *, 0 AS gen FROM old UNION ALL SELECT *, 1 FROM new)) WHERE n = 1
""")
def upsert_latest(shop):
    rows = lambda kind: shop.events_of(kind).select("user_id", "item_id", "event_id")
    return changes.upsert_latest(rows("view"), rows("click"), ["user_id", "item_id"], [F.col("event_id").desc()])


@query("M7", sql="""
WITH old AS (SELECT user_id, product_id, order_id FROM shop_downloads)
SELECT * FROM old
UNION ALL
SELECT user_id, item_id, min(event_id) FROM shop_events e
WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = e.user_id AND old.product_id = e.item_id)
GROUP BY user_id, item_id
""")
def insert_if_absent(shop):
    new = shop.events_of("click").select("user_id", F.col("item_id").alias("product_id"), F.col("event_id").alias("order_id"))
    return changes.insert_if_absent(shop.downloads.select("user_id", "product_id", "order_id"), new,
                                    ["user_id", "product_id"], [F.col("order_id")])


@query("M8", sql="""
WITH links AS (SELECT DISTINCT item_id, user_id FROM shop_events WHERE event_type = 'view'),
new_links AS (SELECT DISTINCT item_id, user_id FROM shop_events WHERE event_type = 'click'),
parents AS (SELECT DISTINCT item_id FROM shop_events WHERE event_type = 'error' AND value > 50)
SELECT item_id, user_id FROM links WHERE item_id NOT IN (SELECT item_id FROM parents)
UNION ALL
SELECT item_id, user_id FROM new_links WHERE item_id IN (SELECT item_id FROM parents)
""")
def replace_children(shop):
    pairs = lambda kind: shop.events_of(kind).select("item_id", "user_id")
    parents = shop.events_of("error").filter(F.col("value") > 50).select("item_id").distinct()
    return changes.replace_children(pairs("view").distinct(), parents, pairs("click"), "item_id")


@query("M9", sql="""
SELECT p.product_id, p.is_active AND NOT EXISTS (
         SELECT 1 FROM shop_events e WHERE e.event_type = 'error' AND e.item_id = p.product_id AND e.value > 100) AS is_active
FROM shop_products p
""")
def soft_delete(shop):
    gone = shop.events_of("error").filter(F.col("value") > 100).select(F.col("item_id").alias("product_id"))
    return changes.soft_delete(shop.products, gone, "product_id").select("product_id", "is_active")


@query("M9", sql="""
SELECT p.product_id, CASE WHEN coalesce(t.n, 0) % 2 = 1 THEN NOT p.is_active ELSE p.is_active END AS is_active
FROM shop_products p
LEFT JOIN (SELECT item_id, count(*) AS n FROM shop_events WHERE event_type = 'view' GROUP BY item_id) t ON t.item_id = p.product_id
""")
def toggle_active(shop):
    toggles = shop.events_of("view").select(F.col("item_id").alias("product_id"))
    return changes.toggle_active(shop.products, toggles, "product_id").select("product_id", "is_active")


@query("M10", sql="""
SELECT p.product_id, coalesce(e.position, p.view_count) AS sort_order
FROM shop_products p
LEFT JOIN (SELECT item_id, arg_max(user_id, event_id) AS position FROM shop_events WHERE event_type = 'click' GROUP BY item_id) e
  ON e.item_id = p.product_id
""")
def bulk_reorder(shop):
    positions = shop.events_of("click").select(F.col("item_id").alias("product_id"), F.col("user_id").alias("position"),
                                               F.col("event_id").alias("seq"))
    listed = shop.products.select("product_id", F.col("view_count").alias("sort_order"))
    return changes.bulk_reorder(listed, positions, "product_id")


@query("M11", sql="""
SELECT p.product_id, (p.view_count + coalesce(e.n, 0))::BIGINT AS view_count, e.last_at
FROM shop_products p
LEFT JOIN (SELECT item_id, count(*) AS n, max(created_at) AS last_at FROM shop_events WHERE event_type = 'view' GROUP BY item_id) e
  ON e.item_id = p.product_id
""")
def add_counters(shop):
    views = shop.events_of("view").select(F.col("item_id").alias("product_id"), "created_at")
    return changes.add_counters(shop.products.select("product_id", "view_count"), views, "product_id", "view_count")


ALLOWED = """
WITH allowed AS (SELECT e.user_id, e.item_id AS product_id, e.created_at FROM shop_events e
                 JOIN shop_downloads d ON d.user_id = e.user_id AND d.product_id = e.item_id WHERE e.event_type = 'view')
"""


def _downloads(shop):
    views = shop.events_of("view").select("user_id", F.col("item_id").alias("product_id"), "created_at")
    return changes.count_downloads(shop.downloads.select("user_id", "product_id", "order_id"),
                                   shop.products.select("product_id", "download_count"), views)


@query("M11", sql=ALLOWED + """
SELECT d.user_id, d.product_id, d.order_id, count(a.created_at)::BIGINT AS download_count, max(a.created_at) AS last_downloaded_at
FROM shop_downloads d LEFT JOIN allowed a ON a.user_id = d.user_id AND a.product_id = d.product_id
GROUP BY d.user_id, d.product_id, d.order_id
""")
def count_downloads_of_rights(shop):
    return _downloads(shop)[0].select("user_id", "product_id", "order_id", "download_count", "last_downloaded_at")


@query("M11", sql=ALLOWED + """
SELECT p.product_id, (coalesce(p.download_count, 0) + count(a.created_at))::BIGINT AS download_count
FROM shop_products p LEFT JOIN allowed a ON a.product_id = p.product_id GROUP BY p.product_id, p.download_count
""")
def count_downloads_of_products(shop):
    return _downloads(shop)[1].select("product_id", "download_count")


@query("M12", sql="""
SELECT u.user_id, l.last_login_at,
       CASE WHEN u.is_active AND l.last_login_at < TIMESTAMP '2000-06-30' THEN true
            WHEN l.last_login_at >= TIMESTAMP '2000-06-30' THEN false ELSE u.is_dormant END AS is_dormant
FROM shop_users u LEFT JOIN (SELECT user_id, max(created_at) AS last_login_at FROM shop_orders
                             WHERE status = 'paid' AND created_at <= TIMESTAMP '2001-06-30' GROUP BY user_id) l
  ON l.user_id = u.user_id
""")
def flag_dormant(shop):
    logins = shop.orders.filter(F.col("status") == "paid").select("user_id", "created_at")
    return changes.flag_dormant(shop.users, logins, ORDERS_AS_OF).select("user_id", "last_login_at", "is_dormant")


ACTION = """CASE event_type WHEN 'error' THEN 'suspend' WHEN 'signup' THEN 'restore'
                     WHEN 'purchase' THEN CASE WHEN value > 300 THEN 'deactivate' ELSE 'buy' END ELSE event_type END"""


def _actions(shop):
    kind = F.col("event_type")
    action = F.when(kind == "error", "suspend").when(kind == "signup", "restore") \
        .when(kind == "purchase", F.when(F.col("value") > 300, "deactivate").otherwise("buy")).otherwise(kind)
    return shop.events.select("user_id", action.alias("action"), "created_at", F.col("event_id").alias("action_id"))


@query("M13", sql=f"""
WITH actions AS (SELECT user_id, {ACTION} AS action, created_at, event_id FROM shop_events),
latest AS (SELECT user_id, arg_max(action, event_id) AS action, max(created_at) AS at FROM actions
           WHERE action IN ('suspend', 'restore') GROUP BY user_id),
off AS (SELECT DISTINCT user_id FROM actions WHERE action = 'deactivate')
SELECT u.user_id, CASE WHEN l.action IS NULL THEN u.is_dormant ELSE l.action = 'suspend' END AS is_dormant,
       CASE WHEN l.action = 'suspend' THEN l.at END AS dormant_at, u.is_active AND o.user_id IS NULL AS is_active
FROM shop_users u LEFT JOIN latest l ON l.user_id = u.user_id LEFT JOIN off o ON o.user_id = u.user_id
""")
def account_actions(shop):
    return changes.account_actions(shop.users, _actions(shop)).select("user_id", "is_dormant", "dormant_at", "is_active")


@query("M13", sql=f"""
SELECT event_id AS action_id, user_id, {ACTION} AS action FROM shop_events
WHERE {ACTION} NOT IN ('suspend', 'restore', 'deactivate')
""")
def rejected_actions(shop):
    return changes.rejected_actions(_actions(shop)).select("action_id", "user_id", "action")


@query("M15", sql="""
SELECT order_id, line_no::BIGINT AS line_no, product_id FROM shop_items
WHERE order_id NOT IN (SELECT order_id FROM shop_orders WHERE status = 'refund')
""")
def cascade_delete(shop):
    gone = shop.orders.filter(F.col("status") == "refund")
    return plain(changes.cascade_delete(shop.items, gone, "order_id"), "order_id", "line_no", "product_id")


@query("M15", sql="""
SELECT o.order_id, CASE WHEN u.is_active THEN o.user_id END AS user_id
FROM shop_orders o JOIN shop_users u ON u.user_id = o.user_id
""")
def set_null_on_delete(shop):
    gone = shop.users.filter(~F.col("is_active"))
    return changes.set_null_on_delete(shop.orders, gone, "user_id").select("order_id", "user_id")
