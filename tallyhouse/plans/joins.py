"""Join queries."""

from pyspark.sql import functions as F

from ..operators import catalog, joins
from .output import plain
from .registry import query


@query("J1 J4", sql="""
SELECT o.order_id, o.final_amount::BIGINT AS final_amount, o.status, o.created_at, u.email AS buyer_email, u.name AS buyer_name,
       (SELECT p.name FROM shop_items i JOIN shop_products p ON p.product_id = i.product_id WHERE i.order_id = o.order_id
        ORDER BY i.line_no, i.product_id LIMIT 1) AS first_product
FROM shop_orders o JOIN shop_users u ON u.user_id = o.user_id
ORDER BY o.created_at DESC, o.order_id DESC LIMIT 5
""")
def recent_orders(shop):
    found = joins.recent_orders(shop.orders, shop.users, shop.items, shop.products)
    return plain(found, "order_id", "final_amount", "status", "created_at", "buyer_email", "buyer_name", "first_product")


@query("J2", sql="""
SELECT i.order_id, i.line_no::BIGINT AS line_no, i.product_id, i.price::BIGINT AS price, i.item_status, p.name, p.category
FROM shop_items i JOIN shop_products p ON p.product_id = i.product_id
""")
def order_items_detail(shop):
    found = joins.order_items_detail(shop.items, shop.products, ["name", "category"])
    return plain(found, "order_id", "line_no", "product_id", "price", "item_status", "name", "category")


@query("J3", sql="""
SELECT o.order_id, o.status, i.line_no::BIGINT AS line_no, i.product_id
FROM shop_orders o LEFT JOIN shop_items i ON i.order_id = o.order_id
""")
def orders_with_optional_items(shop):
    found = joins.orders_with_items(shop.orders.select("order_id", "status"),
                                    shop.items.select("order_id", "line_no", "product_id"))
    return plain(found, "order_id", "status", "line_no", "product_id")


@query("J4", sql="""
SELECT order_id, name AS first_product FROM (
  SELECT i.order_id, p.name, row_number() OVER (PARTITION BY i.order_id ORDER BY i.line_no, i.product_id, p.name) AS n
  FROM shop_items i JOIN shop_products p ON p.product_id = i.product_id) WHERE n = 1
""")
def first_item_per_order(shop):
    return joins.first_item_per_order(shop.items, shop.products)


@query("J5", sql="""
SELECT i.order_id, i.line_no::BIGINT AS line_no, i.product_id, o.user_id, o.paid_at
FROM shop_items i LEFT JOIN shop_orders o ON o.order_id = i.order_id AND o.status = 'paid'
""")
def items_with_paid_order(shop):
    found = joins.left_with_filtered_right(
        shop.items.select("order_id", "line_no", "product_id"),
        shop.orders.select("order_id", "user_id", "paid_at", "status"), ["order_id"], F.col("status") == "paid")
    return plain(found, "order_id", "line_no", "product_id", "user_id", "paid_at")


@query("J6", sql="""
SELECT i.order_id, i.line_no::BIGINT AS line_no, i.product_id, i.price::BIGINT AS price, i.item_status, o.status, o.paid_at, p.name
FROM shop_items i JOIN shop_products p ON p.product_id = i.product_id JOIN shop_orders o ON o.order_id = i.order_id
""")
def settlement_lines(shop):
    found = joins.settlement_lines(shop.items, shop.orders, shop.products)
    return plain(found, "order_id", "line_no", "product_id", "price", "item_status", "status", "paid_at", "name")


@query("J7", sql="""
SELECT o.user_id, r.order_id, r.product_id, r.rating::BIGINT AS rating, r.created_at, p.name
FROM shop_reviews r JOIN shop_orders o ON o.order_id = r.order_id JOIN shop_products p ON p.product_id = r.product_id
""")
def reviews_by_user(shop):
    found = joins.child_list(shop.user_reviews, shop.products, "product_id", ["name"],
                             [F.col("user_id"), F.col("created_at").desc(), F.col("review_id")])
    return plain(found, "user_id", "order_id", "product_id", "rating", "created_at", "name")


@query("J7", sql="""
SELECT d.user_id, d.product_id, d.created_at, p.name, p.category
FROM shop_downloads d JOIN shop_products p ON p.product_id = d.product_id
""")
def downloads_by_user(shop):
    return joins.child_list(shop.downloads, shop.products, "product_id", ["name", "category"],
                            [F.col("user_id"), F.col("created_at").desc(), F.col("product_id")]) \
        .select("user_id", "product_id", "created_at", "name", "category")


@query("J8", sql="""
SELECT request_id, claim_id, coupon_event_id, discount_type, discount_value::DOUBLE AS discount_value FROM shop_offers
""")
def coupon_for_order(shop):
    found = joins.coupon_for_order(shop.requests, shop.claims, shop.coupon_events)
    return plain(found, "request_id", "claim_id", "coupon_event_id", "discount_type", "discount_value")


@query("J9", sql="""
SELECT event_id, user_id, item_id AS product_id FROM shop_events v
WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM shop_downloads d WHERE d.user_id = v.user_id AND d.product_id = v.item_id)
""")
def verified_only(shop):
    views = shop.events_of("view").select("event_id", "user_id", F.col("item_id").alias("product_id"))
    return joins.verified_only(views, shop.downloads).select("event_id", "user_id", "product_id")


@query("J10", sql="""
SELECT event_id, user_id, item_id AS product_id FROM shop_events v
WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM shop_downloads d WHERE d.user_id = v.user_id AND d.product_id = v.item_id)
""")
def not_yet_owned(shop):
    views = shop.events_of("view").select("event_id", "user_id", F.col("item_id").alias("product_id"))
    return joins.not_yet_owned(views, shop.downloads).select("event_id", "user_id", "product_id")


# Profiles: every sign-up event signs in through one of two providers.  Cheap
# events come with the account's e-mail, dear ones with none, the rest with a
# new address per item.
PROFILES = """
profiles AS (
  SELECT min(event_id) AS profile_no, provider, provider_id, min(email) AS email FROM (
    SELECT e.event_id, u.provider, CASE WHEN e.value < 20 THEN CAST(e.user_id AS VARCHAR) ELSE 'x' || e.event_id END AS provider_id,
           CASE WHEN e.value < 100 THEN u.email WHEN e.value < 200 THEN 'new' || e.item_id || '@shop.example' END AS email
    FROM shop_events e JOIN shop_users u ON u.user_id = e.user_id WHERE e.event_type = 'signup')
  GROUP BY provider, provider_id)
"""


@query("J11 X18", sql=f"""
WITH {PROFILES},
found AS (
  SELECT f.*, a.user_id AS by_id, b.user_id AS by_email, b.provider_id AS known_id,
         row_number() OVER (PARTITION BY a.user_id IS NULL, f.email ORDER BY f.profile_no) AS n
  FROM profiles f LEFT JOIN shop_users a ON a.provider = f.provider AND a.provider_id = f.provider_id
  LEFT JOIN shop_users b ON b.email = f.email)
SELECT profile_no, provider, provider_id, coalesce(by_id, by_email) AS user_id,
       coalesce(email, provider || '_' || provider_id || '@shop.invalid') AS email,
       CASE WHEN by_id IS NOT NULL THEN 'match'
            WHEN by_email IS NOT NULL THEN CASE WHEN known_id IS NULL AND n = 1 THEN 'link' ELSE 'match' END
            WHEN email IS NULL OR n = 1 THEN 'create' ELSE 'join' END AS action
FROM found
""")
def link_identities(shop):
    named = shop.events_of("signup").join(shop.users.select("user_id", "provider", "email"), "user_id")
    value = F.col("value")
    profiles = named.select(
        "event_id", "provider",
        F.when(value < 20, F.col("user_id").cast("string")).otherwise(F.concat(F.lit("x"), "event_id")).alias("provider_id"),
        F.when(value < 100, F.col("email"))
        .when(value < 200, F.concat(F.lit("new"), "item_id", F.lit("@shop.example"))).alias("email")) \
        .groupBy("provider", "provider_id").agg(F.min("event_id").alias("profile_no"), F.min("email").alias("email"))
    return joins.link_identities(profiles, shop.users)


@query("J12", sql="""
WITH fed AS (SELECT order_id, count(*) AS payments, count(*) FILTER (WHERE payment_status = 'PAID') AS paid_payments,
                    min(amount) FILTER (WHERE payment_status = 'PAID') AS low, max(amount) FILTER (WHERE payment_status = 'PAID') AS high
             FROM shop_payments GROUP BY order_id)
SELECT coalesce(o.order_id, f.order_id) AS order_id, f.payments::BIGINT AS payments,
       CASE WHEN o.order_id IS NULL THEN 'missing_order' WHEN f.order_id IS NULL THEN 'missing_payment'
            WHEN f.paid_payments = 0 THEN 'unpaid'
            WHEN f.low <> o.final_amount OR f.high <> o.final_amount THEN 'mismatch'
            WHEN f.paid_payments > 1 THEN 'duplicate' ELSE 'ok' END AS result
FROM shop_orders o FULL JOIN fed f ON f.order_id = o.order_id
""")
def reconcile_payments(shop):
    return joins.reconcile_payments(shop.orders, shop.payments).select("order_id", "payments", "result")


STATS = """
stats AS (SELECT p.product_id, p.view_count, count(DISTINCT o.order_id) AS purchase_count
          FROM shop_products p LEFT JOIN shop_items i ON i.product_id = p.product_id
          LEFT JOIN shop_orders o ON o.order_id = i.order_id AND o.status = 'paid'
          WHERE p.is_active GROUP BY p.product_id, p.view_count)
"""


@query("J13 X19", sql=f"""
WITH {STATS}
SELECT p.product_id, coalesce(s.view_count, p.view_count, 0)::BIGINT AS views,
       coalesce(s.purchase_count, p.download_count, 0)::BIGINT AS downloads
FROM shop_products p LEFT JOIN stats s ON s.product_id = p.product_id
""")
def attach_stats(shop):
    stats = catalog.product_stats(shop.products, shop.items, shop.orders)
    return joins.attach_stats(shop.products, stats).select("product_id", "views", "downloads")


@query("J14", sql="""
SELECT p.product_id, p.category, coalesce(l.label, p.category) AS label
FROM shop_products p LEFT JOIN shop_category_labels l ON l.code = p.category
""")
def attach_label(shop):
    return joins.attach_label(shop.products, shop.category_labels, "category").select("product_id", "category", "label")
