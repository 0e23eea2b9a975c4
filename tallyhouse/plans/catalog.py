"""Catalog queries."""

from pyspark.sql import functions as F

from ..operators import catalog, joins
from .joins import STATS
from .output import plain
from .registry import query


@query("A7", sql="""
SELECT o.order_id, coalesce(i.line_no // 1000, 0)::BIGINT AS page_no,
       string_agg(p.name, ', ' ORDER BY i.line_no, i.product_id, p.name) AS product_names
FROM shop_orders o JOIN shop_users u ON u.user_id = o.user_id
LEFT JOIN (shop_items i JOIN shop_products p ON p.product_id = i.product_id) ON i.order_id = o.order_id
GROUP BY ALL
""")
def order_product_names(shop):
    return joins.order_list(shop.orders, shop.users, shop.items, shop.products) \
        .select("order_id", "page_no", "product_names")


@query("A17 J5", sql=f"WITH {STATS} SELECT product_id, view_count, purchase_count::BIGINT AS purchase_count FROM stats")
def product_stats(shop):
    return catalog.product_stats(shop.products, shop.items, shop.orders)


@query("A18", sql="""
SELECT p.product_id, count(r.rating)::BIGINT AS total,
       CASE WHEN count(r.rating) = 0 THEN '0.0'
            WHEN sum(r.rating) * 4 % count(r.rating) = 0 AND (sum(r.rating) * 4 // count(r.rating)) % 2 = 1
              THEN printf('%.1f', sum(r.rating) / count(r.rating) + 0.001)
            ELSE printf('%.1f', sum(r.rating) / count(r.rating)) END AS average,
       (count(*) FILTER (WHERE r.rating = 1))::BIGINT AS stars_1, (count(*) FILTER (WHERE r.rating = 2))::BIGINT AS stars_2,
       (count(*) FILTER (WHERE r.rating = 3))::BIGINT AS stars_3, (count(*) FILTER (WHERE r.rating = 4))::BIGINT AS stars_4,
       (count(*) FILTER (WHERE r.rating = 5))::BIGINT AS stars_5
FROM shop_products p LEFT JOIN shop_reviews r ON r.product_id = p.product_id GROUP BY p.product_id
""")
def review_summary(shop):
    return catalog.review_summary(shop.products, shop.reviews)


@query("A19", sql="""
SELECT order_id AS cart_id, count(*)::BIGINT AS item_count, sum(price)::BIGINT AS total,
       (count(*) FILTER (WHERE line_status = 'O'))::BIGINT AS checked_count,
       coalesce(sum(price) FILTER (WHERE line_status = 'O'), 0)::BIGINT AS checked_total
FROM shop_items GROUP BY order_id
""")
def cart_totals(shop):
    cart = shop.items.select(F.col("order_id").alias("cart_id"), "price", (F.col("line_status") == "O").alias("checked"))
    return plain(catalog.cart_totals(cart, "cart_id"))


@query("A20", sql="""
SELECT u.user_id, o.order_id FROM shop_users u LEFT JOIN shop_orders o ON o.user_id = u.user_id AND o.status = 'refund'
""")
def linked_ids(shop):
    links = shop.orders.filter(F.col("status") == "refund").select("user_id", "order_id")
    return catalog.linked_ids(shop.users.select("user_id"), links, "user_id", "order_id")


@query("A21 X22", sql="""
SELECT o.order_id, (i.line_no // 1000)::BIGINT AS page_no, '[' || string_agg('{"line_no":' || i.line_no || ',"product_id":' || i.product_id || ',"name":"'
         || p.name || '","price":' || i.price || ',"category":"' || p.category || '"}', ','
         ORDER BY i.line_no, i.product_id, p.name, i.price) || ']' AS items
FROM shop_orders o JOIN shop_items i ON i.order_id = o.order_id JOIN shop_products p ON p.product_id = i.product_id
GROUP BY ALL
""")
def orders_with_items_json(shop):
    nested = catalog.orders_with_items(shop.orders.select("order_id"), shop.items, shop.products)
    return nested.select("order_id", "page_no", catalog.items_json().alias("items"))


@query("A22", sql="""
SELECT (count(*) FILTER (WHERE NOT answered))::BIGINT AS unanswered, (count(*) FILTER (WHERE answered))::BIGINT AS answered,
       count(*)::BIGINT AS total FROM shop_inquiries
""")
def inquiry_summary(shop):
    return catalog.inquiry_summary(shop.inquiries)


@query("A23 F7", sql="SELECT category, count(*)::BIGINT AS n FROM shop_products WHERE is_active GROUP BY category")
def category_counts(shop):
    return catalog.category_counts(shop.products)


@query("A23 W3", sql="""
SELECT category, product_id, name, position FROM (
  SELECT category, product_id, name, row_number() OVER (PARTITION BY category ORDER BY product_id)::BIGINT AS position
  FROM shop_products WHERE is_active) WHERE position <= 4
""")
def category_preview(shop):
    return plain(catalog.category_preview(shop.products), "category", "product_id", "name", "position")


@query("A24 M6", sql="""
WITH latest AS (SELECT user_id, event_type AS key, arg_max(item_id, event_id) AS value FROM shop_events GROUP BY user_id, event_type)
SELECT user_id, '{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) || '}' AS settings
FROM latest GROUP BY user_id
""")
def settings_map(shop):
    settings = shop.events.select("user_id", F.col("event_type").alias("key"),
                                  F.col("item_id").cast("string").alias("value"), F.col("event_id").alias("updated_at"))
    return catalog.settings_map(settings, ["user_id"]).select("user_id", F.to_json("settings").alias("settings"))


@query("A25", sql="""
SELECT o.order_id, o.status, CASE WHEN count(i.order_id) > 0 THEN count(*) FILTER (WHERE i.item_status = 'active') END::BIGINT AS remaining,
       CASE WHEN count(i.order_id) > 0 AND count(*) FILTER (WHERE i.item_status = 'active') = 0 THEN 'refund' ELSE o.status END AS new_status
FROM shop_orders o LEFT JOIN shop_items i ON i.order_id = o.order_id GROUP BY o.order_id, o.status
""")
def state_after_refund(shop):
    return catalog.state_after_refund(shop.orders, shop.items) \
        .select("order_id", "status", "remaining", "new_status")


@query("S7 J13 X4 X5 X19", sql=f"""
WITH {STATS}
SELECT p.product_id, p.name, p.category AS cat, p.price::BIGINT AS price, coalesce(p.discount_price, 0)::BIGINT AS discount,
       CASE WHEN coalesce(p.sale_type, '') = '' THEN 'file' ELSE p.sale_type END AS type, p.description AS desc,
       CASE WHEN p.price = 0 THEN NULL ELSE coalesce(nullif(p.discount_price, 0), p.price) END::BIGINT AS shown_price,
       CASE WHEN p.new_badge THEN 'NEW' WHEN p.best_badge THEN 'BEST' ELSE 'ON SALE' END AS badge,
       s.view_count AS views, s.purchase_count::BIGINT AS downloads
FROM shop_products p JOIN stats s ON s.product_id = p.product_id WHERE p.is_active
""")
def catalog_view(shop):
    stats = catalog.product_stats(shop.products, shop.items, shop.orders)
    return plain(catalog.catalog_view(shop.products, stats))
