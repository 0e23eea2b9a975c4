"""Selection and ordering queries."""

from pyspark.sql import functions as F

from ..operators import customers, filters, joins, ordering
from ..functions import text
from .output import plain
from .registry import query
from .shop import EVENTS_AS_OF, LIMITS, ORDERS_AS_OF


@query("F1", sql="""
SELECT order_id, user_id, status, final_amount::BIGINT AS final_amount, payment_method, created_at
FROM shop_orders WHERE status = 'paid' AND payment_method = '1-URGENT'
  AND created_at >= TIMESTAMP '1999-01-01' AND created_at < TIMESTAMP '2000-07-01'
""")
def orders_filtered(shop):
    found = filters.filter_orders(shop.orders, status="paid", payment_method="1-URGENT",
                                  date_from="1999-01-01", date_to="2000-06-30")
    return plain(found, "order_id", "user_id", "status", "final_amount", "payment_method", "created_at")


@query("F1 F2 A7 J3", sql="""
SELECT o.order_id, o.status, o.final_amount::BIGINT AS final_amount, o.payment_method, o.created_at, u.name AS buyer_name,
       u.email AS buyer_email, coalesce(i.line_no // 1000, 0)::BIGINT AS page_no,
       string_agg(p.name, ', ' ORDER BY i.line_no, i.product_id, p.name) AS product_names
FROM shop_orders o JOIN shop_users u ON u.user_id = o.user_id
LEFT JOIN (shop_items i JOIN shop_products p ON p.product_id = i.product_id) ON i.order_id = o.order_id
WHERE o.status = 'paid' AND (u.name ILIKE '%r_d g%' OR u.email ILIKE '%r_d g%' OR p.name ILIKE '%r_d g%')
GROUP BY ALL
""")
def order_list_by_product_search(shop):
    found = joins.order_list(shop.orders, shop.users, shop.items, shop.products, search="r_d g", status="paid")
    return plain(found, "order_id", "status", "final_amount", "payment_method", "created_at", "buyer_name",
                 "buyer_email", "page_no", "product_names")


@query("F2", sql="""
SELECT user_id, name, email FROM shop_users WHERE name ILIKE '%0_00%' OR email ILIKE '%0_00%'
""")
def users_search_wild(shop):
    return filters.search_wild(shop.users, ["name", "email"], "0_00").select("user_id", "name", "email")


@query("F3 J14", sql="""
SELECT p.product_id, p.name, coalesce(l.label, p.category) AS label
FROM shop_products p LEFT JOIN shop_category_labels l ON l.code = p.category
WHERE p.is_active AND (contains(lower(p.name), 'ring') OR contains(lower(p.description), 'ring')
  OR contains(lower(coalesce(l.label, '')), 'ring') OR contains(lower(p.category), 'ring')
  OR contains(lower(coalesce(l.label, '')), 'econ'))
""")
def catalog_keyword_search(shop):
    labelled = joins.attach_label(filters.active_only(shop.products), shop.category_labels, "category")
    columns = ["name", "description", "label", "category"]
    return labelled.filter(filters.matches_keyword(columns, " Ring ") | filters.matches_keyword(["label"], "ECON")) \
        .select("product_id", "name", "label")


@query("F3 X15", sql="""
SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the of')
""")
def document_keyword_search(shop):
    return filters.search_keyword(shop.table("documents"), ["text"], "The Of").select("doc_id", "lang")


@query("F4", sql="SELECT product_id, name FROM shop_products WHERE contains(lower(name), 'old r')")
def catalog_name_filter(shop):
    return filters.name_contains(shop.products, "  Old R").select("product_id", "name")


@query("F5", sql="SELECT product_id, name, price::BIGINT AS price FROM shop_products WHERE price = 91250")
def catalog_price_filter(shop):
    return plain(filters.with_price(shop.products, "91250"), "product_id", "name", "price")


@query("F6 F7", sql="""
SELECT product_id, name, category, price::BIGINT AS price FROM shop_products WHERE is_active AND category = 'PROMO'
""")
def category_products(shop):
    return plain(filters.in_category(shop.products, "PROMO"), "product_id", "name", "category", "price")


@query("F7", sql="SELECT user_id, name FROM shop_users WHERE is_active")
def active_users(shop):
    return filters.active_only(shop.users).select("user_id", "name")


@query("F8 J7", sql="""
SELECT c.claim_id, c.user_id, e.coupon_event_id, e.name FROM shop_claims c JOIN shop_coupon_events e USING (coupon_event_id)
WHERE DATE '2024-01-15' BETWEEN e.start_date AND e.end_date
""")
def claims_of_running_events(shop):
    running = filters.running_on(shop.coupon_events, "2024-01-15").select("coupon_event_id", "name")
    return shop.claims.join(running, "coupon_event_id").select("claim_id", "user_id", "coupon_event_id", "name")


@query("F9 J7", sql="""
WITH coupons AS (SELECT coupon_event_id AS coupon_id, name,
                        CASE WHEN discount_type <> 'fixed' THEN CAST(end_date AS TIMESTAMP) END AS expires_at FROM shop_coupon_events)
SELECT c.claim_id AS user_coupon_id, c.user_id, k.coupon_id, k.name, k.expires_at
FROM shop_claims c JOIN coupons k ON k.coupon_id = c.coupon_event_id
WHERE NOT c.is_used AND (k.expires_at IS NULL OR k.expires_at > TIMESTAMP '2024-01-18')
""")
def usable_coupons(shop):
    coupons = shop.coupon_events.select(
        F.col("coupon_event_id").alias("coupon_id"), "name",
        F.when(F.col("discount_type") != "fixed", F.col("end_date").cast("timestamp_ntz")).alias("expires_at"))
    held = shop.claims.select(F.col("claim_id").alias("user_coupon_id"), "user_id",
                              F.col("coupon_event_id").alias("coupon_id"), "is_used")
    return filters.usable_coupons(held, coupons, "2024-01-18") \
        .select("user_coupon_id", "user_id", "coupon_id", "name", "expires_at")


CLAIMED = """
SELECT c.claim_id, c.user_id, c.coupon_event_id, c.is_used, c.created_at, e.name, CAST(e.end_date AS VARCHAR) AS end_date
FROM shop_claims c JOIN shop_coupon_events e USING (coupon_event_id)
"""


@query("F10", sql=CLAIMED + "WHERE NOT c.is_used AND e.end_date >= DATE '2024-01-31'")
def claimed_coupons(shop):
    found = filters.claimed_coupons(shop.claims, shop.coupon_events, EVENTS_AS_OF)
    return plain(found, "claim_id", "user_id", "coupon_event_id", "is_used", "created_at", "name", "end_date")


@query("F10", sql=CLAIMED)
def claimed_coupons_with_used(shop):
    found = filters.claimed_coupons(shop.claims, shop.coupon_events, EVENTS_AS_OF, show_all=True)
    return plain(found, "claim_id", "user_id", "coupon_event_id", "is_used", "created_at", "name", "end_date")


@query("F11", sql="""
SELECT user_id, name, grade, total_orders::BIGINT AS total_orders FROM shop_graded
WHERE (contains(lower(name), 'furniture') OR contains(lower(email), 'furniture')) AND total_orders > 0
  AND last_purchased_at < TIMESTAMP '2001-06-30' - INTERVAL 90 DAY
  AND floor(epoch(TIMESTAMP '2001-06-30' - last_purchased_at) / 86400) > 90
""")
def customers_at_risk(shop):
    graded = customers.customer_grades(shop.users, shop.orders, ORDERS_AS_OF, LIMITS)
    return filters.customer_segment(graded, "Furniture", "churn", ORDERS_AS_OF) \
        .select("user_id", "name", "grade", "total_orders")


@query("F11", sql="SELECT user_id, name, grade FROM shop_graded WHERE grade = 'vip'")
def customers_of_grade(shop):
    graded = customers.customer_grades(shop.users, shop.orders, ORDERS_AS_OF, LIMITS)
    return filters.customer_segment(graded, segment="vip").select("user_id", "name", "grade")


@query("F12", sql="SELECT inquiry_id, type, turns::BIGINT AS turns FROM shop_inquiries WHERE NOT answered")
def inquiries_unanswered(shop):
    return filters.inquiries_of(shop.inquiries, "unanswered").select("inquiry_id", "type", "turns")


@query("F12 J14", sql="""
SELECT inquiry_id, answered, '사용 방법' AS label FROM shop_inquiries WHERE type = 'usage'
""")
def inquiries_of_type(shop):
    from ..functions.fixed_values import INQUIRY_LABELS
    return filters.inquiries_of(shop.inquiries, "usage") \
        .select("inquiry_id", "answered", text.label_of(F.col("type"), INQUIRY_LABELS).alias("label"))


@query("F13", sql="SELECT order_id, status FROM shop_orders WHERE status IN ('paid', 'sent', 'resend')")
def refundable_orders(shop):
    return filters.status_in(shop.orders, ["paid", "sent", "resend"]).select("order_id", "status")


@query("F14", sql="""
SELECT i.order_id AS request_id, count(*)::BIGINT AS asked, count(DISTINCT p.product_id)::BIGINT AS found,
       count(*) = count(DISTINCT p.product_id) AS complete
FROM shop_items i LEFT JOIN shop_products p ON p.product_id = i.product_id AND p.is_active GROUP BY i.order_id
""")
def request_completeness(shop):
    return filters.request_completeness(shop.request_lines, shop.products)


def _sorted_products(order):
    return f"SELECT product_id, name, price::BIGINT AS price, created_at FROM shop_products WHERE is_active ORDER BY {order}, product_id"


def _sorted(shop, mode):
    found = ordering.sort_products(filters.active_only(shop.products), mode)
    return plain(found, "product_id", "name", "price", "created_at")


@query("T1 T6", sql=_sorted_products("price ASC"))
def products_cheapest(shop):
    return _sorted(shop, "price_asc")


@query("T1 T6", sql=_sorted_products("price DESC"))
def products_dearest(shop):
    return _sorted(shop, "price_desc")


@query("T1 T6", sql=_sorted_products("download_count DESC NULLS LAST"))
def products_popular(shop):
    return _sorted(shop, "popular")


@query("T1 T6", sql=_sorted_products("created_at DESC"))
def products_newest(shop):
    return _sorted(shop, "no such order")


@query("T2", sql="""
SELECT product_id, rating::BIGINT AS rating, likes_count, created_at FROM shop_reviews
ORDER BY likes_count DESC, created_at DESC, product_id, rating
""")
def reviews_popular(shop):
    # The review key of the test table is a hash, so the tie-breaker here is the product.
    reviews = shop.reviews.withColumn("review_id", F.struct("product_id", "rating"))
    return plain(ordering.sort_reviews(reviews, "popular"), "product_id", "rating", "likes_count", "created_at")


@query("T2", sql="""
SELECT product_id, rating::BIGINT AS rating, likes_count, created_at FROM shop_reviews
ORDER BY rating DESC, created_at DESC, product_id, rating, likes_count
""")
def reviews_best(shop):
    reviews = shop.reviews.withColumn("review_id", F.struct("product_id", "rating", "likes_count"))
    return plain(ordering.sort_reviews(reviews, "rating"), "product_id", "rating", "likes_count", "created_at")


@query("T3", sql="""
SELECT product_id, row_number() OVER (PARTITION BY category ORDER BY price DESC, product_id)::BIGINT AS position
FROM shop_products ORDER BY price DESC, product_id
""")
def shown_products_by_price(shop):
    from pyspark.sql import Window
    first = ordering.sort_by_price(shop.products, "price-desc")
    w = Window.partitionBy("category").orderBy(F.col("price").desc(), F.col("product_id"))
    return plain(first.withColumn("position", F.row_number().over(w)), "product_id", "position")


@query("T4", sql="""
SELECT product_id, view_count AS sort_order, created_at FROM shop_products WHERE is_active
ORDER BY view_count, created_at DESC, product_id
""")
def manual_order(shop):
    listed = filters.active_only(shop.products).withColumn("sort_order", F.col("view_count"))
    return ordering.manual_order(listed, "product_id", newest_first=True) \
        .select("product_id", "sort_order", "created_at")


@query("T5 T7", sql="""
SELECT order_id, status, final_amount::BIGINT AS final_amount, created_at FROM shop_orders
ORDER BY created_at DESC, order_id DESC LIMIT 50 OFFSET 100
""")
def order_page(shop):
    newest = [F.col("created_at").desc(), F.col("order_id").desc()]
    return plain(ordering.page(shop.orders, newest, number=3), "order_id", "status", "final_amount", "created_at")


@query("T5", sql="""
SELECT order_id, status, created_at FROM shop_orders
WHERE created_at < TIMESTAMP '1998-05-05' OR (created_at = TIMESTAMP '1998-05-05' AND order_id < 700)
ORDER BY created_at DESC, order_id DESC LIMIT 50
""")
def order_page_after(shop):
    return ordering.page_after(shop.orders, "1998-05-05", 700).select("order_id", "status", "created_at")


@query("T7", sql="SELECT order_id, user_id, created_at FROM shop_orders ORDER BY created_at DESC, order_id DESC")
def orders_newest_first(shop):
    return ordering.newest_first(shop.orders, "order_id").select("order_id", "user_id", "created_at")
