"""Customer queries."""

from pyspark.sql import functions as F

from ..functions.customer import GradeLimits
from ..operators import customers
from .output import plain
from .registry import query
from .shop import LIMITS, ORDERS_AS_OF

MEASURES = ["user_id", "total_spent", "total_orders", "monthly_amount", "last_purchased_at", "refund_count"]


@query("A9 X19", sql="""
SELECT user_id, total_spent::BIGINT AS total_spent, total_orders::BIGINT AS total_orders,
       monthly_amount::BIGINT AS monthly_amount, last_purchased_at, refund_count::BIGINT AS refund_count
FROM shop_measured
""")
def customer_rfm(shop):
    return plain(customers.customer_rfm(shop.users, shop.orders, ORDERS_AS_OF), *MEASURES)


@query("A10 X1", sql="""
SELECT user_id, total_orders::BIGINT AS total_orders, monthly_amount::BIGINT AS monthly_amount, grade FROM shop_graded
""")
def customer_grades(shop):
    graded = customers.customer_grades(shop.users, shop.orders, ORDERS_AS_OF, LIMITS)
    return plain(graded, "user_id", "total_orders", "monthly_amount", "grade")


@query("A10 X1", sql="""
SELECT user_id, total_orders::BIGINT AS total_orders, monthly_amount::BIGINT AS monthly_amount,
       CASE WHEN total_orders = 0 THEN 'new' WHEN monthly_amount <= 100000 THEN 'sprout'
         WHEN monthly_amount <= 10000000 THEN 'regular' WHEN monthly_amount <= 30000000 THEN 'vip' ELSE 'vvip' END AS grade
FROM shop_measured WHERE is_active
""")
def member_grades(shop):
    graded = customers.customer_grades(shop.users, shop.orders, ORDERS_AS_OF,
                                       GradeLimits(100_000, 10_000_000, 30_000_000), honour_manual=False)
    return plain(graded, "user_id", "total_orders", "monthly_amount", "grade")


@query("X2 X3 X11", sql="""
SELECT user_id, days_since, strftime(last_purchased_at, '%Y.%m.%d') AS last_day,
       CASE WHEN total_orders = 0 THEN 'none' WHEN days_since <= 30 THEN 'safe' WHEN days_since <= 90 THEN 'mid' ELSE 'high' END AS risk,
       CASE WHEN NOT is_active THEN 'inactive' WHEN is_dormant THEN 'dormant' ELSE 'normal' END AS state
FROM (SELECT *, CAST(floor(epoch(TIMESTAMP '2001-06-30' - last_purchased_at) / 86400) AS BIGINT) AS days_since FROM shop_graded)
""")
def customer_rules(shop):
    from ..functions.dates import dotted_day_text
    graded = customers.customer_grades(shop.users, shop.orders, ORDERS_AS_OF, LIMITS)
    return customers.customer_rules(graded, ORDERS_AS_OF).select(
        "user_id", "days_since", dotted_day_text(F.col("last_purchased_at")).alias("last_day"), "risk", "state")


@query("A11", sql="""
SELECT count(*)::BIGINT AS total, (count(*) FILTER (WHERE grade = 'new'))::BIGINT AS new,
       (count(*) FILTER (WHERE grade = 'sprout'))::BIGINT AS sprout, (count(*) FILTER (WHERE grade = 'regular'))::BIGINT AS regular,
       (count(*) FILTER (WHERE grade = 'vip'))::BIGINT AS vip, (count(*) FILTER (WHERE grade = 'vvip'))::BIGINT AS vvip,
       (count(*) FILTER (WHERE grade IN ('sprout', 'regular')))::BIGINT AS mid
FROM shop_graded
""")
def grade_distribution(shop):
    return customers.grade_distribution(customers.customer_grades(shop.users, shop.orders, ORDERS_AS_OF, LIMITS))


@query("A12", sql="""
SELECT count(*)::BIGINT AS total,
       (count(*) FILTER (WHERE first_purchased_at >= TIMESTAMP '2001-06-01' AND first_purchased_at < TIMESTAMP '2001-07-01'))::BIGINT
         AS new_this_month,
       (count(*) FILTER (WHERE grade IN ('vip', 'vvip')))::BIGINT AS vip_plus,
       (count(*) FILTER (WHERE epoch(TIMESTAMP '2001-06-30' - last_purchased_at) < 31 * 86400))::BIGINT AS active_30d,
       (count(*) FILTER (WHERE epoch(TIMESTAMP '2001-06-30' - last_purchased_at) >= 91 * 86400))::BIGINT AS churn_90d
FROM shop_graded
""")
def customer_kpis(shop):
    return customers.customer_kpis(customers.customer_grades(shop.users, shop.orders, ORDERS_AS_OF, LIMITS), ORDERS_AS_OF)


@query("W1", sql="""
SELECT user_id, order_id, created_at, position FROM (
  SELECT user_id, order_id, created_at,
         row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, order_id DESC)::BIGINT AS position FROM shop_orders)
WHERE position <= 30
""")
def latest_orders_per_user(shop):
    return plain(customers.latest_orders(shop.orders), "user_id", "order_id", "created_at", "position")


@query("W2", sql="""
SELECT user_id, entry_id, amount::BIGINT AS amount, position FROM (
  SELECT user_id, entry_id, amount,
         row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, entry_id DESC)::BIGINT AS position FROM shop_ledger)
WHERE position <= 30
""")
def latest_points_per_user(shop):
    return plain(customers.latest_points(shop.ledger), "user_id", "entry_id", "amount", "position")


@query("A27 W1 W2 J7 J4", sql="""
WITH recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, order_id DESC) AS n
                               FROM shop_orders) WHERE n <= 30),
first_item AS (SELECT order_id, name FROM (
  SELECT i.order_id, p.name, row_number() OVER (PARTITION BY i.order_id ORDER BY i.line_no, i.product_id) AS n
  FROM shop_items i JOIN shop_products p USING (product_id)) WHERE n = 1),
order_lists AS (SELECT r.user_id, count(*) AS orders, string_agg(f.name, '|' ORDER BY r.n) AS first_products
                FROM recent r LEFT JOIN first_item f USING (order_id) GROUP BY r.user_id),
counts AS (SELECT r.user_id, count(*) AS listed_items FROM recent r JOIN shop_items i USING (order_id) GROUP BY r.user_id),
points AS (SELECT user_id, least(count(*), 30) AS points FROM shop_ledger GROUP BY user_id),
reviews AS (SELECT o.user_id, count(*) AS reviews, sum(r.rating) AS stars
            FROM shop_reviews r JOIN shop_orders o USING (order_id) GROUP BY o.user_id),
notes AS (SELECT user_id, count(*) AS notes FROM shop_events WHERE event_type = 'view' GROUP BY user_id),
coupons AS (SELECT user_id, count(*) AS coupons FROM shop_claims GROUP BY user_id)
SELECT g.user_id, g.grade, g.total_spent::BIGINT AS total_spent, coalesce(ol.orders, 0)::BIGINT AS orders,
       coalesce(ol.first_products, '') AS first_products, coalesce(c.listed_items, 0)::BIGINT AS listed_items,
       coalesce(p.points, 0)::BIGINT AS points, coalesce(r.reviews, 0)::BIGINT AS reviews, coalesce(r.stars, 0)::BIGINT AS stars,
       coalesce(n.notes, 0)::BIGINT AS notes, coalesce(k.coupons, 0)::BIGINT AS coupons
FROM shop_graded g LEFT JOIN order_lists ol USING (user_id) LEFT JOIN counts c USING (user_id) LEFT JOIN points p USING (user_id)
LEFT JOIN reviews r USING (user_id) LEFT JOIN notes n USING (user_id) LEFT JOIN coupons k USING (user_id)
""")
def customer_360(shop):
    notes = shop.events_of("view").select("user_id", "created_at", F.col("event_id").alias("note_id"),
                                          F.col("item_id").cast("string").alias("content"))
    full = customers.customer_360(shop.users, shop.orders, shop.items, shop.products, shop.user_reviews,
                                  shop.typed_ledger, notes, shop.claims, ORDERS_AS_OF, LIMITS)

    def listed(name):
        return F.coalesce(F.size(name), F.lit(0)).cast("bigint").alias(name)

    def entries(name):
        return F.count_if(F.col("section") == name).alias(name)

    counted = F.aggregate("orders.item_count", F.lit(0).cast("bigint"), lambda a, b: a + b)
    rows = full.select("user_id", "section", "grade", "total_spent", listed("orders"),
                       F.array_join("orders.first_product", "|").alias("first_products"), counted.alias("listed_items"),
                       listed("points"), F.col("reviews.rating").cast("bigint").alias("stars"))
    zero = F.lit(0).cast("bigint")
    return plain(rows.groupBy("user_id").agg(
        F.max("grade").alias("grade"), F.max("total_spent").alias("total_spent"), F.max("orders").alias("orders"),
        F.coalesce(F.max("first_products"), F.lit("")).alias("first_products"),
        F.coalesce(F.max("listed_items"), zero).alias("listed_items"), F.max("points").alias("points"),
        entries("reviews"), F.coalesce(F.sum("stars"), zero).alias("stars"), entries("notes"), entries("coupons")))
