"""Coupon and order-pricing queries."""

from pyspark.sql import functions as F

from ..operators import coupons
from .output import plain
from .registry import query

# Percent of an amount rounded down, in whole numbers, so no binary fraction enters.
DISCOUNT = """CASE WHEN discount_type = 'percent'
    THEN (CAST({total} AS BIGINT) * CAST(discount_value * 100 AS BIGINT)) // 10000
    ELSE least(CAST(discount_value AS BIGINT), CAST({total} AS BIGINT)) END"""


@query("M1 F14 J8 X6 X7 X10", sql=f"""
WITH lines AS (
  SELECT i.order_id AS request_id, count(*) AS asked, count(DISTINCT p.product_id) AS found
  FROM shop_items i LEFT JOIN shop_products p ON p.product_id = i.product_id AND p.is_active GROUP BY i.order_id),
totals AS (
  SELECT request_id, sum(price) AS total, list(DISTINCT category) AS cats FROM (
    SELECT DISTINCT i.order_id AS request_id, p.product_id, p.price, p.category
    FROM shop_items i JOIN shop_products p ON p.product_id = i.product_id AND p.is_active) GROUP BY request_id),
priced AS (
  SELECT r.request_id, r.user_id, t.total,
         CASE WHEN l.asked IS NULL THEN 'no_products' WHEN l.asked <> l.found THEN 'invalid_products' END AS reject_reason,
         CASE WHEN f.claim_id IS NOT NULL AND t.total >= f.min_order_amount
               AND (len(f.applicable_categories) = 0 OR list_has_any(f.applicable_categories, t.cats)) THEN f.claim_id END AS used_claim,
         {DISCOUNT.format(total='t.total')} AS offered
  FROM shop_requests r LEFT JOIN lines l USING (request_id) LEFT JOIN totals t USING (request_id)
  LEFT JOIN shop_offers f USING (request_id))
SELECT request_id, user_id, reject_reason,
       CASE WHEN reject_reason IS NULL THEN total END::BIGINT AS total_amount,
       CASE WHEN reject_reason IS NULL THEN CASE WHEN used_claim IS NULL THEN 0 ELSE offered END END::BIGINT AS discount_amount,
       CASE WHEN reject_reason IS NULL THEN greatest(0, total - CASE WHEN used_claim IS NULL THEN 0 ELSE offered END) END::BIGINT
         AS final_amount,
       CASE WHEN reject_reason IS NULL THEN used_claim END AS claim_id
FROM priced
""")
def price_orders(shop):
    return plain(coupons.price_orders(shop.requests, shop.request_lines, shop.products, shop.claims, shop.coupon_events))


@query("M1", sql="""
WITH accepted AS (
  SELECT i.order_id FROM shop_items i LEFT JOIN shop_products p ON p.product_id = i.product_id AND p.is_active
  GROUP BY i.order_id HAVING count(*) = count(DISTINCT p.product_id))
SELECT i.order_id, i.product_id, p.price
FROM shop_items i JOIN accepted USING (order_id) JOIN shop_products p ON p.product_id = i.product_id
JOIN shop_requests r ON r.request_id = i.order_id
""")
def placed_items(shop):
    priced = coupons.price_orders(shop.requests, shop.request_lines, shop.products, shop.claims, shop.coupon_events)
    return plain(coupons.placed_items(priced, shop.request_lines, shop.products))


@query("M16 J8 X6 X10", sql=f"""
WITH asked AS (SELECT *, CASE WHEN amount < 10000000 THEN [] WHEN amount < 25000000 THEN ['PROMO', 'SMALL'] ELSE ['LARGE'] END::VARCHAR[] AS cats
               FROM shop_requests),
quoted AS (
  SELECT a.request_id, a.user_id, a.claim_id, a.amount, f.coupon_event_id,
         CASE WHEN a.claim_id IS NULL OR a.amount = 0 THEN 'missing_input' WHEN f.claim_id IS NULL THEN 'unusable'
              WHEN f.min_order_amount > 0 AND a.amount < f.min_order_amount THEN 'below_minimum'
              WHEN len(f.applicable_categories) > 0 AND len(a.cats) > 0 AND NOT list_has_any(f.applicable_categories, a.cats)
                THEN 'category_mismatch' END AS reject_reason,
         {DISCOUNT.format(total='a.amount')} AS offered
  FROM asked a LEFT JOIN shop_offers f USING (request_id))
SELECT request_id, user_id, claim_id, amount::BIGINT AS amount, reject_reason,
       CASE WHEN reject_reason IS NULL THEN offered END::BIGINT AS discount, coupon_event_id
FROM quoted
""")
def quote_coupons(shop):
    amount = F.col("amount")
    named = F.when(amount < 10_000_000, F.array().cast("array<string>")) \
        .when(amount < 25_000_000, F.array(F.lit("PROMO"), F.lit("SMALL"))).otherwise(F.array(F.lit("LARGE")))
    requests = shop.requests.withColumn("categories", named)
    return plain(coupons.quote_coupons(requests, shop.claims, shop.coupon_events))


@query("M14 F8 J10", sql="""
WITH wanted AS (SELECT event_id AS request_id, user_id, item_id // 10 AS coupon_event_id, created_at
                FROM shop_events WHERE event_type IN ('signup', 'click')),
held AS (SELECT DISTINCT user_id, item_id // 10 AS coupon_event_id FROM shop_events WHERE event_type = 'purchase' AND value > 100),
checked AS (
  SELECT w.*, e.coupon_event_id IS NOT NULL AS runs, h.user_id IS NOT NULL AS held
  FROM wanted w LEFT JOIN shop_coupon_events e ON e.coupon_event_id = w.coupon_event_id
    AND CAST(w.created_at AS DATE) BETWEEN e.start_date AND e.end_date
  LEFT JOIN held h ON h.user_id = w.user_id AND h.coupon_event_id = w.coupon_event_id)
SELECT request_id, user_id, coupon_event_id, created_at,
       CASE WHEN NOT runs THEN 'not_running' WHEN held THEN 'already_claimed'
            WHEN row_number() OVER (PARTITION BY user_id, coupon_event_id, runs, held ORDER BY created_at, request_id) = 1 THEN 'granted'
            ELSE 'already_claimed' END AS outcome
FROM checked
""")
def claim_coupons(shop):
    group = F.floor(F.col("item_id") / 10).cast("bigint").alias("coupon_event_id")
    wanted = shop.events.filter(F.col("event_type").isin("signup", "click")) \
        .select(F.col("event_id").alias("request_id"), "user_id", group, "created_at")
    held = shop.events_of("purchase").filter(F.col("value") > 100).select("user_id", group)
    return coupons.claim_coupons(wanted, shop.coupon_events, held) \
        .select("request_id", "user_id", "coupon_event_id", "created_at", "outcome")


@query("X6 X7", sql="""
SELECT order_id, ((final_amount * 1250) // 10000)::BIGINT AS percent_off,
       least(final_amount, 15000000)::BIGINT AS amount_off,
       greatest(final_amount - 15000000, 0)::BIGINT AS left_to_pay
FROM shop_orders
""")
def coupon_discounts(shop):
    from ..functions.money import coupon_discount, final_amount
    total = F.col("final_amount")
    rate, off = F.lit("12.50").cast("decimal(10,2)"), F.lit("15000000").cast("decimal(10,2)")
    amount_off = coupon_discount(F.lit("amount"), off, total)
    return plain(shop.orders.select(
        "order_id", coupon_discount(F.lit("percent"), rate, total).alias("percent_off"), amount_off.alias("amount_off"),
        final_amount(total, amount_off).alias("left_to_pay")))
