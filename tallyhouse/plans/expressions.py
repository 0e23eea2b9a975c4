"""Queries that show the scalar rules over whole tables."""

from pyspark.sql import functions as F

from ..functions import dates, money, text
from .output import plain
from .registry import query


@query("X9", sql="""
SELECT user_id, CASE WHEN name = '' THEN '익*' WHEN length(name) = 1 THEN name || '***'
                    ELSE substr(name, 1, 1) || repeat('*', least(length(name) - 1, 3)::INTEGER) END AS masked
FROM shop_users
""")
def masked_names(shop):
    return shop.users.select("user_id", text.masked_name(F.col("name")).alias("masked"))


@query("X11 X12", sql="""
SELECT order_id, strftime(created_at, '%Y-%m-%d') AS day, strftime(created_at, '%Y.%m.%d') AS dotted,
       strftime(created_at, '%Y-%m') AS month, month(created_at) || '/' || dayofmonth(created_at) AS label,
       strftime(date_trunc('month', created_at), '%Y-%m-%d') AS month_start,
       strftime(last_day(created_at), '%Y-%m-%d') AS month_end,
       CAST(floor(epoch(TIMESTAMP '2001-06-30' - created_at) / 86400) AS BIGINT) AS age_days
FROM shop_orders
""")
def date_texts(shop):
    at = F.col("created_at")
    return plain(shop.orders.select(
        "order_id", dates.day_text(at).alias("day"), dates.dotted_day_text(at).alias("dotted"),
        dates.month_text(at).alias("month"), dates.chart_label(at).alias("label"),
        dates.trunc_month(at).alias("month_start"), F.last_day(at).alias("month_end"),
        dates.whole_days_between(at, "2001-06-30").alias("age_days")))


@query("X4 X5 X19", sql="""
SELECT product_id, CASE WHEN view_count < 3 THEN NULL ELSE coalesce(nullif(discount_price, 0), price) END::BIGINT AS shown_price,
       view_count < 3 AS asks, CASE WHEN new_badge THEN 'NEW' WHEN best_badge THEN 'BEST' ELSE 'ON SALE' END AS badge,
       CASE WHEN coalesce(sale_type, '') = '' THEN 'file' ELSE sale_type END AS type
FROM shop_products
""")
def product_cards(shop):
    price = money.money(F.when(F.col("view_count") < 3, 0).otherwise(F.col("price")))
    return plain(shop.products.withColumn("price", price).select(
        "product_id", money.shown_price(F.col("price"), F.col("discount_price")).alias("shown_price"),
        money.asks_for_price(F.col("price")).alias("asks"), money.badge(F.col("new_badge"), F.col("best_badge")).alias("badge"),
        money.default_if_falsy(F.col("sale_type"), "file", "").alias("type")))


@query("X8", sql="""
SELECT order_id, ((final_amount * 200 + 1350) // 2700) / 100.0::DOUBLE AS usd FROM shop_orders
""")
def order_amounts_in_usd(shop):
    return plain(shop.orders.select("order_id", money.in_usd(F.col("final_amount")).alias("usd")))


@query("X23", sql="""
SELECT CASE role WHEN 'user' THEN 'usage' WHEN 'assistant' THEN 'custom' ELSE 'etc' END AS code, count(*)::BIGINT AS n,
       sum(length(text))::BIGINT AS chars
FROM conversations GROUP BY 1
""")
def inquiry_codes(shop):
    choice = F.when(F.col("role") == "user", "상품 이용 문의").when(F.col("role") == "assistant", "맞춤 제작 문의").otherwise("other")
    return shop.table("conversations").groupBy(text.inquiry_code(choice).alias("code")) \
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("X22 X10", sql="""
SELECT doc_id, lang || '|' || source AS joined, lang IN ('en', 'de') OR source = 'src3' AS allowed FROM documents
""")
def json_arrays(shop):
    stored = F.to_json(F.array("lang", "source"))
    parsed = shop.table("documents").select("doc_id", text.text_array(stored).alias("cats"))
    limits = F.array(F.lit("en"), F.lit("de"), F.lit("src3"))
    return parsed.select("doc_id", F.array_join("cats", "|").alias("joined"),
                         text.categories_allowed(limits, F.col("cats")).alias("allowed"))


@query("X24", sql="""
SELECT payment_id, 'Card' AS method, coalesce(provider, 'portone') AS provider FROM shop_payments
""")
def payment_names(shop):
    return shop.payments.select("payment_id", text.clean_payment_method(F.col("method")).alias("method"),
                                text.payment_provider(F.col("provider")).alias("provider"))
