"""Audit queries."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..operators import quality
from ..sources.tables import read_table
from .output import plain
from .registry import query

SPACE = "concat(chr(9), chr(10), chr(11), chr(12), chr(13), ' ', chr(160), chr(5760), " \
    + ", ".join(f"chr({c})" for c in range(0x2000, 0x200B)) + ", chr(8232), chr(8233), chr(8239), chr(8287), chr(12288), chr(65279))"
# Code points, and once more those beyond the 16-bit plane.
UNITS = "(length(body) + length(regexp_replace(body, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"


@query("Q1 X15", sql=f"""
WITH docs AS (SELECT doc_id, trim(text, {SPACE}) AS body, length(source) AS rating FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN body = '' THEN 'missing' END, CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating_range' END,
         CASE WHEN body <> '' AND {UNITS} < 10 THEN 'too_short' END, CASE WHEN {UNITS} > 1000 THEN 'too_long' END) AS reasons
FROM docs
""")
def validate_reviews(shop):
    texts = shop.table("documents").select("doc_id", F.length("source").alias("rating"), F.col("text").alias("content"))
    checked = quality.validate_rows(texts, quality.review_rules(product="doc_id"))
    return checked.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("Q1", sql=f"""
WITH docs AS (SELECT doc_id, source, trim(text, {SPACE}) AS body, length(source) AS rating FROM documents)
SELECT source, count(*)::BIGINT AS texts,
       (count(*) FILTER (WHERE rating BETWEEN 1 AND 5 AND {UNITS} BETWEEN 10 AND 1000))::BIGINT AS valid,
       (count(*) FILTER (WHERE NOT (rating BETWEEN 1 AND 5 AND {UNITS} BETWEEN 10 AND 1000)))::BIGINT AS broken
FROM docs GROUP BY source
""")
def quarantine_counts(shop):
    texts = shop.table("documents").select("doc_id", "source", F.length("source").alias("rating"), F.col("text").alias("content"))
    checked = quality.validate_rows(texts, quality.review_rules(product="doc_id"))
    ok = F.size("reasons") == 0
    return checked.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if(ok).alias("valid"),
                                         F.count_if(~ok).alias("broken"))


@query("Q1 X16 X18", sql="""
WITH forms AS (
  SELECT user_id, substr(replace(name, '#', ''), 1, CASE WHEN nation_id < 5 THEN 2 WHEN nation_id < 15 THEN 18 ELSE 30 END) AS login_id,
         CASE WHEN nation_id < 20 THEN provider ELSE '' END AS domain, nation_id + 4 AS password_length, name, phone FROM (
    SELECT *, '010-' || lpad(CAST(nation_id AS VARCHAR), 4, '0') || '-' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS phone FROM shop_users)),
full_forms AS (SELECT *, CASE WHEN domain = '' THEN '' ELSE login_id || '@' || domain END AS email FROM forms)
SELECT user_id, email, phone, regexp_replace(phone, '[^0-9]', '', 'g') AS digits,
       concat_ws(',', CASE WHEN email = '' THEN 'missing' END,
         CASE WHEN NOT regexp_full_match(login_id, '[a-zA-Z][a-zA-Z0-9]{2,19}') THEN 'login_id' END,
         CASE WHEN password_length NOT BETWEEN 8 AND 20 THEN 'password' END,
         CASE WHEN length(name) NOT BETWEEN 2 AND 40 THEN 'name' END) AS reasons
FROM full_forms
""")
def validate_registrations(shop):
    nation = F.col("nation_id")
    size = F.when(nation < 5, 2).when(nation < 15, 18).otherwise(30)
    padded = lambda c: F.when(F.length(c.cast("string")) > 4, F.substring(c.cast("string"), 1, 4)).otherwise(F.lpad(c.cast("string"), 4, "0"))
    forms = shop.users.select(
        "user_id", "name", F.substring(F.replace("name", F.lit("#"), F.lit("")), F.lit(1), size).alias("login_id"),
        F.when(nation < 20, F.col("provider")).otherwise("").alias("domain"), (nation + 4).alias("password_length"),
        text.phone_number(F.lit("010"), padded(nation), padded(F.col("user_id"))).alias("phone")) \
        .withColumn("email", text.email_address(F.col("login_id"), F.col("domain")))
    checked = quality.validate_rows(forms, quality.registration_rules())
    return checked.select("user_id", "email", "phone", text.digits_only(F.col("phone")).alias("digits"),
                          F.array_join("reasons", ",").alias("reasons"))


@query("Q1", sql="""
SELECT product_id, concat_ws(',', CASE WHEN category = 'PROMO' THEN 'category' END) AS reasons FROM shop_products
""")
def validate_products(shop):
    unlabelled = shop.products.withColumn("category", F.when(F.col("category") == "PROMO", "").otherwise(F.col("category")))
    return quality.validate_rows(unlabelled, quality.product_rules()) \
        .select("product_id", F.array_join("reasons", ",").alias("reasons"))


@query("Q1", sql="""
SELECT doc_id, concat_ws(',', CASE WHEN coalesce(text, '') = '' THEN 'missing' END,
         CASE WHEN length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 100 THEN 'too_long' END) AS reasons
FROM documents
""")
def validate_fingerprints(shop):
    """The rules of a browser's fingerprint, on the texts of the documents."""
    prints = shop.table("documents").select("doc_id", F.col("text").alias("fingerprint"))
    return quality.validate_rows(prints, quality.fingerprint_rules()).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("Q1", sql="""
WITH offers AS (SELECT CASE l_returnflag WHEN 'R' THEN 'percent' WHEN 'A' THEN 'amount' ELSE 'gift' END AS discount_type, l_shipdate,
                       l_discount, l_linenumber, l_linenumber * 30 - 90 AS days FROM lineitem),
checked AS (SELECT concat_ws(',', CASE WHEN l_linenumber = 1 OR l_discount = 0 THEN 'missing' END,
                             CASE WHEN discount_type = 'gift' THEN 'discount_type' END, CASE WHEN days < 0 THEN 'window' END) AS reasons FROM offers)
SELECT CASE WHEN reasons = '' THEN 'valid' ELSE reasons END AS outcome, count(*)::BIGINT AS events FROM checked GROUP BY reasons
""")
def coupon_event_audit(shop):
    """The rules of a coupon event, on the order lines read as offers: kept rows, and set-aside rows by the rules they break."""
    start = F.col("l_shipdate").cast("date")
    rows = shop.table("lineitem").select(
        F.when(F.col("l_linenumber") > 1, F.lit("offer")).alias("name"),
        F.when(F.col("l_returnflag") == "R", "percent").when(F.col("l_returnflag") == "A", "amount").otherwise("gift").alias("discount_type"),
        F.col("l_discount").alias("discount_value"), start.alias("start_date"),
        F.date_add(start, (F.col("l_linenumber") * 30 - 90).cast("int")).alias("end_date"))
    kept, aside = quality.quarantine(quality.validate_rows(rows, quality.coupon_event_rules()))
    outcomes = kept.select(F.lit("valid").alias("outcome")).unionByName(aside.select(F.array_join("reasons", ",").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("events"))


@query("Q2", sql="""
SELECT count(*)::BIGINT AS n_rows, (count(*) FILTER (WHERE rating NOT BETWEEN 1 AND 4))::BIGINT AS rating,
       (count(*) FILTER (WHERE likes_count NOT BETWEEN 1 AND 7))::BIGINT AS likes
FROM shop_reviews
""")
def review_domains(shop):
    return quality.check_domains(shop.reviews, {"rating": F.col("rating").between(1, 4),
                                                "likes": F.col("likes_count").between(1, 7)})


@query("Q2", sql="""
SELECT count(*)::BIGINT AS n_rows, 0::BIGINT AS grade,
       (count(*) FILTER (WHERE provider NOT IN ('BUILDING', 'FURNITURE')))::BIGINT AS provider,
       (count(*) FILTER (WHERE NOT (user_id > 0 AND user_id < nation_id * 100 AND nation_id < 20)))::BIGINT AS limits
FROM shop_users
""")
def user_domains(shop):
    users = shop.users.withColumn("upper", F.col("nation_id") * 100).withColumn("top", F.col("nation_id") * 100 + 1)
    ascending = quality.ascending_limits("user_id", "upper", "top") & (F.col("nation_id") < 20)
    return quality.check_domains(users, {"grade": quality.grade_domain(),
                                         "provider": F.col("provider").isin("BUILDING", "FURNITURE"), "limits": ascending})


@query("Q3", sql="""
SELECT 'items' AS key_name, count(*)::BIGINT AS repeated_keys, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows FROM (
  SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'orders', count(*)::BIGINT, coalesce(sum(n - 1), 0)::BIGINT FROM (
  SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'downloads', count(*)::BIGINT, coalesce(sum(n - 1), 0)::BIGINT FROM (
  SELECT count(*) AS n FROM shop_events WHERE event_type = 'purchase' GROUP BY user_id, item_id HAVING count(*) > 1)
UNION ALL SELECT 'emails', count(*)::BIGINT, coalesce(sum(n - 1), 0)::BIGINT FROM (
  SELECT count(*) AS n FROM shop_users GROUP BY email HAVING count(*) > 1)
UNION ALL SELECT 'likes', count(*)::BIGINT, coalesce(sum(n - 1), 0)::BIGINT FROM (
  SELECT count(*) AS n FROM shop_events WHERE event_type = 'click' GROUP BY user_id, item_id HAVING count(*) > 1)
""")
def check_unique(shop):
    return quality.check_unique({
        "items": (shop.items, ["order_id", "line_no"]),
        "orders": (shop.orders, ["order_id"]),
        "downloads": (shop.events_of("purchase"), ["user_id", "item_id"]),
        "emails": (shop.users, ["email"]),
        "likes": (shop.toggles, ["item_id", "fingerprint"]),
    })


def _orphans(name, child, key, parent, parent_key):
    return f"""SELECT '{name}' AS reference, count(DISTINCT {key})::BIGINT AS orphan_keys, count(*)::BIGINT AS orphan_rows
FROM {child} WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {parent_key} FROM {parent})"""


@query("Q4", sql="\nUNION ALL\n".join([
    _orphans("items.order", "shop_items", "order_id", "shop_orders", "order_id"),
    _orphans("items.product", "shop_items", "product_id", "shop_products", "product_id"),
    _orphans("orders.user", "shop_orders", "user_id", "shop_users", "user_id"),
    _orphans("claims.event", "shop_claims", "coupon_event_id", "shop_coupon_events", "coupon_event_id"),
    _orphans("labels.doc", "labels", "doc_id", "documents", "doc_id"),
    _orphans("docs.label", "documents", "doc_id", "labels", "doc_id"),
    _orphans("events.page", "shop_events", "event_id", "pages", "page_id"),
]))
def check_foreign_keys(shop):
    docs, labels = shop.table("documents"), shop.table("labels")
    return quality.check_foreign_keys({
        "items.order": (shop.items, "order_id", shop.orders, "order_id"),
        "items.product": (shop.items, "product_id", shop.products, "product_id"),
        "orders.user": (shop.orders, "user_id", shop.users, "user_id"),
        "claims.event": (shop.claims, "coupon_event_id", shop.coupon_events, "coupon_event_id"),
        "labels.doc": (labels, "doc_id", docs, "doc_id"),
        "docs.label": (docs, "doc_id", labels, "doc_id"),
        "events.page": (shop.events, "event_id", shop.table("pages"), "page_id"),
    })


@query("Q5", sql="""
SELECT 'c_custkey' AS column_name, 'ok' AS state, 'bigint' AS expected_type, 'bigint' AS found_type, count(c_custkey)::BIGINT AS non_null_rows
FROM customer
UNION ALL SELECT 'c_name', 'ok', 'string', 'string', count(c_name)::BIGINT FROM customer
UNION ALL SELECT 'c_acctbal', 'retyped', 'decimal(18,2)', 'double', count(c_acctbal)::BIGINT FROM customer
UNION ALL SELECT 'c_phone', 'missing', 'string', NULL, 0::BIGINT
UNION ALL SELECT 'c_nationkey', 'added', NULL, 'int', count(c_nationkey)::BIGINT FROM customer
UNION ALL SELECT 'c_mktsegment', 'added', NULL, 'string', count(c_mktsegment)::BIGINT FROM customer
""")
def schema_drift(shop):
    expected = StructType.fromDDL("c_custkey bigint, c_name string, c_acctbal decimal(18,2), c_phone string")
    stored = read_table(shop.spark, shop.folder, "customer", declared=False)
    return plain(quality.schema_drift(stored, expected))
