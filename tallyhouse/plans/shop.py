"""Shop tables derived from the test tables, in Spark and as SQL.

``Shop`` gives each as a lazy DataFrame; SQL_TABLES holds the same derivation
as SQL, written on its own so that it can serve as a check.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.customer import GradeLimits
from ..functions.fixed_values import REGULAR_MAX, SPROUT_MAX, VIP_MAX
from ..operators.skew import join_measured
from ..sources.tables import read_table, stream_table

# Report dates: the orders end on 2001-08-01, the events on 2024-01-30.
ORDERS_AS_OF = "2001-06-30"
EVENTS_AS_OF = "2024-01-31"

# The test tables' amounts have two decimals; here they are whole hundredths,
# and so are the grade limits.
LIMITS = GradeLimits(100 * SPROUT_MAX, 100 * REGULAR_MAX, 100 * VIP_MAX)


def hundredths(amount):
    return F.round(amount * 100).cast("bigint")


# Coupon events: id, name, type, value, first and last day, minimum, categories.
COUPON_EVENTS = [
    (0, "spring", "percent", "10.00", "1995-01-01", "1998-12-31", 0, []),
    (1, "bulk", "amount", "50000.00", "1996-03-01", "2001-12-31", 200000, ["ECONOMY", "SMALL"]),
    (2, "odd percent", "percent", "12.50", "1995-06-01", "2000-06-30", 90000, ["LARGE", "PROMO", "MEDIUM"]),
    (3, "over the top", "percent", "120.00", "1997-01-01", "2001-12-31", 0, ["PROMO"]),
    (4, "large amount", "fixed", "40000000.00", "1995-01-01", "2001-12-31", 100000, []),
    (5, "new year", "percent", "7.00", "2024-01-01", "2024-01-10", 0, []),
    (6, "mid month", "amount", "30000.00", "2024-01-08", "2024-01-20", 10000, ["SMALL"]),
    (7, "late month", "percent", "15.00", "2024-01-15", "2024-01-31", 0, ["LARGE"]),
]
# The lines have no key of their own; these columns tell them apart.
ITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
CATEGORIES = {"ECONOMY": "Economy line", "LARGE": "Large parts", "MEDIUM": "Medium parts",
              "SMALL": "Small parts", "STANDARD": "Standard line"}


class Shop:
    """Lazy shop tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str, streaming: bool = False):
        self.spark, self.folder, self.streaming = spark, folder, streaming

    def live(self) -> "Shop":
        """The same tables as streams."""
        return Shop(self.spark, self.folder, streaming=True)

    def table(self, name: str) -> DataFrame:
        return (stream_table if self.streaming else read_table)(self.spark, self.folder, name)

    def values(self, rows, schema: str) -> DataFrame:
        """A small fixed dimension."""
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def users(self):
        balance = F.col("c_acctbal")
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
            F.concat(F.lower("c_name"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")).alias("email"),
            F.col("c_mktsegment").alias("provider"),
            F.when(balance >= 2000, F.col("c_custkey").cast("string")).alias("provider_id"),
            (balance >= 0).alias("is_active"), balance.between(0, 500).alias("is_dormant"),
            F.when(balance > 9800, "blacklist").when(balance > 9500, "vip").alias("manual_grade"),
            F.col("c_nationkey").alias("nation_id"))

    @cached_property
    def orders(self):
        state = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "P", "pending") \
            .otherwise("refund")
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), state.alias("status"),
            hundredths(F.col("o_totalprice")).alias("final_amount"), F.col("o_orderpriority").alias("payment_method"),
            F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("paid_at"))

    @cached_property
    def items(self):
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_linenumber").alias("line_no"), hundredths(F.col("l_extendedprice")).alias("price"),
            F.when(F.col("l_returnflag") == "R", "refunded").otherwise("active").alias("item_status"),
            F.col("l_linestatus").alias("line_status"), F.col("l_shipdate").alias("created_at"),
            F.xxhash64(*ITEM_KEY).alias("item_key"))

    @cached_property
    def products(self):
        size, price = F.col("p_size"), hundredths(F.col("p_retailprice"))
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
            F.col("p_type").alias("category"), F.col("p_brand").alias("description"), price.alias("price"),
            F.when(size > 25, price - size * 100).alias("discount_price"),
            F.when(size > 10, "inquiry").when(size > 7, "").alias("sale_type"),
            (size >= 5).alias("is_active"), size.cast("bigint").alias("view_count"),
            F.when(size > 20, size.cast("bigint")).alias("download_count"),
            (size > 45).alias("new_badge"), (size > 35).alias("best_badge"),
            F.timestamp_add("DAY", size, F.lit("1995-01-01").cast("timestamp_ntz")).cast("timestamp_ntz").alias("created_at"))

    @cached_property
    def reviews(self):
        """One review per order line, written by the buyer."""
        return self.table("lineitem").select(
            F.col("l_partkey").alias("product_id"), F.col("l_orderkey").alias("order_id"),
            ((F.col("l_quantity").cast("int") - 1) % 5 + 1).alias("rating"),
            F.col("l_linenumber").cast("bigint").alias("likes_count"), F.col("l_shipdate").alias("created_at"),
            F.xxhash64(*ITEM_KEY).alias("review_id"))

    @cached_property
    def user_reviews(self):
        return self.reviews.join(self.orders.select("order_id", "user_id"), "order_id")

    @cached_property
    def events(self):
        return self.table("events").select(
            "event_id", F.col("ts").alias("created_at"), "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("bigint").alias("item_id"))

    def events_of(self, kind: str) -> DataFrame:
        return self.events.filter(F.col("event_type") == kind)

    @cached_property
    def ledger(self):
        """Purchases add points, errors take them."""
        amount = hundredths(F.col("value"))
        return self.events.filter(F.col("event_type").isin("purchase", "error")).select(
            F.col("event_id").alias("entry_id"), "user_id", "created_at",
            F.when(F.col("event_type") == "purchase", amount).otherwise(-amount).alias("amount"))

    @cached_property
    def typed_ledger(self):
        from ..operators.changes import entry_type
        return self.ledger.withColumn("type", entry_type(F.col("amount")))

    @cached_property
    def toggles(self):
        return self.events_of("click").select(
            "item_id", F.col("user_id").cast("string").alias("fingerprint"), "created_at", "event_id")

    @cached_property
    def downloads(self):
        """Rights from purchase events, one per user and product."""
        return self.events_of("purchase").groupBy("user_id", F.col("item_id").alias("product_id")) \
            .agg(F.min("created_at").alias("created_at"), F.min("event_id").alias("order_id"))

    @cached_property
    def coupon_events(self):
        rows = self.values([tuple(r) for r in COUPON_EVENTS],
                           "coupon_event_id bigint, name string, discount_type string, discount_value string, "
                           "start_date string, end_date string, min_order_amount bigint, applicable_categories array<string>")
        return rows.withColumn("discount_value", F.col("discount_value").cast("decimal(10,2)")) \
            .withColumn("start_date", F.col("start_date").cast("date")) \
            .withColumn("end_date", F.col("end_date").cast("date"))

    @cached_property
    def claims(self):
        """Sign-up events as coupon claims; ten ids, of which eight exist."""
        return self.events_of("signup").select(
            F.col("event_id").alias("claim_id"), "user_id",
            F.floor(F.col("item_id") / 10).cast("bigint").alias("coupon_event_id"),
            (F.col("value") > 100).alias("is_used"), "created_at")

    @cached_property
    def requests(self):
        """Orders as requests that carry their buyer's last claim."""
        last = self.claims.groupBy("user_id").agg(F.max("claim_id").alias("claim_id"))
        asked = self.orders.select(F.col("order_id").alias("request_id"), "user_id", "created_at",
                                   F.col("final_amount").alias("amount"))
        return join_measured(asked, last, ["user_id"], "left")

    @cached_property
    def request_lines(self):
        return self.items.select(F.col("order_id").alias("request_id"), "product_id")

    @cached_property
    def payments(self):
        """A gateway feed made from the orders: good, wrong, failed, waiting,
        repeated and unknown payments, by payment method and state."""
        orders = self.orders
        how = F.col("payment_method")
        state = F.when(how == "5-LOW", "FAILED").when(how == "4-NOT SPECIFIED", "VIRTUAL_ACCOUNT_ISSUED").otherwise("PAID")
        amount = F.when(how == "2-HIGH", F.col("final_amount") + 1).otherwise(F.col("final_amount"))

        def feed(rows, prefix, order_id):
            return rows.select(F.concat(F.lit(prefix), F.col("order_id").cast("string")).alias("payment_id"),
                               order_id.alias("order_id"), amount.alias("amount"), state.alias("payment_status"),
                               F.lit("PaymentMethodCard").alias("method"),
                               F.when(F.col("user_id") < 700, "kakao").alias("provider"),
                               F.timestamp_add("HOUR", F.lit(2), F.col("created_at")).cast("timestamp_ntz").alias("paid_at"))

        first = feed(orders.filter(how != "3-MEDIUM"), "pay-", F.col("order_id"))
        again = feed(orders.filter((how == "1-URGENT") & (F.col("status") == "refund")), "again-", F.col("order_id"))
        unknown = feed(orders.filter((how == "5-LOW") & (F.col("status") == "paid")), "lost-", -1 - F.col("order_id"))
        return first.unionByName(again).unionByName(unknown)

    @cached_property
    def open_orders(self):
        """Orders with the columns payments fill, and the request's claim."""
        claims = self.requests.select(F.col("request_id").alias("order_id"), "claim_id")
        none = F.lit(None).cast("string")
        return self.orders.withColumn("payment_key", none).withColumn("pg_provider", none).join(claims, "order_id")

    @cached_property
    def refunds(self):
        """Whole and partial refund wishes by payment method."""
        how = F.col("payment_method")
        whole = self.orders.filter(how.isin("1-URGENT", "2-HIGH")).select(
            "order_id", F.lit(None).cast("int").alias("line_no"),
            F.when(how == "1-URGENT", "customer").otherwise("admin").alias("path"))
        some = self.items.filter(F.col("line_status") == "F") \
            .join(self.orders.filter(how == "3-MEDIUM").select("order_id"), "order_id", "left_semi") \
            .select("order_id", "line_no", F.lit("admin").alias("path"))
        return whole.unionByName(some)

    @cached_property
    def order_events(self):
        """What happens to the orders: the gateway's feed, captures and plain
        confirmations where it has none, and refunds, some of them too early."""
        orders, how = self.orders, F.col("payment_method")
        nothing = F.lit(None).cast("string")

        def events(rows, name, kind, hours, key=nothing, method=nothing, line=F.lit(None).cast("int")):
            return rows.select(F.concat(F.lit(name), F.col("order_id").cast("string")).alias("event_id"), "order_id", "user_id", F.lit(kind).alias("kind"),
                               F.lit(None).cast("bigint").alias("amount"), key.alias("payment_key"), method.alias("method"), nothing.alias("provider"),
                               line.alias("line_no"), F.timestamp_add("HOUR", F.lit(hours), F.col("created_at")).cast("timestamp_ntz").alias("at"))

        kind = F.when(F.col("payment_status") == "PAID", "paid").when(F.col("payment_status") == "FAILED", "failed").otherwise("virtual_account")
        fed = self.payments.join(orders.select("order_id", "user_id"), "order_id").select(
            F.col("payment_id").alias("event_id"), "order_id", "user_id", kind.alias("kind"), "amount", F.col("payment_id").alias("payment_key"),
            "method", "provider", F.lit(None).cast("int").alias("line_no"), F.col("paid_at").alias("at"))
        bare = orders.filter(how == "3-MEDIUM")
        key = F.concat(F.lit("key-"), F.col("order_id").cast("string"))
        lines = self.items.join(orders.select("order_id", "user_id", "payment_method", F.col("created_at").alias("_ordered")), "order_id") \
            .filter((F.col("line_status") == "F") & how.isin("1-URGENT", "3-MEDIUM")) \
            .withColumn("created_at", F.col("_ordered"))
        parts = [
            fed,
            events(bare.filter(F.col("user_id") % 2 == 0), "capture-", "capture", 3, key),
            events(bare.filter(F.col("user_id") % 2 == 1), "confirm-", "confirm", 3, key, F.lit("CARD")),
            events(bare.filter(F.col("user_id") % 5 == 0), "late-", "capture", 6, key),
            events(orders.filter(F.col("user_id") % 7 == 0), "early-", "customer_refund", 1),
            events(orders.filter(F.col("user_id") % 3 == 0), "back-", "customer_refund", 9),
            events(orders.filter((F.col("user_id") % 11 == 0) & (how == "1-URGENT")), "all-", "admin_refund", 8),
            events(lines, "line-", "admin_refund", 7, line=F.col("line_no")),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    @cached_property
    def ordered(self):
        """Orders before anything happened to them, with the coupon and the claim they carry."""
        claims = self.requests.select(F.col("request_id").alias("order_id"), "claim_id")
        return self.orders.select("order_id", "user_id", "final_amount", (F.col("user_id") % 50).alias("coupon_id")).join(claims, "order_id")

    @cached_property
    def user_coupons(self):
        """Coupons of users: the one their orders carry, and another."""
        users = self.users.select("user_id")
        mine = users.select("user_id", (F.col("user_id") % 50).alias("coupon_id"), (F.col("user_id") % 9 == 0).alias("is_used"))
        return mine.unionByName(users.select("user_id", (F.col("user_id") % 50 + 50).alias("coupon_id"), F.lit(False).alias("is_used")))

    @cached_property
    def inquiries(self):
        """Conversations; unanswered while the last turn is the user's.  The
        type follows the number of turns."""
        turns = self.table("conversations").groupBy("conv_id").agg(
            F.max(F.struct("turn", "role")).alias("_last"), F.count(F.lit(1)).alias("turns"))
        return turns.select(F.col("conv_id").alias("inquiry_id"), "turns",
                            (F.col("_last.role") != "user").alias("answered"),
                            F.when(F.col("turns") >= 6, "custom").when(F.col("turns") >= 4, "usage")
                            .when(F.col("turns") >= 2, "refund").otherwise("etc").alias("type"))

    @cached_property
    def category_labels(self):
        return self.values(list(CATEGORIES.items()), "code string, label string")


def _coupon_rows() -> str:
    rows = []
    for key, name, kind, value, first, last, least, cats in COUPON_EVENTS:
        listed = "[" + ", ".join(f"'{c}'" for c in cats) + "]::VARCHAR[]"
        rows.append(f"({key}::BIGINT, '{name}', '{kind}', {value}::DECIMAL(10,2), DATE '{first}', DATE '{last}', "
                    f"{least}::BIGINT, {listed})")
    return ",\n    ".join(rows)


SQL_TABLES = {
    "shop_users": """
  SELECT c_custkey AS user_id, c_name AS name,
         lower(c_name) || '@' || lower(c_mktsegment) || '.example' AS email, c_mktsegment AS provider,
         CASE WHEN c_acctbal >= 2000 THEN CAST(c_custkey AS VARCHAR) END AS provider_id,
         c_acctbal >= 0 AS is_active, c_acctbal BETWEEN 0 AND 500 AS is_dormant,
         CASE WHEN c_acctbal > 9800 THEN 'blacklist' WHEN c_acctbal > 9500 THEN 'vip' END AS manual_grade,
         c_nationkey AS nation_id
  FROM customer""",
    "shop_orders": """
  SELECT o_orderkey AS order_id, o_custkey AS user_id,
         CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'pending' ELSE 'refund' END AS status,
         CAST(round(o_totalprice * 100) AS BIGINT) AS final_amount, o_orderpriority AS payment_method,
         o_orderdate AS created_at, o_orderdate AS paid_at
  FROM orders""",
    "shop_items": """
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS line_no,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
         CASE WHEN l_returnflag = 'R' THEN 'refunded' ELSE 'active' END AS item_status,
         l_linestatus AS line_status, l_shipdate AS created_at
  FROM lineitem""",
    "shop_products": """
  SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_brand AS description,
         CAST(round(p_retailprice * 100) AS BIGINT) AS price,
         CASE WHEN p_size > 25 THEN CAST(round(p_retailprice * 100) AS BIGINT) - p_size * 100 END AS discount_price,
         CASE WHEN p_size > 10 THEN 'inquiry' WHEN p_size > 7 THEN '' END AS sale_type,
         p_size >= 5 AS is_active, CAST(p_size AS BIGINT) AS view_count,
         CASE WHEN p_size > 20 THEN CAST(p_size AS BIGINT) END AS download_count,
         p_size > 45 AS new_badge, p_size > 35 AS best_badge,
         TIMESTAMP '1995-01-01' + to_days(p_size) AS created_at
  FROM part""",
    "shop_reviews": """
  SELECT l_partkey AS product_id, l_orderkey AS order_id, (CAST(l_quantity AS INTEGER) - 1) % 5 + 1 AS rating,
         CAST(l_linenumber AS BIGINT) AS likes_count, l_shipdate AS created_at
  FROM lineitem""",
    "shop_events": """
  SELECT event_id, ts AS created_at, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id
  FROM events""",
    "shop_ledger": """
  SELECT event_id AS entry_id, user_id, created_at,
         CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END * CAST(round(value * 100) AS BIGINT) AS amount
  FROM shop_events WHERE event_type IN ('purchase', 'error')""",
    "shop_downloads": """
  SELECT user_id, item_id AS product_id, min(created_at) AS created_at, min(event_id) AS order_id
  FROM shop_events WHERE event_type = 'purchase' GROUP BY user_id, item_id""",
    "shop_coupon_events": f"""
  SELECT * FROM (VALUES
    {_coupon_rows()}
  ) AS v(coupon_event_id, name, discount_type, discount_value, start_date, end_date, min_order_amount, applicable_categories)""",
    "shop_claims": """
  SELECT event_id AS claim_id, user_id, item_id // 10 AS coupon_event_id, value > 100 AS is_used, created_at
  FROM shop_events WHERE event_type = 'signup'""",
    "shop_requests": """
  SELECT o.order_id AS request_id, o.user_id, o.created_at, o.final_amount AS amount, c.claim_id
  FROM shop_orders o LEFT JOIN (SELECT user_id, max(claim_id) AS claim_id FROM shop_claims GROUP BY user_id) c
    ON c.user_id = o.user_id""",
    "shop_offers": """
  SELECT r.request_id, r.claim_id, e.*
  FROM shop_requests r
  JOIN shop_claims c ON c.claim_id = r.claim_id AND c.user_id = r.user_id AND NOT c.is_used
  JOIN shop_coupon_events e ON e.coupon_event_id = c.coupon_event_id
   AND CAST(r.created_at AS DATE) BETWEEN e.start_date AND e.end_date""",
    "shop_payments": """
  SELECT prefix || CAST(order_id AS VARCHAR) AS payment_id,
         CASE prefix WHEN 'lost-' THEN -1 - order_id ELSE order_id END AS order_id,
         CASE payment_method WHEN '2-HIGH' THEN final_amount + 1 ELSE final_amount END AS amount,
         CASE payment_method WHEN '5-LOW' THEN 'FAILED' WHEN '4-NOT SPECIFIED' THEN 'VIRTUAL_ACCOUNT_ISSUED' ELSE 'PAID' END
           AS payment_status,
         'PaymentMethodCard' AS method, CASE WHEN user_id < 700 THEN 'kakao' END AS provider,
         created_at + INTERVAL 2 HOUR AS paid_at
  FROM shop_orders JOIN (VALUES ('pay-'), ('again-'), ('lost-')) AS p(prefix)
    ON (prefix = 'pay-' AND payment_method <> '3-MEDIUM')
    OR (prefix = 'again-' AND payment_method = '1-URGENT' AND status = 'refund')
    OR (prefix = 'lost-' AND payment_method = '5-LOW' AND status = 'paid')""",
    "shop_paid": """
  SELECT o.order_id, o.user_id, o.final_amount, o.created_at, r.claim_id,
         CASE WHEN o.status = 'pending' AND p.order_id IS NOT NULL THEN 'paid'
              WHEN o.status = 'pending' AND v.order_id IS NOT NULL THEN 'vbank_pending' ELSE o.status END AS status,
         CASE WHEN o.status = 'pending' THEN coalesce(p.payment_id, v.payment_id) END AS payment_key,
         CASE WHEN o.status = 'pending' AND p.order_id IS NOT NULL THEN 'Card' ELSE o.payment_method END AS payment_method,
         CASE WHEN o.status <> 'pending' OR coalesce(p.order_id, v.order_id) IS NULL THEN NULL
              ELSE coalesce(CASE WHEN p.order_id IS NULL THEN v.provider ELSE p.provider END, 'portone') END AS pg_provider,
         CASE WHEN o.status = 'pending' AND p.order_id IS NOT NULL THEN p.paid_at ELSE o.paid_at END AS paid_at,
         o.status = 'pending' AND p.order_id IS NOT NULL AS newly_paid
  FROM shop_orders o
  JOIN shop_requests r ON r.request_id = o.order_id
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY order_id, amount ORDER BY paid_at, payment_id) AS n
             FROM shop_payments WHERE payment_status = 'PAID') p
    ON p.order_id = o.order_id AND p.amount = o.final_amount AND p.n = 1
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY paid_at, payment_id) AS n
             FROM shop_payments WHERE payment_status = 'VIRTUAL_ACCOUNT_ISSUED') v
    ON v.order_id = o.order_id AND v.n = 1""",
    "shop_bought": """
  SELECT p.user_id, i.product_id, min(p.order_id) AS order_id
  FROM shop_paid p JOIN shop_items i ON i.order_id = p.order_id WHERE p.newly_paid GROUP BY p.user_id, i.product_id""",
    "shop_refunded_items": """
  SELECT i.*,
         i.item_status = 'active' AND o.status = 'paid'
           AND (o.payment_method IN ('1-URGENT', '2-HIGH')
                OR (o.payment_method = '3-MEDIUM' AND EXISTS (
                    SELECT 1 FROM shop_items f WHERE f.order_id = i.order_id AND f.line_no = i.line_no AND f.line_status = 'F')))
           AS refunded_now
  FROM shop_items i JOIN shop_orders o ON o.order_id = i.order_id""",
    "shop_order_events": """
  SELECT payment_id AS event_id, p.order_id, o.user_id,
         CASE payment_status WHEN 'PAID' THEN 'paid' WHEN 'FAILED' THEN 'failed' ELSE 'virtual_account' END AS kind,
         p.amount, payment_id AS payment_key, p.method, p.provider, NULL::INT AS line_no, p.paid_at AS seen
  FROM shop_payments p JOIN shop_orders o ON o.order_id = p.order_id
  UNION ALL
  SELECT 'capture-' || order_id, order_id, user_id, 'capture', NULL, 'key-' || order_id, NULL, NULL, NULL, created_at + INTERVAL 3 HOUR
  FROM shop_orders WHERE payment_method = '3-MEDIUM' AND user_id % 2 = 0
  UNION ALL
  SELECT 'confirm-' || order_id, order_id, user_id, 'confirm', NULL, 'key-' || order_id, 'CARD', NULL, NULL, created_at + INTERVAL 3 HOUR
  FROM shop_orders WHERE payment_method = '3-MEDIUM' AND user_id % 2 = 1
  UNION ALL
  SELECT 'late-' || order_id, order_id, user_id, 'capture', NULL, 'key-' || order_id, NULL, NULL, NULL, created_at + INTERVAL 6 HOUR
  FROM shop_orders WHERE payment_method = '3-MEDIUM' AND user_id % 5 = 0
  UNION ALL
  SELECT 'early-' || order_id, order_id, user_id, 'customer_refund', NULL, NULL, NULL, NULL, NULL, created_at + INTERVAL 1 HOUR
  FROM shop_orders WHERE user_id % 7 = 0
  UNION ALL
  SELECT 'back-' || order_id, order_id, user_id, 'customer_refund', NULL, NULL, NULL, NULL, NULL, created_at + INTERVAL 9 HOUR
  FROM shop_orders WHERE user_id % 3 = 0
  UNION ALL
  SELECT 'all-' || order_id, order_id, user_id, 'admin_refund', NULL, NULL, NULL, NULL, NULL, created_at + INTERVAL 8 HOUR
  FROM shop_orders WHERE user_id % 11 = 0 AND payment_method = '1-URGENT'
  UNION ALL
  SELECT 'line-' || i.order_id, i.order_id, o.user_id, 'admin_refund', NULL, NULL, NULL, NULL, i.line_no, o.created_at + INTERVAL 7 HOUR
  FROM shop_items i JOIN shop_orders o ON o.order_id = i.order_id
  WHERE i.line_status = 'F' AND o.payment_method IN ('1-URGENT', '3-MEDIUM')""",
    # Every fact about an order by a scan of its own events in time order.
    "shop_first_payment": """
  SELECT * FROM (
    SELECT e.*, row_number() OVER (PARTITION BY e.order_id ORDER BY seen, event_id) AS nth
    FROM shop_order_events e JOIN shop_orders o ON o.order_id = e.order_id
    WHERE kind IN ('capture', 'confirm') OR (kind = 'paid' AND e.amount = o.final_amount)) WHERE nth = 1""",
    "shop_first_account": """
  SELECT order_id, arg_min(payment_key, seen) AS payment_key, arg_min(provider, seen) AS provider
  FROM shop_order_events WHERE kind = 'virtual_account' GROUP BY order_id""",
    "shop_line_history": """
  SELECT i.order_id, i.line_no, i.product_id, i.price, min(r.seen) AS refunded_at
  FROM shop_items i
  LEFT JOIN shop_first_payment p ON p.order_id = i.order_id
  LEFT JOIN shop_order_events r ON r.order_id = i.order_id AND r.seen > p.seen AND r.kind IN ('customer_refund', 'admin_refund')
   AND (r.line_no IS NULL OR r.line_no = i.line_no)
  GROUP BY ALL""",
    "shop_history": """
  SELECT o.order_id, o.user_id, o.final_amount, o.user_id % 50 AS coupon_id, q.claim_id,
         CASE WHEN p.order_id IS NOT NULL THEN CASE WHEN l.open_lines = 0 OR c.seen IS NOT NULL THEN 'refund' ELSE 'paid' END
              WHEN v.order_id IS NOT NULL THEN 'vbank_pending' ELSE 'pending' END AS status,
         CASE WHEN p.order_id IS NULL THEN v.payment_key ELSE p.payment_key END AS payment_key,
         CASE p.kind WHEN 'paid' THEN 'Card' WHEN 'capture' THEN 'PAYPAL' WHEN 'confirm' THEN 'CARD' END AS payment_method,
         CASE WHEN p.kind = 'paid' THEN coalesce(p.provider, 'portone') WHEN p.kind = 'capture' THEN 'paypal' WHEN p.kind = 'confirm' THEN NULL
              WHEN v.order_id IS NOT NULL THEN coalesce(v.provider, 'portone') END AS pg_provider,
         p.seen AS paid_at, coalesce(l.back, 0) AS refund_amount,
         CASE WHEN c.seen <= coalesce(l.closed_at, c.seen) THEN 'customer' WHEN l.open_lines = 0 THEN 'admin' END AS refunded_by
  FROM shop_orders o
  JOIN shop_requests q ON q.request_id = o.order_id
  LEFT JOIN shop_first_payment p ON p.order_id = o.order_id
  LEFT JOIN shop_first_account v ON v.order_id = o.order_id
  LEFT JOIN (SELECT order_id, count(*) FILTER (refunded_at IS NULL) AS open_lines, sum(price) FILTER (refunded_at IS NOT NULL) AS back,
                    max(refunded_at) AS closed_at FROM shop_line_history GROUP BY order_id) l ON l.order_id = o.order_id
  LEFT JOIN (SELECT p.order_id, min(r.seen) AS seen FROM shop_first_payment p JOIN shop_order_events r ON r.order_id = p.order_id
             WHERE r.kind = 'customer_refund' AND r.seen > p.seen GROUP BY p.order_id) c ON c.order_id = o.order_id""",
    "shop_inquiries": """
  SELECT conv_id AS inquiry_id, count(*) AS turns, arg_max(role, turn) <> 'user' AS answered,
         CASE WHEN count(*) >= 6 THEN 'custom' WHEN count(*) >= 4 THEN 'usage' WHEN count(*) >= 2 THEN 'refund' ELSE 'etc' END AS type
  FROM conversations GROUP BY conv_id""",
    "shop_category_labels": """
  SELECT * FROM (VALUES ('ECONOMY', 'Economy line'), ('LARGE', 'Large parts'), ('MEDIUM', 'Medium parts'),
                        ('SMALL', 'Small parts'), ('STANDARD', 'Standard line')) AS v(code, label)""",
    "shop_rfm": f"""
  SELECT user_id,
         sum(CASE WHEN status = 'paid' THEN final_amount ELSE 0 END) AS total_spent,
         count(*) FILTER (WHERE status = 'paid') AS total_orders,
         sum(CASE WHEN status = 'paid' AND paid_at >= TIMESTAMP '2001-06-01' THEN final_amount ELSE 0 END) AS monthly_amount,
         max(CASE WHEN status = 'paid' THEN paid_at END) AS last_purchased_at,
         min(CASE WHEN status = 'paid' THEN paid_at END) AS first_purchased_at,
         count(*) FILTER (WHERE status = 'refund') AS refund_count
  FROM shop_orders WHERE paid_at <= TIMESTAMP '{ORDERS_AS_OF}' GROUP BY user_id""",
    "shop_measured": """
  SELECT u.*, coalesce(r.total_spent, 0) AS total_spent, coalesce(r.total_orders, 0) AS total_orders,
         coalesce(r.monthly_amount, 0) AS monthly_amount, r.last_purchased_at, r.first_purchased_at,
         coalesce(r.refund_count, 0) AS refund_count
  FROM shop_users u LEFT JOIN shop_rfm r ON r.user_id = u.user_id""",
    "shop_graded": """
  SELECT *, coalesce(manual_grade, CASE WHEN total_orders = 0 THEN 'new' WHEN monthly_amount <= 5000000 THEN 'sprout'
         WHEN monthly_amount <= 30000000 THEN 'regular' WHEN monthly_amount <= 100000000 THEN 'vip' ELSE 'vvip' END) AS grade
  FROM shop_measured""",
}


def with_tables(sql: str) -> str:
    """Put the derivations of the shop tables that ``sql`` names in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SQL_TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(SQL_TABLES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({SQL_TABLES[name]}\n)" for name in needed)
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{ctes},\n{body[len(start):]}"
    return f"WITH {ctes}\n{body}"
