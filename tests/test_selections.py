"""Filters, joins, coupons, reports and audits on small hand-written tables."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyhouse.operators import coupons, customers, filters, joins, ordering, quality, reports

DAY = dt.datetime(2001, 6, 15, 10)


def ids(df, column):
    return sorted(r[0] for r in df.select(column).collect())


def test_filters_off_is_identity(shop):
    assert filters.filter_orders(shop.orders, status="all", payment_method="", date_from=None).count() == shop.orders.count()
    assert filters.name_contains(shop.products, "  ").count() == shop.products.count()
    assert filters.with_price(shop.products, "all").count() == shop.products.count()
    assert filters.search_keyword(shop.products, ["name"], " ").count() == 0


def test_date_to_excludes_the_next_midnight(spark):
    orders = spark.createDataFrame([(1, dt.datetime(2001, 6, 30, 23, 59)), (2, dt.datetime(2001, 7, 1))],
                                   "order_id bigint, created_at timestamp_ntz")
    assert ids(filters.filter_orders(orders, date_to="2001-06-30"), "order_id") == [1]


def test_coupons_without_expiry_sort_last(spark):
    held = spark.createDataFrame([(1, 1, 1, False), (2, 1, 2, False), (3, 1, 3, False), (4, 1, 1, True)],
                                 "user_coupon_id bigint, user_id bigint, coupon_id bigint, is_used boolean")
    kinds = spark.createDataFrame([(1, None), (2, dt.datetime(2024, 5, 1)), (3, dt.datetime(2024, 1, 1))],
                                  "coupon_id bigint, expires_at timestamp_ntz")
    found = filters.usable_coupons(held, kinds, "2024-01-01").collect()
    assert [r.user_coupon_id for r in found] == [2, 1]


def test_claimed_coupons_order(spark):
    events = spark.createDataFrame([(1, dt.date(2024, 1, 31))], "coupon_event_id bigint, end_date date")
    claims = spark.createDataFrame([(1, 1, 1, True, DAY), (2, 1, 1, False, DAY), (3, 1, 1, False, DAY + dt.timedelta(1))],
                                   "claim_id bigint, user_id bigint, coupon_event_id bigint, is_used boolean, created_at timestamp_ntz")
    every = filters.claimed_coupons(claims, events, "2025-01-01", show_all=True).collect()
    assert [r.claim_id for r in every] == [3, 2, 1]
    assert [r.claim_id for r in filters.claimed_coupons(claims, events, "2024-01-31").collect()] == [3, 2]
    assert filters.claimed_coupons(claims, events, "2024-02-01").count() == 0


def test_keyset_pages_join_up(shop):
    newest = [F.col("created_at").desc(), F.col("order_id").desc()]
    first, second = (ordering.page(shop.orders, newest, n, 20).select("order_id", "created_at").collect() for n in (1, 2))
    last = first[-1]
    after = ordering.page_after(shop.orders, str(last.created_at), last.order_id, 20).collect()
    assert [r.order_id for r in after] == [r.order_id for r in second]


@pytest.fixture(scope="module")
def events(spark):
    day = dt.date
    return spark.createDataFrame(
        [(1, "percent", Decimal(10), day(2001, 6, 15), day(2001, 6, 15), 0, []),
         (2, "amount", Decimal(500), day(2001, 1, 1), day(2001, 12, 31), 150, ["a"]),
         (3, "percent", Decimal(150), day(2001, 1, 1), day(2001, 12, 31), 0, None),
         (4, "percent", Decimal(10), day(2001, 6, 16), day(2001, 12, 31), 0, [])],
        "coupon_event_id bigint, discount_type string, discount_value decimal(10,2), start_date date, end_date date, "
        "min_order_amount bigint, applicable_categories array<string>")


@pytest.fixture(scope="module")
def claims(spark):
    return spark.createDataFrame([(e * 10, 1, e, False) for e in (1, 2, 3, 4)] + [(50, 1, 1, True), (60, 2, 1, False)],
                                 "claim_id bigint, user_id bigint, coupon_event_id bigint, is_used boolean")


@pytest.mark.parametrize("lines, claim, expected", [
    ([1, 2], None, (None, 300, 0, 300, None)),
    ([1, 2], 10, (None, 300, 30, 270, 10)),
    ([1, 2], 20, (None, 300, 300, 0, 20)),
    ([1], 20, (None, 100, 0, 100, None)),          # below the minimum
    ([2, 4], 20, (None, 600, 0, 600, None)),       # no line of the category
    ([1], 30, (None, 100, 150, 0, 30)),            # over a hundred percent
    ([1], 40, (None, 100, 0, 100, None)),          # not begun
    ([1], 50, (None, 100, 0, 100, None)),          # used
    ([1], 60, (None, 100, 0, 100, None)),          # someone else's
    ([1], 99, (None, 100, 0, 100, None)),
    ([1, 1], 10, ("invalid_products", None, None, None, None)),
    ([1, 3], 10, ("invalid_products", None, None, None, None)),
    ([1, 77], 10, ("invalid_products", None, None, None, None)),
    ([], 10, ("no_products", None, None, None, None))])
def test_price_orders(spark, events, claims, lines, claim, expected):
    products = spark.createDataFrame([(1, 100, "a", True), (2, 200, "b", True), (3, 1, "a", False),
                                      (4, 400, "c", True)],
                                     "product_id bigint, price bigint, category string, is_active boolean")
    requests = spark.createDataFrame([(1, 1, claim, DAY)], "request_id bigint, user_id bigint, claim_id bigint, created_at timestamp_ntz")
    asked = spark.createDataFrame([(1, p) for p in lines], "request_id bigint, product_id bigint")
    row = coupons.price_orders(requests, asked, products, claims, events).first()
    assert (row.reject_reason, row.total_amount, row.discount_amount, row.final_amount, row.claim_id) == expected


@pytest.mark.parametrize("claim, amount, categories, reason, discount", [
    (10, 999, [], None, 99), (None, 999, [], "missing_input", None), (10, 0, [], "missing_input", None),
    (40, 999, [], "unusable", None), (20, 149, ["a"], "below_minimum", None), (20, 150, ["a"], None, 150),
    (20, 999, ["b"], "category_mismatch", None), (20, 999, [], None, 500), (20, 999, None, None, 500)])
def test_quote_coupons(spark, events, claims, claim, amount, categories, reason, discount):
    requests = spark.createDataFrame([(1, 1, claim, amount, categories, DAY)],
                                     "request_id bigint, user_id bigint, claim_id bigint, amount bigint, "
                                     "categories array<string>, created_at timestamp_ntz")
    row = coupons.quote_coupons(requests, claims, events).first()
    assert (row.reject_reason, row.discount) == (reason, discount)


def test_claims_are_granted_once(spark, events):
    wanted = spark.createDataFrame(
        [(1, 1, 1, DAY + dt.timedelta(hours=1)), (2, 1, 1, DAY), (3, 1, 2, DAY), (4, 1, 4, DAY), (5, 1, 9, DAY), (6, 2, 1, DAY)],
        "request_id bigint, user_id bigint, coupon_event_id bigint, created_at timestamp_ntz")
    held = spark.createDataFrame([(1, 2)], "user_id bigint, coupon_event_id bigint")
    outcome = {r.request_id: r.outcome for r in coupons.claim_coupons(wanted, events, held).collect()}
    assert outcome == {1: "already_claimed", 2: "granted", 3: "already_claimed", 4: "not_running", 5: "not_running", 6: "granted"}


def test_link_identities(spark):
    users = spark.createDataFrame([(1, "g", "1", "a@x"), (2, "local", None, "b@x"), (3, "k", "9", "c@x")],
                                  "user_id bigint, provider string, provider_id string, email string")
    profiles = spark.createDataFrame(
        [(1, "g", "1", "other@x"), (2, "g", "2", "b@x"), (3, "k", "3", "b@x"), (4, "g", "4", "c@x"), (5, "g", "5", None),
         (6, "g", "6", "new@x"), (7, "k", "7", "new@x")], "profile_no bigint, provider string, provider_id string, email string")
    found = {r.profile_no: (r.action, r.user_id, r.email) for r in joins.link_identities(profiles, users).collect()}
    assert found == {1: ("match", 1, "other@x"), 2: ("link", 2, "b@x"), 3: ("match", 2, "b@x"), 4: ("match", 3, "c@x"),
                     5: ("create", None, "g_5@shop.invalid"), 6: ("create", None, "new@x"), 7: ("join", None, "new@x")}


def test_reconciliation(spark):
    orders = spark.createDataFrame([(i, 10) for i in range(1, 7)], "order_id bigint, final_amount bigint")
    feed = [(1, 10, "PAID"), (2, 11, "PAID"), (3, 10, "FAILED"), (5, 10, "PAID"), (5, 10, "PAID"), (6, 10, "PAID"), (6, 12, "PAID"), (9, 10, "PAID")]
    payments = spark.createDataFrame([(o, a, s) for o, a, s in feed], "order_id bigint, amount bigint, payment_status string")
    found = {r.order_id: r.result for r in joins.reconcile_payments(orders, payments).collect()}
    assert found == {1: "ok", 2: "mismatch", 3: "unpaid", 4: "missing_payment", 5: "duplicate", 6: "mismatch", 9: "missing_order"}


def test_manual_grades_and_inactive_users(spark):
    users = spark.createDataFrame([(1, True, "vip"), (2, False, None), (3, True, None)],
                                  "user_id bigint, is_active boolean, manual_grade string")
    orders = spark.createDataFrame([(3, "paid", 60_000, DAY), (3, "refunded", 1, DAY), (2, "pending", 5, DAY)],
                                   "user_id bigint, status string, final_amount bigint, paid_at timestamp_ntz")
    by_hand = {r.user_id: r.grade for r in customers.customer_grades(users, orders, "2001-06-30").collect()}
    computed = customers.customer_grades(users, orders, "2001-06-30", honour_manual=False)
    assert by_hand == {1: "vip", 2: "new", 3: "regular"}
    assert {r.user_id: (r.grade, r.refund_count) for r in computed.collect()} == {1: ("new", 0), 3: ("regular", 1)}
    spread = customers.grade_distribution(computed).first()
    assert (spread.total, spread.new, spread.mid, spread.vvip) == (2, 1, 1, 0)


def test_sales_chart_fills_gaps(spark):
    orders = spark.createDataFrame([("paid", 50, dt.datetime(2001, 6, 28)), ("paid", 200, dt.datetime(2001, 6, 30, 23)),
                                    ("pending", 9, dt.datetime(2001, 6, 29)), ("paid", 9, dt.datetime(2001, 7, 1))],
                                   "status string, final_amount bigint, paid_at timestamp_ntz")
    chart = {r.label: (r.order_count, r.relative, r.is_today) for r in reports.daily_sales_filled(orders, "2001-06-30").collect()}
    assert len(chart) == 7
    assert chart["6/28"] == (1, 0.25, False) and chart["6/30"] == (1, 1.0, True) and chart["6/24"] == (0, 0.0, False)
    empty = reports.daily_sales_filled(orders.filter("status = 'none'"), "2001-06-30").collect()
    assert len(empty) == 7 and all(r.relative == 0 for r in empty)


def test_item_settlement_adds_up(shop):
    """Active and refunded sums are all item sums of the settled orders."""
    report = reports.settlement_by_product(shop.items, shop.orders, shop.products, "1990-01-01", "2010-01-01")
    whole = report.agg(F.sum(F.col("gross") + F.col("refund_amount")), F.sum(F.col("sale_count") + F.col("refund_count"))).first()
    lines = shop.items.join(shop.orders.filter("status <> 'pending'").select("order_id"), "order_id")
    assert tuple(whole) == tuple(lines.agg(F.sum("price"), F.count(F.lit(1))).first())


def test_dashboard_parts_agree(shop):
    parts = reports.dashboard(shop.orders, shop.users, shop.items, shop.products, shop.inquiries, "2001-06-30")
    kpis = parts["kpis"].first()
    today = reports.day_kpi(shop.orders, "2001-06-30").first()
    month = reports.month_kpi(shop.orders, "2001-06-30").first()
    assert (kpis.today_count, kpis.today_amount) == tuple(today) and (kpis.month_count, kpis.month_amount) == tuple(month)
    assert kpis.pending == reports.pending_count(shop.orders).first()[0]


def test_rules_and_quarantine(spark):
    rows = spark.createDataFrame([(1, 5, "long enough text"), (2, 6, "short"), (3, None, "   "), (4, 1, "x" * 1001), (5, 1, " " * 20 + "123456789")],
                                 "product_id bigint, rating int, content string")
    checked = quality.validate_rows(rows, quality.review_rules())
    assert {r.product_id: list(r.reasons) for r in checked.collect()} == {
        1: [], 2: ["rating_range", "too_short"], 3: ["missing"], 4: ["too_long"], 5: ["too_short"]}
    valid, broken = quality.quarantine(checked)
    assert ids(valid, "product_id") == [1] and ids(broken, "product_id") == [2, 3, 4, 5]


def test_fingerprint_and_event_rules(spark):
    prints = spark.createDataFrame([("ok",), ("",), (None,), ("y" * 101,)], "fingerprint string")
    got = [list(r.reasons) for r in quality.validate_rows(prints, quality.fingerprint_rules()).collect()]
    assert got == [[], ["missing"], ["missing"], ["too_long"]]
    day = dt.date
    rows = spark.createDataFrame(
        [("a", "percent", Decimal(5), day(2024, 1, 1), day(2024, 1, 1)), ("", "percent", Decimal(5), day(2024, 1, 1), day(2024, 1, 2)),
         ("b", "half", Decimal(5), day(2024, 1, 2), day(2024, 1, 1))],
        "name string, discount_type string, discount_value decimal(10,2), start_date date, end_date date")
    got = [list(r.reasons) for r in quality.validate_rows(rows, quality.coupon_event_rules()).collect()]
    assert got == [[], ["missing"], ["discount_type", "window"]]


def test_keys_and_references(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,), (9,), (9,)], "k bigint")
    parent = spark.createDataFrame([(1,), (2,)], "id bigint")
    report = quality.check_foreign_keys({"c.p": (child, "k", parent, "id")}).first()
    assert tuple(report) == ("c.p", 1, 2)
    assert tuple(quality.check_unique({"c": (child.dropna(), ["k"])}).first()) == ("c", 2, 2)


def test_drift_report(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    report = quality.schema_drift(df, StructType.fromDDL("a bigint, b string, c date")).collect()
    assert [(r.column_name, r.state, r.non_null_rows) for r in report] == [("a", "retyped", 2), ("b", "ok", 1), ("c", "missing", 0)]
