"""Scalar rules at their boundaries, on hand-written rows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import customer, dates, money, text


def values(spark, rows, schema, expression):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expression).collect()]


@pytest.mark.parametrize("orders, month, manual, expected", [
    (0, 0, None, "new"), (0, 999, None, "new"), (1, 0, None, "sprout"), (1, 50_000, None, "sprout"),
    (1, 50_001, None, "regular"), (1, 300_000, None, "regular"), (1, 300_001, None, "vip"),
    (1, 1_000_000, None, "vip"), (1, 1_000_001, None, "vvip"), (1, 1_000_001, "blacklist", "blacklist"),
    (0, 0, "vip", "vip"), (1, 10, "", "sprout")])
def test_grade(spark, orders, month, manual, expected):
    got = values(spark, [(orders, month, manual)], "o bigint, m bigint, g string",
                 customer.grade(F.col("o"), F.col("m"), manual=F.col("g")))
    assert got == [expected]


def test_grade_limits_must_ascend():
    with pytest.raises(ValueError):
        customer.GradeLimits(10, 10, 20)
    with pytest.raises(ValueError):
        customer.GradeLimits(0, 10, 20)


def test_days_and_risk(spark):
    at = dt.datetime(2001, 6, 30, 12, 0, 0)
    rows = [(at - dt.timedelta(days=d, seconds=s),) for d, s in
            [(0, 0), (0, 86399), (30, 86399), (31, 0), (90, 86399), (91, 0)]] + [(None,)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    days = dates.whole_days_between(F.col("t"), at)
    got = df.select(days.alias("d")).withColumn(
        "r", customer.recency_risk(F.when(F.col("d").isNull(), 0).otherwise(1), F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(0, "safe"), (0, "safe"), (30, "safe"), (31, "mid"), (90, "mid"), (91, "high"),
                                       (None, "none")]


def test_account_state(spark):
    got = values(spark, [(False, True), (True, True), (True, False)], "a boolean, d boolean",
                 customer.account_state(F.col("a"), F.col("d")))
    assert got == ["inactive", "dormant", "normal"]


@pytest.mark.parametrize("kind, value, total, expected", [
    ("percent", "7", "19900", 1393), ("percent", "12.50", "99900", 12487), ("percent", "120", "100", 120),
    ("amount", "500", "400", 400), ("fixed", "500", "900", 500), ("percent", "0", "900", 0)])
def test_discount_and_final_amount(spark, kind, value, total, expected):
    df = spark.createDataFrame([(kind, Decimal(value), int(total))], "k string, v decimal(10,2), t bigint")
    discount = money.coupon_discount(F.col("k"), F.col("v"), F.col("t"))
    row = df.select(discount.alias("d"), money.final_amount(F.col("t"), discount).alias("f")).first()
    assert row.d == expected and row.f == max(0, int(total) - expected)


def test_masked_name(spark):
    got = values(spark, [("a",), ("ab",), ("abcd",), ("abcdefg",), ("김민준",), (None,), ("",)], "n string",
                 text.masked_name(F.col("n")))
    assert got == ["a***", "a*", "a***", "a***", "김**", "익*", "익*"]


def test_mean_follows_the_binary_quotient(spark):
    pairs = [(total, count) for count in range(1, 41) for total in range(count, 5 * count + 1)]
    got = spark.createDataFrame(pairs, "s bigint, n bigint").select(
        "s", "n", money.one_decimal_mean(F.col("s"), F.col("n")).alias("m")).collect()
    for s, n, shown in got:
        exact = Decimal(s / n)  # the double's own value
        expected = exact.quantize(Decimal("0.1"), rounding="ROUND_HALF_UP")
        assert shown == str(expected), (s, n)


def test_prices_and_badges(spark):
    df = spark.createDataFrame([(0, None, True, True), (100, None, False, True), (100, 0, False, False), (100, 80, True, False)],
                               "p int, d int, n boolean, b boolean")
    got = df.select(money.shown_price(money.money(F.col("p")), money.money(F.col("d"))).alias("s"),
                    money.badge(F.col("n"), F.col("b")).alias("b")).collect()
    assert [(r.s and int(r.s), r.b) for r in got] == [(None, "NEW"), (100, "BEST"), (100, "ON SALE"), (80, "NEW")]


def test_usd(spark):
    got = values(spark, [(1350,), (19900,), (7,), (0,)], "a bigint",
                 money.in_usd(F.col("a")))
    assert got == [Decimal("1.00"), Decimal("14.74"), Decimal("0.01"), Decimal("0.00")]


def test_searches_differ_on_wildcards(spark):
    names = [("50% off_now",), ("50 OFF now",), (None,), ("it's \"quoted\"",)]
    wild = values(spark, names, "n string", text.contains_wild(F.col("n"), "0_off"))
    literal = values(spark, names, "n string", text.contains_literal(F.col("n"), "OFF_"))
    quoted = values(spark, names, "n string", text.contains_literal(F.col("n"), "'s \"Q"))
    assert wild == [False, True, False, False]
    assert literal == [True, False, False, False]
    assert quoted == [False, False, False, True]


def test_trim_and_length(spark):
    got = spark.createDataFrame([(" \t a b 　\n",), ("😀x",), ("",)], "t string").select(
        text.trimmed(F.col("t")).alias("t"), text.utf16_length(text.trimmed(F.col("t"))).alias("n")).collect()
    assert [(r.t, r.n) for r in got] == [("a b", 3), ("😀x", 3), ("", 0)]


def test_text_keys(spark):
    df = spark.createDataFrame([(" ab ", "x.y", "010", "12", "34"), ("", "x.y", "010", " ", "34")],
                               "a string, d string, p string, q string, r string")
    got = df.select(text.email_address(F.col("a"), F.col("d")),
                    text.phone_number(F.col("p"), F.col("q"), F.col("r")), text.digits_only(F.lit("a1-2"))).collect()
    assert [tuple(r) for r in got] == [("ab@x.y", "010-12-34", "12"), ("", "", "12")]


def test_login_id(spark):
    got = values(spark, [("ab1",), ("ab",), ("1ab",), ("a" * 20,), ("a" * 21,), ("ab_",)], "i string",
                 text.is_login_id(F.col("i")))
    assert got == [True, False, False, True, False, False]


def test_payment_names(spark):
    df = spark.createDataFrame([("PaymentMethodCard", None), ("PaymentMethod", ""), (None, "kakao"),
                                ("xPaymentMethodPaymentMethod", "a")], "m string, p string")
    got = df.select(text.clean_payment_method(F.col("m")), text.payment_provider(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("Card", "portone"), ("UNKNOWN", "portone"), ("UNKNOWN", "kakao"), ("xPaymentMethod", "a")]


def test_inquiry_codes(spark):
    got = values(spark, [("주문 / 결제 문의",), ("맞춤 제작 문의",), ("?",), (None,)], "c string", text.inquiry_code(F.col("c")))
    assert got == ["refund", "custom", "etc", "etc"]


def test_category_rule(spark):
    rows = [(None, ["a"]), ([], ["a"]), (["a"], ["a", "b"]), (["a"], ["b"]), (["a"], []), (["a"], None)]
    got = values(spark, rows, "l array<string>, g array<string>", text.categories_allowed(F.col("l"), F.col("g")))
    assert got == [True, True, True, False, False, False]


@pytest.mark.parametrize("as_of, start, following, last", [
    ("2024-02-29", (2024, 2, 1), (2024, 3, 1), (2024, 2, 29)),
    ("2023-12-31 23:59:59", (2023, 12, 1), (2024, 1, 1), (2023, 12, 31)),
    ("2024-01-31", (2024, 1, 1), (2024, 2, 1), (2024, 1, 31))])
def test_month_bounds(as_of, start, following, last):
    assert dates.month_start(as_of) == dt.datetime(*start)
    assert dates.next_month(as_of) == dt.datetime(*following)
    assert dates.month_end_day(as_of) == dt.date(*last)


def test_ranges_are_half_open(spark):
    rows = [(dt.datetime(2001, 6, 30, 23, 59, 59, 999999),), (dt.datetime(2001, 7, 1),), (dt.datetime(2001, 6, 1),),
            (dt.datetime(2001, 5, 31, 23, 59, 59),)]
    got = values(spark, rows, "t timestamp_ntz", dates.in_days(F.col("t"), "2001-06-01", "2001-06-30"))
    assert got == [True, False, True, False]


def test_date_filters_reach_the_scan(shop):
    plan = shop.orders.filter(dates.in_days(F.col("paid_at"), "2001-06-01", "2001-06-30")) \
        .select("order_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "o_totalprice" not in plan
