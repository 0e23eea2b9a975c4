"""State changes: outcomes at the edges, and running a change again."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import catalog, changes, coupons

AT = dt.datetime(2024, 1, 1, 12)


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


ORDER_SCHEMA = ("order_id bigint, user_id bigint, status string, final_amount bigint, payment_key string, "
                "payment_method string, pg_provider string, paid_at timestamp_ntz, claim_id bigint")
PAYMENT_SCHEMA = ("payment_id string, order_id bigint, amount bigint, payment_status string, method string, "
                  "provider string, paid_at timestamp_ntz")


@pytest.fixture(scope="module")
def orders(spark):
    def row(order_id, status, amount, claim=None):
        return order_id, order_id * 10, status, amount, None, None, None, None, claim
    return spark.createDataFrame([row(1, "pending", 100, 7), row(2, "pending", 200), row(3, "pending", 300),
                                  row(4, "paid", 400), row(5, "pending", 500), row(6, "pending", 600)], ORDER_SCHEMA)


@pytest.fixture(scope="module")
def payments(spark):
    def row(payment_id, order_id, amount, status, minute=0):
        return payment_id, order_id, amount, status, "PaymentMethodCard", None, AT + dt.timedelta(minutes=minute)
    return spark.createDataFrame([
        row("late", 1, 100, "PAID", 5), row("early", 1, 100, "PAID", 1), row("wrong", 2, 201, "PAID"),
        row("failed", 3, 300, "FAILED"), row("again", 4, 400, "PAID"), row("waits", 5, 500, "VIRTUAL_ACCOUNT_ISSUED"),
        row("lost", 99, 1, "PAID")], PAYMENT_SCHEMA)


def test_payments(orders, payments):
    paid = changes.apply_payments(orders, payments)
    assert tuples(paid, "order_id", "status", "payment_key", "payment_method", "pg_provider", "newly_paid") == sorted([
        (1, "paid", "early", "Card", "portone", True), (2, "pending", None, None, None, False),
        (3, "pending", None, None, None, False), (4, "paid", None, None, None, False),
        (5, "vbank_pending", "waits", None, "portone", False), (6, "pending", None, None, None, False)], key=repr)


def test_payments_again_change_nothing(orders, payments):
    once = changes.apply_payments(orders, payments).drop("newly_paid")
    twice = changes.apply_payments(once, payments)
    assert twice.filter("newly_paid").count() == 0
    assert tuples(twice.drop("newly_paid"), *sorted(once.columns)) == tuples(once, *sorted(once.columns))


def test_payment_effects(spark, orders, payments):
    paid = changes.apply_payments(orders, payments)
    items = spark.createDataFrame([(1, 50), (1, 51), (1, 50), (2, 52)], "order_id bigint, product_id bigint")
    held = spark.createDataFrame([(10, 51, 0)], "user_id bigint, product_id bigint, order_id bigint")
    granted = changes.grant_downloads(held, paid, items)
    assert tuples(granted, "user_id", "product_id", "order_id") == [(10, 50, 1), (10, 51, 0)]
    again = changes.grant_downloads(granted, paid, items)
    assert again.count() == 2
    cart = spark.createDataFrame([(10, 50), (10, 60), (20, 50)], "user_id bigint, product_id bigint")
    assert tuples(changes.clear_cart(cart, paid, items), "user_id", "product_id") == [(10, 60), (20, 50)]
    claims = spark.createDataFrame([(7, 10, False), (8, 10, False), (7, 11, False)], "claim_id bigint, user_id bigint, is_used boolean")
    assert tuples(changes.use_claims(claims, paid), "claim_id", "user_id", "is_used", "used_by_order") == sorted(
        [(7, 10, True, 1), (8, 10, False, None), (7, 11, False, None)], key=repr)


def test_refunds(spark):
    orders = spark.createDataFrame(
        [(1, "paid", 30), (2, "sent", 20), (3, "paid", 20), (4, "pending", 10), (5, "sent", 10), (6, "paid", 10), (7, "refund", 10),
         (8, "done", 10)], "order_id bigint, status string, final_amount int")
    items = spark.createDataFrame(
        [(1, 1, 10, "active"), (1, 2, 20, "active"), (2, 1, 10, "active"), (2, 2, 10, "refunded"), (3, 1, 5, "active"),
         (3, 2, 15, "active"), (4, 1, 10, "active"), (5, 1, 10, "active"), (6, 1, 10, "refunded"), (8, 1, 10, "active")],
        "order_id bigint, line_no int, price bigint, item_status string")
    refunds = spark.createDataFrame(
        [(1, 1, "admin"), (1, 1, "admin"), (2, None, "admin"), (3, None, "customer"), (4, None, "admin"), (5, None, "customer"),
         (6, 1, "admin"), (7, None, "admin"), (8, None, "admin")], "order_id bigint, line_no int, path string")
    accepted = changes.refund_requests(orders, refunds)
    assert tuples(accepted, "order_id", "whole", "by_customer") == [
        (1, False, False), (2, True, False), (3, True, True), (6, False, False)]
    after = changes.refund_items(items, accepted, refunds)
    assert tuples(after.filter("refunded_now"), "order_id", "line_no") == [(1, 1), (2, 1), (3, 1), (3, 2)]
    result = changes.refund_orders(orders, after, accepted)
    assert [(o, s, int(a)) for o, s, a in tuples(result, "order_id", "status", "refund_amount")] == [
        (1, "paid", 10), (2, "refund", 10), (3, "refund", 20), (4, "pending", 0), (5, "sent", 0), (6, "paid", 0),
        (7, "refund", 0), (8, "done", 0)]
    # Whatever is refunded, active and refunded amounts add up to the same total.
    total = lambda df: df.agg(F.sum("price")).first()[0]
    assert total(after) == total(items)
    rights = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "order_id bigint, user_id bigint")
    assert tuples(changes.revoke_downloads(rights, accepted), "order_id") == [(1,), (2,)]


def test_state_after_refund(spark):
    orders = spark.createDataFrame([(1, "paid"), (2, "paid"), (3, "paid")], "order_id bigint, status string")
    items = spark.createDataFrame([(1, "refunded"), (1, "active"), (2, "refunded")], "order_id bigint, item_status string")
    assert tuples(catalog.state_after_refund(orders, items), "order_id", "new_status") == [(1, "paid"), (2, "refund"), (3, "paid")]


@pytest.mark.parametrize("toggles, likes", [(1, {1: 1}), (2, {}), (3, {1: 1})])
def test_likes(spark, toggles, likes):
    log = spark.createDataFrame([(1, "f")] * toggles, "item_id bigint, fingerprint string")
    assert {r.item_id: r.likes for r in changes.like_counts(log).collect()} == likes


def test_likes_do_not_depend_on_order(spark):
    rng = random.Random(1)
    log = [(rng.randrange(4), str(rng.randrange(5))) for _ in range(200)]
    state = defaultdict(set)
    for item, who in log:
        state[item] ^= {who}
    rng.shuffle(log)
    df = spark.createDataFrame(log, "item_id bigint, fingerprint string")
    assert {r.item_id: r.likes for r in changes.like_counts(df).collect()} == {i: len(s) for i, s in state.items() if s}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k bigint, v string, seq bigint")
    new = spark.createDataFrame([(2, "c", 5), (2, "d", 9), (3, "e", 2)], "k bigint, v string, seq bigint")
    newest = [F.col("seq").desc()]
    once = changes.upsert_latest(old, new, ["k"], newest)
    assert tuples(once, "k", "v") == [(1, "a"), (2, "d"), (3, "e")]
    assert tuples(changes.upsert_latest(once, new, ["k"], newest), "k", "v", "seq") == tuples(once, "k", "v", "seq")


def test_insert_if_absent_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a")], "k bigint, v string")
    new = spark.createDataFrame([(1, "x"), (2, "z"), (2, "y")], "k bigint, v string")
    once = changes.insert_if_absent(old, new, ["k"], [F.col("v")])
    assert tuples(once, "k", "v") == [(1, "a"), (2, "y")]
    assert tuples(changes.insert_if_absent(once, new, ["k"], [F.col("v")]), "k", "v") == tuples(once, "k", "v")


def test_replace_children(spark):
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "p bigint, c bigint")
    new = spark.createDataFrame([(1, 9), (1, 9), (3, 3)], "p bigint, c bigint")
    parents = spark.createDataFrame([(1,)], "p bigint")
    once = changes.replace_children(links, parents, new, "p")
    assert tuples(once, "p", "c") == [(1, 9), (2, 1)]
    assert tuples(changes.replace_children(once, parents, new, "p"), "p", "c") == [(1, 9), (2, 1)]


def test_flags_and_positions(spark):
    rows = spark.createDataFrame([(1, True, 5), (2, False, 6), (3, True, 7)], "id bigint, is_active boolean, sort_order int")
    ids = spark.createDataFrame([(1,), (1,), (2,)], "id bigint")
    assert tuples(changes.soft_delete(rows, ids, "id"), "id", "is_active") == [(1, False), (2, False), (3, True)]
    assert tuples(changes.toggle_active(rows, ids, "id"), "id", "is_active") == [(1, True), (2, True), (3, True)]
    moves = spark.createDataFrame([(1, 9, 1), (1, 8, 2), (3, 1, 3)], "id bigint, position int, seq bigint")
    assert tuples(changes.bulk_reorder(rows, moves, "id"), "id", "sort_order") == [(1, 8), (2, 6), (3, 1)]


def test_cascades(spark):
    children = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "c bigint, p bigint")
    gone = spark.createDataFrame([(10,)], "p bigint")
    assert tuples(changes.cascade_delete(children, gone, "p"), "c") == [(2,), (3,)]
    assert tuples(changes.set_null_on_delete(children, gone, "p"), "c", "p") == sorted([(1, None), (2, 20), (3, None)], key=repr)


def test_dormancy(spark):
    users = spark.createDataFrame([(1, True, False), (2, True, False), (3, False, False), (4, True, True), (5, True, True), (6, True, False)],
                                  "user_id bigint, is_active boolean, is_dormant boolean")
    logins = spark.createDataFrame(
        [(1, dt.datetime(2023, 2, 27)), (2, dt.datetime(2023, 2, 28)), (3, dt.datetime(2020, 1, 1)), (4, dt.datetime(2024, 1, 1)),
         (1, dt.datetime(2024, 6, 1))], "user_id bigint, created_at timestamp_ntz")
    got = tuples(changes.flag_dormant(users, logins, "2024-02-29"), "user_id", "is_dormant")
    assert got == [(1, True), (2, False), (3, False), (4, False), (5, True), (6, False)]


def test_account_actions(spark):
    users = spark.createDataFrame([(u, True, False) for u in range(1, 5)], "user_id bigint, is_active boolean, is_dormant boolean")
    actions = spark.createDataFrame(
        [(1, 1, "suspend", AT), (2, 2, "suspend", AT), (3, 2, "restore", AT), (4, 3, "deactivate", AT), (5, 4, "ban", AT)],
        "action_id bigint, user_id bigint, action string, created_at timestamp_ntz")
    got = tuples(changes.account_actions(users, actions), "user_id", "is_active", "is_dormant", "dormant_at")
    assert got == [(1, True, True, AT), (2, True, False, None), (3, False, False, None), (4, True, False, None)]
    assert tuples(changes.rejected_actions(actions), "action") == [("ban",)]


def test_counters_and_rewards(spark):
    base = spark.createDataFrame([(1, None), (2, 5)], "id bigint, view_count bigint")
    events = spark.createDataFrame([(2, AT), (2, AT), (9, AT)], "id bigint, created_at timestamp_ntz")
    assert tuples(changes.add_counters(base, events, "id", "view_count"), "id", "view_count", "last_at") == [(1, 0, None), (2, 7, AT)]
    reviews = spark.createDataFrame([(4, 1, AT)], "review_id bigint, user_id bigint, created_at timestamp_ntz")
    assert tuples(changes.review_rewards(reviews, 500), "user_id", "type", "amount", "entry_id") == [(1, "earn_review", 500, 4)]


def test_second_runs_and_own_columns_keep_their_values(spark):
    claims = spark.createDataFrame([(1, 7, False)], "claim_id long, user_id long, is_used boolean")
    paid = spark.createDataFrame([(70, 7, 1, True)], "order_id long, user_id long, claim_id long, newly_paid boolean")
    once = changes.use_claims(claims, paid)
    assert [r.used_by_order for r in changes.use_claims(once, paid).collect()] == [70]

    day = dt.datetime
    users = spark.createDataFrame(
        [(1, True, True, day(2020, 5, 1), day(2020, 4, 1)), (2, True, False, None, day(2018, 1, 1)), (3, True, True, day(2020, 1, 1), None)],
        "user_id long, is_active boolean, is_dormant boolean, dormant_at timestamp_ntz, last_login_at timestamp_ntz")
    logins = spark.createDataFrame([(3, day(2020, 3, 1))], "user_id long, created_at timestamp_ntz")
    flagged = changes.flag_dormant(users, logins, "2020-06-01")
    found = {r.user_id: (r.is_dormant, r.dormant_at) for r in flagged.collect()}
    assert found == {1: (True, day(2020, 5, 1)), 2: (True, day(2020, 6, 1)), 3: (False, None)}
    again = {r.user_id: (r.is_dormant, r.dormant_at) for r in changes.flag_dormant(flagged, logins, "2020-06-01").collect()}
    assert again == found
    none = spark.createDataFrame([], "user_id long, action string, created_at timestamp_ntz, action_id long")
    assert {r.user_id: r.dormant_at for r in changes.account_actions(users, none).collect()} == {1: day(2020, 5, 1), 2: None, 3: day(2020, 1, 1)}


def test_keys_may_be_strings(spark):
    from tallyhouse.operators import quality

    child = spark.createDataFrame([("a1",), ("zz",)], "k string")
    parent = spark.createDataFrame([("a1",), ("b2",)], "id string")
    assert [tuple(r) for r in quality.orphans(child, "k", parent, "id").collect()] == [("zz", 1)]
    links = spark.createDataFrame([("a1", "x")], "id string, other string")
    assert sorted(tuple(r) for r in catalog.linked_ids(parent, links, "id", "other").collect()) == [("a1", "x"), ("b2", None)]


def test_each_refund_wish_is_judged_by_itself(spark):
    orders = spark.createDataFrame([(1, "sent", "k"), (2, "paid", "k"), (3, "paid", None)], "order_id bigint, status string, payment_key string")
    wishes = spark.createDataFrame([(1, 1, "admin"), (1, 2, "customer"), (2, 1, "customer"), (3, None, "admin")],
                                   "order_id bigint, line_no int, path string")
    items = spark.createDataFrame([(o, n, "active", 5) for o in (1, 2, 3) for n in (1, 2)],
                                  "order_id bigint, line_no int, item_status string, price bigint")
    accepted = changes.refund_requests(orders, wishes)
    assert sorted(map(tuple, accepted.collect())) == [(1, False, False), (2, True, True)]
    done = changes.refund_items(items, accepted, wishes).filter("refunded_now")
    assert sorted((r.order_id, r.line_no) for r in done.collect()) == [(1, 1), (2, 1), (2, 2)]


def test_placed_orders_go_on_to_payment(shop):
    priced = coupons.price_orders(shop.requests, shop.request_lines, shop.products, shop.claims, shop.coupon_events).persist()
    orders, items = coupons.placed_orders(priced), coupons.placed_items(priced, shop.request_lines, shop.products)
    assert orders.count() == priced.filter("reject_reason IS NULL").count() > 0
    sums = items.groupBy("order_id").agg(F.sum("price").alias("summed"), F.count("*").alias("n"), F.countDistinct("product_id").alias("d"))
    both = orders.join(sums, "order_id", "left")
    assert both.filter("summed IS NULL OR summed <> total_amount OR n <> d").isEmpty()
    paid = orders.withColumn("newly_paid", F.lit(True)).withColumn("order_status", F.lit("paid"))
    rights = changes.grant_downloads(shop.downloads.limit(0), paid, items)
    assert rights.count() == items.join(orders.select("order_id", "user_id"), "order_id").select("user_id", "product_id").distinct().count()
    priced.unpersist()
