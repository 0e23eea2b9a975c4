"""Order histories and deletions against sequential code, and change jobs on their own output."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import changes, history, joins, quality, references
from tallyhouse.operators.references import Reference

START = dt.datetime(2024, 1, 1)
EVENTS = ("event_id string, order_id bigint, user_id bigint, kind string, amount bigint, payment_key string, method string, "
          "provider string, line_no int, at timestamp_ntz")


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# Histories

def history_rows(seed):
    rng = random.Random(seed)
    orders = [(o, o % 4, 100 * (o % 3 + 1), o % 5 if o % 2 else None) for o in range(40)]
    items = [(o, line, 10 * line + o) for o in range(38) for line in range(1, rng.randrange(1, 4) + 1)]
    kinds = ["paid", "paid", "capture", "confirm", "virtual_account", "customer_refund", "admin_refund", "admin_refund", "failed"]
    events = []
    for n in range(260):
        o = rng.randrange(42)
        kind = rng.choice(kinds)
        line = rng.choice([None, 1, 2, 3, 9]) if kind == "admin_refund" else None
        amount = rng.choice([100 * (o % 3 + 1)] * 3 + [1, None]) if kind == "paid" else None
        key = None if kind == "confirm" and n % 4 == 0 else f"k{n}"
        events.append((f"e{n:03}", o, o % 4 if rng.random() < 0.9 else 3, kind, amount, key, rng.choice(["PaymentMethodCard", "CARD", None]),
                       rng.choice(["kakao", None]), line, START + dt.timedelta(minutes=rng.randrange(60))))
    return orders, items, events


def history_by_hand(orders, items, events):
    """One event after the other, in the order of their time."""
    state = {o: {"status": "pending", "user": u, "amount": a, "key": None, "method": None, "provider": None, "paid_at": None, "by": None, "waits": None}
             for o, u, a, _ in orders}
    lines = {(o, line): None for o, line, _ in items}
    for event_id, o, u, kind, amount, key, method, provider, line, at in sorted(events, key=lambda e: (e[9], e[0])):
        s = state.get(o)
        if s is None or kind == "failed":
            continue
        if kind in ("paid", "capture", "confirm") and s["status"] in ("pending", "vbank_pending") and u == s["user"] \
                and (kind != "paid" or amount == s["amount"]):
            method = {"paid": (method or "").replace("PaymentMethod", "") or "UNKNOWN", "capture": "PAYPAL", "confirm": method}[kind]
            s.update(status="paid", key=key, method=method, paid_at=at,
                     provider={"paid": provider or "portone", "capture": "paypal", "confirm": None}[kind])
        elif kind == "virtual_account" and s["status"] == "pending" and u == s["user"]:
            s.update(status="vbank_pending", key=key, provider=provider or "portone")
        elif kind == "customer_refund" and s["status"] == "paid" and u == s["user"] and s["key"] is not None:
            for k in lines:
                if k[0] == o and lines[k] is None:
                    lines[k] = at
            s.update(status="refund", by="customer")
        elif kind == "admin_refund" and s["status"] == "paid" and s["key"] is not None:
            for k in lines:
                if k[0] == o and lines[k] is None and (line is None or line == k[1]):
                    lines[k] = at
            mine = [v for k, v in lines.items() if k[0] == o]
            if mine and None not in mine:
                s.update(status="refund", by="admin")
    price = {(o, line): p for o, line, p in items}
    found = [(o, s["status"], s["key"], s["method"], s["provider"], s["paid_at"],
              sum(price[k] for k, v in lines.items() if k[0] == o and v is not None), s["by"]) for o, s in state.items()]
    return sorted(found, key=repr), sorted(((*k, v) for k, v in lines.items()), key=repr)


COLUMNS = ("order_id", "status", "payment_key", "payment_method", "pg_provider", "paid_at", "refund_amount", "refunded_by")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_order_of_arrival_gives_the_sequential_outcome(spark, seed):
    orders, items, events = history_rows(seed)
    want_orders, want_lines = history_by_hand(orders, items, events)
    mixed = events + random.Random(seed).sample(events, 60)
    random.Random(seed).shuffle(mixed)
    states, lines = history.fold(spark.createDataFrame(orders, "order_id bigint, user_id bigint, final_amount bigint, coupon_id bigint"),
                                 spark.createDataFrame(items, "order_id bigint, line_no int, price bigint"), spark.createDataFrame(mixed, EVENTS))
    assert [(*r[:6], int(r[6]), r[7]) for r in tuples(states, *COLUMNS)] == want_orders
    assert tuples(lines, "order_id", "line_no", "refunded_at") == want_lines
    assert {r[1] for r in want_orders} == {"paid", "pending", "vbank_pending", "refund"}


def test_an_order_history_folded_again_is_the_same(spark):
    orders, items, events = history_rows(4)
    start = spark.createDataFrame(orders, "order_id bigint, user_id bigint, final_amount bigint, coupon_id bigint")
    lines, feed = spark.createDataFrame(items, "order_id bigint, line_no int, price bigint"), spark.createDataFrame(events, EVENTS)
    once, _ = history.fold(start, lines, feed)
    again, _ = history.fold(once.drop("refund_amount", "refunded_by"), lines, feed)
    assert tuples(again, *COLUMNS) == tuples(once, *COLUMNS)


def test_both_kinds_of_coupons_are_used(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    orders = spark.createDataFrame([(1, 10, 5, 70, at(3)), (2, 10, 5, 71, at(1)), (3, 10, 6, 70, None), (4, 11, 5, None, at(2))],
                                   "order_id bigint, user_id bigint, coupon_id bigint, claim_id bigint, paid_at timestamp_ntz")
    coupons = spark.createDataFrame([(10, 5, False), (10, 6, False), (11, 5, True), (12, 5, False)], "user_id bigint, coupon_id bigint, is_used boolean")
    used = history.use_coupons(coupons, orders, "coupon_id")
    assert tuples(used, "user_id", "coupon_id", "is_used", "used_at") == sorted(
        [(10, 5, True, at(1)), (10, 6, False, None), (11, 5, True, None), (12, 5, False, None)], key=repr)
    assert tuples(history.use_coupons(used, orders, "coupon_id"), *used.columns) == tuples(used, *used.columns)
    claims = spark.createDataFrame([(70, 10, False), (71, 10, False), (71, 12, False)], "claim_id bigint, user_id bigint, is_used boolean")
    used = history.use_coupons(claims, orders, "claim_id", "order_id")
    assert tuples(used, "claim_id", "user_id", "is_used", "used_at", "order_id") == sorted(
        [(70, 10, True, at(3), 1), (71, 10, True, at(1), 2), (71, 12, False, None, None)], key=repr)


# Deletions

GRAPH = [Reference("b", "a_id", "a", "cascade"), Reference("c", "b_id", "b", "cascade"), Reference("c", "a_id", "a", "null"),
         Reference("d", "b_id", "b", "keep"), Reference("d", "c_id", "c", "cascade"), Reference("e", "d_id", "d", "keep"), Reference("e", "a_id", "a", "cascade")]


def deletion_by_hand(tables, wishes):
    """Wish by wish refused until all that are left can be carried out together."""
    left = {t: set(w) & {r["id"] for r in tables[t]} for t, w in wishes.items()}
    while True:
        gone = {t: set(left.get(t, ())) for t in tables}
        while True:
            more = {(r.child, row["id"]) for r in GRAPH if r.on_delete == "cascade" for row in tables[r.child]
                    if row[r.column] in gone[r.parent] and row["id"] not in gone[r.child]}
            if not more:
                break
            for t, k in more:
                gone[t].add(k)
        stuck = {t: set() for t in tables}
        while True:
            more = {(r.parent, row[r.column]) for r in GRAPH for row in tables[r.child]
                    if row[r.column] in gone[r.parent] and row[r.column] not in stuck[r.parent]
                    and (r.on_delete == "keep" and row["id"] not in gone[r.child] or r.on_delete == "cascade" and row["id"] in stuck[r.child])}
            if not more:
                break
            for t, k in more:
                stuck[t].add(k)
        new = {t: w - stuck[t] for t, w in left.items()}
        if new == left:
            break
        left = new
    out = {}
    for t, rows in tables.items():
        lost = {r.column: gone[r.parent] for r in GRAPH if r.child == t and r.on_delete == "null"}
        out[t] = sorted((tuple(None if v in lost.get(c, ()) else v for c, v in row.items()) for row in rows if row["id"] not in gone[t]), key=repr)
    return out, {t: sorted(set(w) - left[t]) for t, w in wishes.items()}


@pytest.mark.parametrize("seed", range(4))
def test_deletions_equal_brute_force_and_leave_no_orphan(spark, seed):
    rng = random.Random(seed)
    n = {"a": 30, "b": 40, "c": 50, "d": 25, "e": 12}
    some = lambda t: rng.choice([None, *range(n[t])])
    tables = {t: [{"id": i, **{r.column: some(r.parent) for r in GRAPH if r.child == t}} for i in range(n[t])] for t in n}
    wishes = {"a": rng.sample(range(40), 22), "b": rng.sample(range(40), 10), "d": rng.sample(range(25), 5)}
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} bigint" for c in rows[0])) for t, rows in tables.items()}
    asked = {t: spark.createDataFrame([(k,) for k in w + w[:2]], "key bigint") for t, w in wishes.items()}
    out, refused = references.delete_rows(frames, GRAPH, dict.fromkeys(n, "id"), asked)
    want, want_refused = deletion_by_hand(tables, wishes)
    for t in n:
        assert tuples(out[t], *out[t].columns) == want[t], t
    for t in wishes:
        # Wishes for rows that are not there are neither carried out nor judged.
        assert {k for (k,) in tuples(refused[t], "key") if k < n[t]} == {k for k in want_refused[t] if k < n[t]}
    for r in GRAPH:
        if r.on_delete == "null":
            continue
        assert quality.orphans(out[r.child], r.column, out[r.parent], "id").count() == 0


def test_references_that_go_round_are_refused():
    with pytest.raises(ValueError):
        references.parents_first(["a", "b"], [Reference("a", "b_id", "b", "keep"), Reference("b", "a_id", "a", "keep")])
    assert references.parents_first(["order_items", "orders", "users"], [r for r in references.SHOP_REFERENCES if r.parent in ("users", "orders") and r.child in ("orders", "order_items")]) \
        == ["users", "orders", "order_items"]


# Change jobs on their own output, no column dropped

def test_payments_run_on_their_own_output(spark):
    schema = "order_id bigint, user_id bigint, status string, final_amount bigint, payment_key string, payment_method string, pg_provider string, paid_at timestamp_ntz"
    orders = spark.createDataFrame([(1, 1, "pending", 100, None, None, None, None), (2, 1, "pending", 50, None, None, None, None)], schema)
    feed = spark.createDataFrame([("p", 1, 100, "PAID", "PaymentMethodCard", None, START)],
                                 "payment_id string, order_id bigint, amount bigint, payment_status string, method string, provider string, paid_at timestamp_ntz")
    once = changes.apply_payments(orders, feed)
    twice = changes.apply_payments(once, feed)
    assert twice.columns == once.columns and twice.filter("newly_paid").isEmpty() and once.filter("newly_paid").count() == 1
    items = spark.createDataFrame([(1, 7)], "order_id bigint, product_id bigint")
    assert changes.newly_bought(twice, items).isEmpty()
    assert tuples(twice.drop("newly_paid"), *orders.columns) == tuples(once.drop("newly_paid"), *orders.columns)


def test_refunds_run_on_their_own_output(spark):
    orders = spark.createDataFrame([(1, "paid", 30), (2, "paid", 20)], "order_id bigint, status string, final_amount bigint")
    items = spark.createDataFrame([(1, 1, 10, "active"), (1, 2, 20, "active"), (2, 1, 20, "active")], "order_id bigint, line_no int, price bigint, item_status string")
    wishes = [spark.createDataFrame([(1, n, "admin")], "order_id bigint, line_no int, path string") for n in (1, 1, 2)]
    seen = []
    for wish in wishes:
        accepted = changes.refund_requests(orders, wish)
        items = changes.refund_items(items, accepted, wish)
        orders = changes.refund_orders(orders, items, accepted)
        seen.append([(o, s, int(a)) for o, s, a in tuples(orders, "order_id", "status", "refund_amount")])
    assert seen == [[(1, "paid", 10), (2, "paid", 0)]] * 2 + [[(1, "refund", 30), (2, "paid", 0)]]


def test_counters_run_on_their_own_output(spark):
    base = spark.createDataFrame([(1, 5), (2, None)], "k bigint, n bigint")
    events = lambda *hours: spark.createDataFrame([(1, START + dt.timedelta(hours=h)) for h in hours], "k bigint, created_at timestamp_ntz")
    once = changes.add_counters(base, events(3, 1), "k", "n")
    twice = changes.add_counters(once, events(2), "k", "n")
    assert tuples(twice, "k", "n", "last_at") == [(1, 8, START + dt.timedelta(hours=3)), (2, 0, None)]


def test_downloads_count_on_both_tables(spark):
    rights = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "user_id bigint, product_id bigint")
    products = spark.createDataFrame([(7, 10), (8, None), (9, 1)], "product_id bigint, download_count bigint")
    asked = spark.createDataFrame([(1, 7, START), (1, 7, START + dt.timedelta(1)), (2, 7, START), (2, 8, START)], "user_id bigint, product_id bigint, created_at timestamp_ntz")
    mine, counted = changes.count_downloads(rights, products, asked)
    assert tuples(mine, "user_id", "product_id", "download_count", "last_downloaded_at") == sorted(
        [(1, 7, 2, START + dt.timedelta(1)), (1, 8, 0, None), (2, 7, 1, START)], key=repr)
    assert tuples(counted, "product_id", "download_count") == [(7, 13), (8, 0), (9, 1)]
    mine, counted = changes.count_downloads(mine, counted, asked.limit(0))
    assert tuples(mine, "user_id", "product_id", "download_count") == [(1, 7, 2), (1, 8, 0), (2, 7, 1)]


def test_an_order_without_an_amount_is_no_missing_order(spark):
    orders = spark.createDataFrame([(1, None), (2, 5), (3, None)], "order_id bigint, final_amount bigint")
    payments = spark.createDataFrame([(1, 5, "PAID"), (2, 5, "PAID"), (4, 5, "PAID")], "order_id bigint, amount bigint, payment_status string")
    assert tuples(joins.reconcile_payments(orders, payments), "order_id", "result") == [(1, "mismatch"), (2, "ok"), (3, "missing_payment"), (4, "missing_order")]


def test_streams_leave_the_callers_time_zone(spark, data_dir):
    from tallyhouse.plans.all import QUERIES

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = QUERIES["stream_daily_sales"].run(spark, data_dir).agg(F.sum("order_count")).first()[0]
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == QUERIES["stream_daily_sales"].run(spark, data_dir).agg(F.sum("order_count")).first()[0]
