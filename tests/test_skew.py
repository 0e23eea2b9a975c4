"""Hot keys: a third of all rows on one key, small pages, results whole."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window, functions as F

from tallyhouse.operators import catalog, changes, customers, joins
from tallyhouse.operators.skew import collect_pages, join_measured, page_of, running_sums, top_n_per_key
from tallyhouse.sources import bundles


@pytest.fixture(scope="module")
def hot_rows(spark):
    rng = random.Random(3)
    keys = [0] * 1000 + [rng.randrange(1, 300) for _ in range(2000)]
    rows = [(k, i, rng.randrange(100)) for i, k in enumerate(keys)] + [(None, -1, 0)]
    return rows, spark.createDataFrame(rows, "k bigint, id bigint, v int").repartition(5)


def test_pages_are_whole_and_cut_alike(spark, hot_rows):
    rows, df = hot_rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages = collect_pages(df.withColumn("page_no", page_of("id", 50)), ["k"], F.struct("id", "v"), "entries") \
            .withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(e.id // 50 == r.page_no for r in pages for e in r.entries)
    found = defaultdict(list)
    for r in sorted(pages, key=lambda r: r.page_no):
        found[r.k] += [(e.id, e.v) for e in r.entries]
    expected = defaultdict(list)
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        expected[k].append((i, v))
    assert found == expected
    # The hot key is the work of several tasks, none of which holds most of it.
    by_task = Counter()
    for r in pages:
        if r.k == 0:
            by_task[r.task] += len(r.entries)
    assert len(by_task) > 3 and max(by_task.values()) < 500


def test_lines_without_a_number_stand_on_the_first_page(spark):
    df = spark.createDataFrame([(1, None), (1, 999), (1, 1000)], "k int, line_no int").withColumn("page_no", page_of())
    assert sorted((r.page_no, len(r.e)) for r in collect_pages(df, ["k"], F.struct("line_no"), "e").collect()) == [(0, 2), (1, 1)]


def test_top_n_limits_before_the_shuffle(hot_rows):
    rows, df = hot_rows
    top = top_n_per_key(df.filter("k IS NOT NULL"), ["k"], [F.col("v").desc(), F.col("id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    by_key = defaultdict(list)
    for k, i, v in rows:
        if k is not None:
            by_key[k].append((-v, i))
    expected = {(k, i, n + 1) for k, es in by_key.items() for n, (_, i) in enumerate(sorted(es)[:3])}
    assert {(r.k, r.id, r.position) for r in top.collect()} == expected


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_measured_join_is_a_plain_join(spark, hot_rows, how):
    _, df = hot_rows
    grouped = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 8")
    measured = join_measured(df, grouped, ["k"], how)
    plain = df.join(grouped, "k", how)
    assert measured.columns == plain.columns
    assert sorted(map(tuple, measured.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_counting_does_not_share_the_join_partitioning(spark, shop):
    """Otherwise a hot order could not be split."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.paid_order_counts(shop.items, shop.orders)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("product_id" in line and "order_id" in line for line in exchanges)
    assert sum("_hash" in line for line in exchanges) == 2


def test_optional_items_equal_a_left_join(spark, hot_shop):
    tables, _ = hot_shop
    orders, items = tables["orders"], tables["items"]
    found = joins.orders_with_items(orders, items)
    plain = orders.join(items, "order_id", "left")
    assert found.columns == plain.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_optional_items_are_not_sorted(spark, hot_shop):
    tables, _ = hot_shop
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.orders_with_items(tables["orders"], tables["items"])._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 2


def ledger_rows(n=600, users=4, seed=5):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        user = 0 if i % 3 == 0 else rng.randrange(users)
        rows.append((i, user, start + dt.timedelta(minutes=rng.randrange(3000)), rng.randrange(-300, 300)))
    return rows


def sequential(rows):
    balances, steps = defaultdict(int), {}
    for i, user, at, amount in sorted(rows, key=lambda r: (r[2], r[0])):
        balances[user] = max(0, balances[user] + amount)
        steps[i] = balances[user]
    return balances, steps


@pytest.mark.parametrize("rows", [
    ledger_rows(), ledger_rows(seed=9),
    [(0, 1, dt.datetime(2024, 1, 1), 100), (1, 1, dt.datetime(2024, 1, 1), -500),
     (2, 1, dt.datetime(2024, 1, 1, 5), 50)],
    [(i, 1, dt.datetime(2024, 1, 1, i), -5) for i in range(5)]], ids=["many", "more", "ties", "negative"])
def test_balances_equal_sequential_clamping(spark, rows):
    ledger = spark.createDataFrame(rows, "entry_id bigint, user_id bigint, created_at timestamp_ntz, amount bigint")
    balances, steps = sequential(rows)
    assert {r.entry_id: r.balance for r in changes.running_balances(ledger).collect()} == steps
    final = changes.point_balances(ledger).collect()
    assert {r.user_id: r.balance for r in final} == dict(balances)
    assert all(r.balance >= 0 for r in final) and sum(r.entries for r in final) == len(rows)


def test_balances_go_on_from_an_earlier_run(spark):
    ledger = spark.createDataFrame(ledger_rows(), "entry_id bigint, user_id bigint, created_at timestamp_ntz, amount bigint")
    day = F.col("created_at") < F.lit("2024-01-02").cast("timestamp_ntz")
    first = changes.point_balances(ledger.filter(day)).select("user_id", "balance") \
        .union(spark.createDataFrame([(99, 7)], "user_id bigint, balance bigint"))
    found = {r.user_id: r.balance for r in changes.point_balances(ledger.filter(~day), opening=first).collect()}
    assert found == {r.user_id: r.balance for r in changes.point_balances(ledger).collect()} | {99: 7}


def test_running_sums_split_the_hot_key(spark):
    rows = ledger_rows()
    ledger = spark.createDataFrame(rows, "entry_id bigint, user_id bigint, created_at timestamp_ntz, amount bigint")
    summed = running_sums(ledger, "user_id", ["created_at", "entry_id"], changes.hour_number(), "amount")
    plain = ledger.withColumn("s", F.sum("amount").over(
        Window.partitionBy("user_id").orderBy("created_at", "entry_id").rowsBetween(Window.unboundedPreceding, 0)))
    assert {(r.entry_id, r.running_sum) for r in summed.collect()} == {(r.entry_id, r.s) for r in plain.collect()}


@pytest.fixture(scope="module")
def hot_shop(spark):
    """One order with a third of all items, one user with a third of the reviews."""
    rng = random.Random(11)
    orders = [(o, o % 5, "paid", o * 10, "card", dt.datetime(2001, 6, 1) + dt.timedelta(hours=o), dt.datetime(2001, 6, 2))
              for o in range(20)]
    items = [(0 if i % 3 == 0 else rng.randrange(19), rng.randrange(8), i, i, "active", i) for i in range(300)]
    products = [(p, f"product {p}", "x", True) for p in range(8)]
    users = [(u, f"user {u}", f"u{u}@shop.example", "local", True, False, None) for u in range(6)]
    return {
        "orders": spark.createDataFrame(orders, "order_id bigint, user_id bigint, status string, final_amount bigint, "
                                                "payment_method string, created_at timestamp_ntz, paid_at timestamp_ntz"),
        "items": spark.createDataFrame(items, "order_id bigint, product_id bigint, line_no int, price bigint, "
                                              "item_status string, item_key bigint"),
        "products": spark.createDataFrame(products, "product_id bigint, name string, category string, is_active boolean"),
        "users": spark.createDataFrame(users, "user_id bigint, name string, email string, provider string, "
                                              "is_active boolean, is_dormant boolean, manual_grade string"),
    }, items


@pytest.mark.parametrize("page_lines", [4, 1000])
def test_order_list_is_whole(hot_shop, page_lines):
    tables, items = hot_shop
    found = joins.order_list(tables["orders"], tables["users"], tables["items"], tables["products"], page_lines=page_lines).collect()
    names = defaultdict(list)
    for r in sorted(found, key=lambda r: r.page_no):
        names[r.order_id] += r.product_names.split(", ") if r.product_names else []
    expected = defaultdict(list)
    for order, product, *_ in items:
        expected[order].append(f"product {product}")
    assert set(names) == set(range(20))
    assert {o: n for o, n in names.items() if n} == expected
    if page_lines > 300:
        assert len(found) == 20


def test_order_list_reads_the_lines_twice_at_most(shop):
    for found in (joins.order_list(shop.orders, shop.users, shop.items, shop.products, search="r_d"),
                  catalog.orders_with_items(shop.orders, shop.items, shop.products)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) <= 2


def test_search_lists_matching_products_only(hot_shop):
    tables, items = hot_shop
    found = joins.order_list(tables["orders"], tables["users"], tables["items"], tables["products"],
                             search="product 3", page_lines=4).collect()
    assert {n for r in found for n in r.product_names.split(", ")} == {"product 3"}
    assert sum(len(r.product_names.split(", ")) for r in found) == sum(1 for i in items if i[1] == 3)


def test_search_by_buyer_keeps_orders_without_items(spark, hot_shop):
    tables, items = hot_shop
    found = joins.order_list(tables["orders"], tables["users"], tables["items"].filter("order_id <> 3"),
                             tables["products"].withColumn("name", F.when(F.col("product_id") != 2, F.col("name"))),
                             search="USER 3").collect()
    assert {r.order_id for r in found} == {3, 8, 13, 18}
    assert [r.product_names for r in found if r.order_id == 3] == [None]
    listed = {r.order_id: len(r.product_names.split(", ")) for r in found if r.product_names}
    assert listed == Counter(i[0] for i in items if i[0] in (8, 13, 18) and i[1] != 2)


@pytest.mark.parametrize("page_lines", [4, 1000])
def test_nested_items_are_whole(hot_shop, page_lines):
    tables, items = hot_shop
    found = catalog.orders_with_items(tables["orders"], tables["items"], tables["products"], page_lines).collect()
    assert sorted((r.order_id, i.line_no) for r in found for i in r["items"]) == sorted((o, n) for o, _, n, *_ in items)
    assert all(r.user_id == r.order_id % 5 for r in found)


@pytest.mark.parametrize("page_lines", [3, 1000])
def test_customer_record_and_bundle_are_whole(spark, hot_shop, page_lines):
    tables, items = hot_shop
    at = dt.datetime(2001, 6, 3)
    reviews = spark.createDataFrame([(i, 0 if i % 3 == 0 else i % 6, i % 8, i % 5 + 1, at) for i in range(90)],
                                    "review_id bigint, user_id bigint, product_id bigint, rating int, created_at timestamp_ntz")
    ledger = spark.createDataFrame([(i, i % 6, i, "admin_add", at) for i in range(50)],
                                   "entry_id bigint, user_id bigint, amount bigint, type string, created_at timestamp_ntz")
    notes = spark.createDataFrame([(i, 1, f"note {i}", at) for i in range(20)],
                                  "note_id bigint, user_id bigint, content string, created_at timestamp_ntz")
    claims = spark.createDataFrame([(i, i % 2, 1, False, at) for i in range(8)],
                                   "claim_id bigint, user_id bigint, coupon_event_id bigint, is_used boolean, created_at timestamp_ntz")
    record = customers.customer_360(tables["users"], tables["orders"], tables["items"], tables["products"], reviews, ledger,
                                    notes, claims, "2001-06-30").collect()
    by_section = defaultdict(list)
    for r in record:
        by_section[r.section].append(r)
    assert sorted(r.user_id for r in by_section["profile"]) == list(range(6))
    for name, n in (("reviews", 90), ("notes", 20), ("coupons", 8)):
        assert sorted(int(r.entry_id) for r in by_section[name]) == list(range(n))
        assert all(r[name] is not None and r.name is None for r in by_section[name])
    listed = [o for r in by_section["profile"] for o in r.orders or []]
    assert {o.order_id: o.item_count for o in listed} == {o: Counter(i[0] for i in items)[o] for o in range(20)}
    first = {o: min((n, p) for order, p, n, *_ in items if order == o)[1] for o in {i[0] for i in items}}
    assert {o.order_id: o.first_product for o in listed if o.first_product} == {o: f"product {p}" for o, p in first.items()}
    rights = spark.createDataFrame([(u, p, at) for u in range(6) for p in range(u)],
                                   "user_id bigint, product_id bigint, created_at timestamp_ntz")
    bundle = bundles.user_bundles(tables["users"], tables["orders"], tables["items"], tables["products"], rights, reviews,
                                  ledger, "2024-01-31", page_lines=page_lines).collect()
    assert sorted(i.price for r in bundle if r.orders for i in r.orders["items"]) == sorted(i[3] for i in items)
    assert sorted(int(r.entry_id) for r in bundle if r.section == "point_history") == list(range(50))
    assert Counter(r.section for r in bundle)["downloads"] == 15
    assert Counter(r.section for r in bundle)["profile"] == 6


def test_linked_ids_cover_every_parent(spark):
    parents = spark.range(4).withColumnRenamed("id", "p")
    links = spark.createDataFrame([(1, c) for c in range(30)] + [(2, 5), (2, None), (9, 1)], "p bigint, c bigint")
    found = sorted(map(tuple, catalog.linked_ids(parents, links, "p", "c").collect()), key=str)
    assert found == sorted([(0, None), (3, None), (2, 5)] + [(1, c) for c in range(30)], key=str)
    named = catalog.linked_ids(parents.selectExpr("concat('id-', p) AS p"), links.selectExpr("concat('id-', p) AS p", "c"), "p", "c")
    assert named.count() == 33
