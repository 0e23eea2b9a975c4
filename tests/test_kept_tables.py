"""Tables that changes are folded into: day folders, day sums, journals, folded batches, ranked copies, key ranges."""

import datetime as dt
import os
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import changes, daysums, ordering, reports
from tallyhouse.session import run_dir
from tallyhouse.sources import days, folders, journal, ranked, tables
from tallyhouse.streaming import sinks

ORDERS = "order_id bigint, status string, payment_method string, final_amount bigint, paid_at timestamp_ntz"
START = dt.datetime(2001, 6, 1)


def order_rows(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["paid", "pending", "refund", "sent"]), rng.choice(["card", "bank", None]), rng.randrange(1000),
             None if i % 40 == 0 else START + dt.timedelta(hours=rng.randrange(24 * 20))) for i in range(n)]


def dated(spark, rows):
    return days.with_day(spark.createDataFrame(rows, ORDERS), "paid_at")


def plain(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def rows_scanned(frame):
    frame = frame.groupBy().agg(F.count(F.lit(1)))
    frame.collect()
    node = frame._jdf.queryExecution().executedPlan()
    while not node.nodeName().startswith("Scan"):
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        elif node.nodeName().endswith("QueryStage"):
            node = node.plan()
        else:
            node = node.collectLeaves().apply(0)
    return node.metrics().apply("numOutputRows").value()


# Day folders

def test_a_change_rewrites_the_touched_days_only(spark, tmp_path):
    rows, folder = order_rows(), f"{tmp_path}/days"
    table = dated(spark, rows)
    days.write_days(table, folder, "order_id")
    before = {d: sorted(os.listdir(f"{folder}/{d}")) for d in os.listdir(folder) if d.startswith("day=")}
    assert f"day={days.NO_DAY}" in before
    # An order moves to another day, one gets a day, one is new, and a day loses all it has.
    lone = START + dt.timedelta(days=90)
    moved = (7, "paid", "card", 5, START + dt.timedelta(days=2))
    new = [moved, (40, "paid", "bank", 6, START + dt.timedelta(days=3)), (9_000, "paid", "card", 7, lone)]
    held = days.read_days(spark, folder, table.schema)
    old = held.filter(F.col("order_id").isin(7, 40)).select("order_id", "day")
    touched = days.change_rows(spark, folder, table.schema, "order_id", old, dated(spark, new))
    want = [r for r in rows if r[0] not in (7, 40)] + new
    columns = ORDERS.replace(" bigint", "").replace(" string", "").replace(" timestamp_ntz", "").split(", ")
    read = lambda: days.read_days(spark, folder, table.schema)
    assert plain(read(), *columns) == sorted(map(tuple, want), key=repr)
    names = {f"day={days.NO_DAY if d is None else d}" for d in touched}
    after = {d: sorted(os.listdir(f"{folder}/{d}")) for d in os.listdir(folder) if d.startswith("day=")}
    assert names < set(after) and all(after[d] == before[d] for d in set(before) - names)
    # Again changes nothing; and a day whose last order goes loses its folder.
    days.change_rows(spark, folder, table.schema, "order_id", old.limit(0), dated(spark, new))
    assert plain(read(), *columns) == sorted(map(tuple, want), key=repr)
    days.change_rows(spark, folder, table.schema, "order_id", read().filter("order_id = 9000").select("order_id", "day"), dated(spark, [(9_000, "paid", "card", 7, START)]))
    assert f"day={lone.date()}" not in os.listdir(folder)
    assert read().filter("order_id = 9000").select("day").collect() == [(START.date(),)]


def test_reports_read_the_days_they_need(spark, tmp_path):
    rows, folder = order_rows(), f"{tmp_path}/days"
    table = dated(spark, rows)
    days.write_days(table, folder, "order_id")
    held = days.read_days(spark, folder, table.schema)
    june5 = sum(r[4] is not None and r[4].date() == dt.date(2001, 6, 5) for r in rows)
    assert rows_scanned(held.filter(F.col("day") == F.lit(dt.date(2001, 6, 5)))) == june5
    for as_of in ("2001-06-05", "2001-06-11"):
        assert reports.dashboard_kpis(held, as_of, "day").collect() == reports.dashboard_kpis(table, as_of).collect()
        assert reports.settlement_summary(held, as_of, "2001-06-12", "day").collect() == reports.settlement_summary(table, as_of, "2001-06-12").collect()
    listed = held.withColumn("created_at", F.col("paid_at"))
    at, key = dt.datetime(2001, 6, 5, 10), 150
    assert ordering.page_after(listed, at, key, 20, day="day").collect() == ordering.page_after(listed, at, key, 20).collect()


# Day sums

def sums_by_hand(rows):
    out = defaultdict(lambda: [0, 0])
    for _, status, method, amount, at in rows:
        held = out[at and at.date(), status, method]
        held[0] += 1
        held[1] += amount
    return sorted(((*k, n, a) for k, (n, a) in out.items()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_folded_changes_equal_sums_anew(spark, tmp_path, seed):
    rng, rows, folder = random.Random(seed), order_rows(seed=seed), f"{tmp_path}/sums"
    sums = daysums.order_sums(spark.createDataFrame(rows, ORDERS))
    days.write_days(sums, folder, "n")
    for _ in range(2):
        chosen = {r[0]: r for r in rng.sample(rows, 12)}
        new = {i: (i, "refund", r[2], r[3], r[4] if i % 3 else START + dt.timedelta(days=rng.randrange(25))) for i, r in chosen.items()}
        before, after = (daysums.order_sums(spark.createDataFrame(list(x.values()), ORDERS)) for x in (chosen, new))
        touched = daysums.fold_changes(spark, folder, before, after, daysums.ORDER_GROUPS)
        assert set(touched) == {r[4] and r[4].date() for r in [*chosen.values(), *new.values()]}
        rows = [new.get(r[0], r) for r in rows]
        held = days.read_days(spark, folder, sums.schema)
        assert [(*r[:3], r[3], int(r[4])) for r in plain(held, *daysums.ORDER_GROUPS, "n", "amount")] == sums_by_hand(rows)


def test_reports_from_sums_equal_reports(spark):
    orders = spark.createDataFrame([r for r in order_rows() if r[4]], ORDERS)
    sums = daysums.order_sums(orders)
    pairs = [(daysums.day_kpi(sums, "2001-06-05"), reports.day_kpi(orders, "2001-06-05")),
             (daysums.month_kpi(sums, "2001-06-05"), reports.month_kpi(orders, "2001-06-05")),
             (daysums.dashboard_kpis(sums, "2001-06-05"), reports.dashboard_kpis(orders, "2001-06-05")),
             (daysums.settlement_summary(sums, "2001-06-02", "2001-06-09"), reports.settlement_summary(orders, "2001-06-02", "2001-06-09")),
             (daysums.settlement_monthly(sums, 2001), reports.settlement_monthly(orders, 2001)),
             (daysums.payment_mix(sums, "2001-06-02", "2001-06-09"), reports.payment_mix(orders, "2001-06-02", "2001-06-09")),
             (reports.filled_days(daysums.sold_by_day(sums, "2001-06-04", "2001-06-10"), "2001-06-10"), reports.daily_sales_filled(orders, "2001-06-10"))]
    for mine, theirs in pairs:
        assert sorted(map(tuple, mine.select(*theirs.columns).collect()), key=repr) == sorted(map(tuple, theirs.collect()), key=repr)


# Journals

def counted(table, ids):
    events = table.sparkSession.createDataFrame([(i, START) for i in ids], "k bigint, created_at timestamp_ntz")
    return changes.add_counters(table, events, "k", "n")


def test_a_batch_applied_twice_counts_once(spark):
    folder = run_dir(spark, "journal")
    journal.create(spark.createDataFrame([(1, 0), (2, 5)], "k bigint, n bigint"), folder)
    journal.create(spark.createDataFrame([(3, 9)], "k bigint, n bigint"), folder)
    for name, ids, new in (("a", [1, 1], True), ("a", [1, 1], False), ("b'", [2], True), ("a", [1], False), ("b'", [2], False), ("c", [1], True)):
        assert journal.apply_once(spark, folder, name, lambda t, ids=ids: counted(t, ids)) == new
    assert plain(journal.current(spark, folder), "k", "n") == [(1, 3), (2, 6)]
    assert {r.batch_id for r in journal.applied(spark, folder).collect()} == {"a", "b'", "c"}
    assert len(folders.numbers(spark, f"{folder}/table", "version")) == 2


def test_a_failure_between_the_two_writes_is_made_good(spark, monkeypatch):
    folder = run_dir(spark, "journal")
    journal.create(spark.createDataFrame([(1, 0)], "k bigint, n bigint"), folder)
    real = journal.applied

    def failing(session, path):
        """The journal's write reads the ids so far after the table has been written."""
        if folders.exists(session, f"{path}/table/version=1"):
            raise RuntimeError("lost")
        return real(session, path)

    monkeypatch.setattr(journal, "applied", failing)
    with pytest.raises(RuntimeError):
        journal.apply_once(spark, folder, "a", lambda t: counted(t, [1]))
    monkeypatch.undo()
    # The table of version 1 is there, its journal is not: readers stay with version 0.
    assert folders.exists(spark, f"{folder}/table/version=1/_SUCCESS")
    assert plain(journal.current(spark, folder), "k", "n") == [(1, 0)]
    assert journal.apply_once(spark, folder, "a", lambda t: counted(t, [1]))
    assert plain(journal.current(spark, folder), "k", "n") == [(1, 1)]


# Folded batches

def test_folded_batches_read_alike(spark):
    folder, rng = run_dir(spark, "folded"), random.Random(5)
    schema = spark.createDataFrame([], "k bigint, n bigint").schema
    want = {}

    def store(number, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    def latest():
        found = sinks.latest_per_key(sinks.batches(spark, folder, schema), ["k"])
        return {r.k: r.n for r in found.collect()}

    parts = [[(k, number) for k in rng.sample(range(30), 5)] for number in range(40)]
    for number, part in enumerate(parts):
        store(number, part)
        want.update(part)
        if number in (9, 19, 29):
            before = latest()
            sinks.fold(spark, folder, schema, ["k"], number)
            assert latest() == before == want
    # A read opens the base and the batches after it; of the folded ones those before the last base are gone.
    files = sinks.batches(spark, folder, schema).inputFiles()
    assert len({os.path.dirname(f) for f in files}) == 1 + 10
    assert folders.numbers(spark, f"{folder}/table", "batch") == list(range(20, 40))
    assert folders.numbers(spark, f"{folder}/base", "upto") == [19, 29]
    # A folded batch that is replayed, a fold that failed on its way, and a fold that comes again change nothing.
    store(3, parts[3])
    spark.createDataFrame([(1, 99, 99)], "k bigint, n bigint, batch bigint").write.parquet(f"{folder}/base/upto=39")
    folders.remove(spark, f"{folder}/base/upto=39/_SUCCESS")
    sinks.fold(spark, folder, schema, ["k"], 29)
    assert latest() == want


# Ranked copies

def test_deep_pages_read_little(spark, tmp_path):
    rng, folder = random.Random(2), f"{tmp_path}/ranked"
    rows = spark.createDataFrame([(i, rng.randrange(50)) for i in rng.sample(range(100_000), 20_000)], "id bigint, v int")
    order = [F.col("v").desc(), F.col("id")]
    ranked.write_ranked(rows, order, folder, range_rows=100)
    for number, size in ((1, 50), (200, 50), (400, 50), (401, 50), (7, 333), (61, 333), (99_999, 10)):
        page = ranked.read_page(spark, folder, rows.schema, order, number, size)
        assert page.collect() == ordering.page(rows, order, number, size).collect()
    assert rows_scanned(ranked.read_page(spark, folder, rows.schema, order, 400, 10)) <= 0.03 * 20_000
    ranked.write_ranked(rows.limit(0), order, f"{folder}-0")
    assert ranked.read_page(spark, f"{folder}-0", rows.schema, order).collect() == []


@pytest.mark.parametrize("sorted_rows", [250_000, 700])
def test_files_of_a_ranked_copy_follow_the_rows(spark, tmp_path, monkeypatch, sorted_rows):
    monkeypatch.setattr(ranked, "SORTED_ROWS", sorted_rows)
    rng, folder = random.Random(3), f"{tmp_path}/ranked"
    rows = spark.createDataFrame([(i % 4_000, rng.choice([None, *range(9)])) for i in range(5_000)], "id bigint, v int").repartition(5)
    order = [F.col("v").desc(), F.col("id").desc()]
    ranked.write_ranked(rows, order, folder, range_rows=10)
    files = [f for _, _, found in os.walk(f"{folder}/rows") for f in found if f.endswith(".parquet")]
    assert len(files) == -(-5_000 // sorted_rows)
    for number, size in ((1, 10), (77, 13), (3, 900), (1, 9_000), (500, 10), (501, 10)):
        assert ranked.read_page(spark, folder, rows.schema, order, number, size).collect() == ordering.page(rows, order, number, size).collect()


# Key ranges

@pytest.mark.parametrize("partitions", [1, 2, 7, 64])
@pytest.mark.parametrize("kind", ["uuid", "sampled"])
def test_key_ranges_are_disjoint_and_cover_all_keys(spark, partitions, kind):
    db = duckdb.connect()
    db.execute("SELECT setseed(0.5)")
    db.execute("CREATE TABLE t AS SELECT gen_random_uuid() AS id FROM range(3000)")
    db.execute("INSERT INTO t VALUES (NULL), (NULL), ('00000000-0000-0000-0000-000000000000'), ('ffffffff-ffff-ffff-ffff-ffffffffffff')")
    if kind == "uuid":
        cuts = tables.uuid_cuts(partitions)
    else:
        keys = [(str(r[0]),) if r[0] else (None,) for r in db.execute("SELECT id FROM t").fetchall()]
        cuts = tables.sampled_cuts(spark.createDataFrame(keys, "id string"), "id", partitions)
    ranges = tables.key_ranges("CAST(id AS VARCHAR)", cuts)
    assert len(ranges) == partitions
    counts = [db.execute(f"SELECT count(*) FROM t WHERE {r}").fetchone()[0] for r in ranges]
    assert sum(counts) == 3004 and db.execute("SELECT count(*) FROM t WHERE " + " OR ".join(f"({r})" for r in ranges)).fetchone()[0] == 3004
    assert max(counts) < 2 * 3004 / partitions + 30


def test_key_ranges_quote_their_texts():
    assert tables.key_ranges("k", ["o'b", "a"]) == ["k < 'a' OR k IS NULL", "k >= 'a' AND k < 'o''b'", "k >= 'o''b'"]
