"""Hot ledgers, anchored rate limits and maintained balances, in batch and as streams, against sequential code."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import changes, limits
from tallyhouse.operators.skew import cut_buckets
from tallyhouse.session import run_dir
from tallyhouse.streaming import ledger as live_ledger
from tallyhouse.streaming import limits as live_limits
from tallyhouse.streaming import sinks

START = dt.datetime(2024, 1, 1)
LEDGER = "entry_id bigint, user_id bigint, created_at timestamp_ntz, amount bigint"
REQUESTS = "client string, created_at timestamp_ntz, created_by string"


def balances_by_hand(rows):
    balance, after = defaultdict(int), {}
    for entry_id, user, at, amount in sorted(rows, key=lambda r: (r[2], r[0])):
        balance[user] = max(0, balance[user] + amount)
        after[entry_id] = balance[user]
    return dict(balance), after


def hot_hour(n=3_000, seed=1):
    """A third of all entries in one hour of one user, many of them at one moment."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        at = START + (dt.timedelta(seconds=rng.choice([7, 7, rng.randrange(3600)])) if hot else dt.timedelta(minutes=rng.randrange(6000)))
        rows.append((i, 0 if hot else rng.randrange(1, 20), at, rng.randrange(-100, 90)))
    rng.shuffle(rows)
    return rows


# A hot hour is cut

def test_a_hot_hour_is_cut_into_ranges(spark):
    rows = hot_hour()
    df = spark.createDataFrame(rows, LEDGER)
    found = cut_buckets(df, "user_id", ["created_at", "entry_id"], changes.hour_number(), 128).collect()
    assert len(found) == len(rows)
    sizes = Counter((r.user_id, r["_bucket"]) for r in found)
    hot = {b: n for (user, b), n in sizes.items() if user == 0}
    assert len(hot) >= 5 and max(hot.values()) < 500
    assert all(b["_range"] == 0 for user, b in sizes if user)
    in_order = [r["_bucket"] for r in sorted(found, key=lambda r: (r.created_at, r.entry_id)) if r.user_id == 0]
    assert in_order == sorted(in_order)


@pytest.mark.parametrize("range_rows", [64, 300, 10 ** 6])
def test_cut_hours_give_the_same_balances(spark, range_rows):
    rows = hot_hour(seed=range_rows)
    df = spark.createDataFrame(rows, LEDGER).repartition(7)
    balance, after = balances_by_hand(rows)
    found = changes.running_balances(df, range_rows=range_rows)
    assert {r.entry_id: r.balance for r in found.collect()} == after
    whole = changes.balances_from_buckets(changes.point_buckets(df, range_rows=range_rows)).collect()
    assert {r.user_id: r.balance for r in whole} == balance


# Anchored windows

def windows_by_hand(rows, length):
    open_, out = {}, Counter()
    for client, at in sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None):
        if client not in open_ or at >= open_[client] + length:
            open_[client] = at
        out[client, open_[client]] += 1
    return out


def request_rows(n=1_500, seed=4):
    rng = random.Random(seed)
    rows = [(None, START, "x"), ("a", None, "x"), ("ends", START, "x"), ("ends", START + dt.timedelta(minutes=15), "x"),
            ("ends", START + dt.timedelta(minutes=15, microseconds=-1), "x")]
    for i in range(n):
        client = "hot" if i % 3 == 0 else f"c{rng.randrange(30)}"
        rows.append((client, START + dt.timedelta(microseconds=rng.randrange(6 * 3600 * 10 ** 6)), "x"))
    return rows


@pytest.mark.parametrize("seconds", [1, 60, 900, 7200])
def test_anchored_windows_equal_a_sequential_count(spark, seconds):
    rows = request_rows()
    found = limits.anchored_windows(spark.createDataFrame(rows, REQUESTS), "client", seconds).collect()
    want = windows_by_hand(rows, dt.timedelta(seconds=seconds))
    assert {(r.client, r.window_start): r.requests for r in found} == want and len(found) == len(want)


def test_steady_clients_need_few_rounds(spark):
    rows = [("steady", START + dt.timedelta(seconds=50 * i + 11 * (i % 4)), "x") for i in range(600)]
    df = spark.createDataFrame(rows, REQUESTS)
    found = limits.anchored_windows(df, "client", 120).collect()
    assert {(r.client, r.window_start): r.requests for r in found} == windows_by_hand(rows, dt.timedelta(seconds=120))
    assert limits.anchored_windows(df.limit(0), "client", 120).count() == 0


def test_microseconds_do_not_depend_on_the_time_zone(spark):
    at = dt.datetime(2024, 3, 10, 2, 30, 1, 123456)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = spark.createDataFrame([(at,)], "at timestamp_ntz").select(limits.micros("at").alias("us")) \
            .select("us", limits.time_of(F.col("us")).alias("back")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert r.us == (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) and r.back == at


def stored(spark, folder, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_limits_equal_a_sequential_count(spark, tmp_path):
    """Requests come up to ten minutes late."""
    rng = random.Random(8)
    rows = sorted((r for r in request_rows(600) if r[0] and r[1]), key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(10)))
    parts = [rows[i:i + 121] for i in range(0, len(rows), 121)]
    stream = stored(spark, f"{tmp_path}/in", parts, REQUESTS)
    table = sinks.run(live_limits.breaches(stream, "client", 2, 900, "30 minutes"), "update", run_dir(spark, "t"))
    assert table.select("batch").distinct().count() > 2
    newest = max(r[1] for r in rows).replace(microsecond=max(r[1] for r in rows).microsecond // 1000 * 1000)
    passed = [r for r in rows if r[1] <= newest - dt.timedelta(minutes=30)]
    want = {k: n for k, n in windows_by_hand(passed, dt.timedelta(minutes=15)).items() if n > 2}
    found = sinks.latest_per_key(table, ["client", "window_start"]).collect()
    assert {(r.client, r.window_start): r.requests for r in found} == want and want


def test_limit_state_ends_with_the_window(spark, tmp_path):
    rows = [[("a", START, "x"), ("a", START, "x")], [("z", START + dt.timedelta(days=1), "x")], [("z", START + dt.timedelta(days=2), "x")]]
    stream = stored(spark, f"{tmp_path}/in", rows, REQUESTS)
    query = sinks.write_batches(live_limits.breaches(stream, "client", 1, 900, "1 minute"), "update", run_dir(spark, "t"))
    query.awaitTermination()
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1


# Maintained balances

def live_parts(seed=3):
    """Mostly in time order; some entries come hours late."""
    rng = random.Random(seed)
    rows = sorted(hot_hour(1_200, seed), key=lambda r: r[2] + dt.timedelta(hours=rng.choice([0] * 9 + [5])))
    return rows, [rows[i:i + 200] for i in range(0, len(rows), 200)]


def test_maintained_balances_count_late_entries(spark, tmp_path):
    rows, parts = live_parts()
    stream = stored(spark, f"{tmp_path}/in", parts, LEDGER)
    folder = run_dir(spark, "t")
    live_ledger.maintain(stream, folder, range_rows=64).awaitTermination()
    states = live_ledger.table(spark, folder, "states", live_ledger.STATES)
    assert states.select("batch").distinct().count() == len(parts)
    found = live_ledger.balances(spark, folder).collect()
    assert {r.user_id: r.balance for r in found} == balances_by_hand(rows)[0]
    assert sum(r.entries for r in found) == len(rows)
    # An hour is one row of state, whatever it holds.
    assert live_ledger.buckets(spark, folder).groupBy("user_id", "_bucket").count().filter("count > 1").isEmpty()


def test_a_replayed_micro_batch_changes_nothing(spark):
    rows, parts = live_parts(6)
    folder = run_dir(spark, "t")
    for n, part in enumerate(parts):
        live_ledger.store(spark, folder, spark.createDataFrame(part, LEDGER), n)
    live_ledger.store(spark, folder, spark.createDataFrame(parts[-1], LEDGER), len(parts) - 1)
    live_ledger.store(spark, folder, spark.createDataFrame([], LEDGER), len(parts))
    assert {r.user_id: r.balance for r in live_ledger.balances(spark, folder).collect()} == balances_by_hand(rows)[0]


def test_only_late_hours_are_read_again(spark):
    folder = run_dir(spark, "t")
    row = lambda i, minute, amount: (i, 1, START + dt.timedelta(minutes=minute), amount)
    live_ledger.store(spark, folder, spark.createDataFrame([row(0, 10, 5), row(1, 20, -9)], LEDGER), 0)
    live_ledger.store(spark, folder, spark.createDataFrame([row(2, 30, 4)], LEDGER), 1)
    assert [(r.entries, r.total, r.low) for r in live_ledger.buckets(spark, folder).collect()] == [(3, 0, -4)]
    live_ledger.store(spark, folder, spark.createDataFrame([row(3, 15, -5)], LEDGER), 2)
    assert [(r.entries, r.total, r.low) for r in live_ledger.buckets(spark, folder).collect()] == [(4, -5, -9)]
    assert live_ledger.balances(spark, folder).first().balance == 4
