"""Streams in several micro-batches against the batch result on the same rows."""

import datetime as dt
import random
import tempfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import changes
from tallyhouse.session import run_dir
from tallyhouse.sources import tables
from tallyhouse.streaming import jobs, sinks

EVENTS = "entry_id bigint, user_id bigint, item_id bigint, fingerprint string, amount bigint, created_at timestamp_ntz"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Events in four files, in time order but shuffled inside each file."""
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(5), rng.randrange(4), str(rng.randrange(6)), rng.randrange(-50, 50),
             start + dt.timedelta(minutes=10 * i)) for i in range(800)]
    folder = str(tmp_path_factory.mktemp("events"))
    for n in range(4):
        part = rows[n * 200:(n + 1) * 200]
        rng.shuffle(part)
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return folder, rows


def stream(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_counters_equal_batch(spark, stored):
    folder, rows = stored
    table = sinks.run(jobs.counters(stream(spark, folder), "item_id"), "update", run_dir(spark, "t"))
    assert table.select("batch").distinct().count() >= 4
    totals = jobs.counter_totals(sinks.latest_per_key(table, ["day", "item_id"]), "item_id").collect()
    expected = defaultdict(int)
    for r in rows:
        expected[r[2]] += 1
    assert {r.item_id: r.n for r in totals} == expected


def test_likes_equal_batch(spark, stored):
    folder, _ = stored
    table = sinks.run(jobs.like_toggles(stream(spark, folder)), "update", run_dir(spark, "t"))
    live = jobs.likes_from_toggles(sinks.latest_per_key(table, ["item_id", "fingerprint"]))
    batch = changes.like_counts(spark.read.schema(EVENTS).parquet(folder))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_rate_limits_equal_batch(spark, stored):
    folder, _ = stored
    table = sinks.run(jobs.rate_limit_breaches(stream(spark, folder), "user_id", 2, "1 hour"), "complete", run_dir(spark, "t"))
    batch = jobs.rate_limit_breaches(spark.read.schema(EVENTS).parquet(folder), "user_id", 2, "1 hour")
    live = sorted(map(tuple, sinks.last_complete(table).select(batch.columns).collect()))
    assert live == sorted(map(tuple, batch.collect())) and live


def test_daily_sales_equal_batch(spark, tmp_path):
    day = dt.datetime(2001, 6, 1)
    schema = "order_id bigint, status string, final_amount bigint, paid_at timestamp_ntz"
    for n in range(3):
        rows = [(n * 10 + i, "paid" if i % 2 else "pending", i, day + dt.timedelta(hours=5 * i)) for i in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "orders"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "orders"))
    table = sinks.run(jobs.daily_sales(live), "complete", run_dir(spark, "t"))
    batch = spark.read.parquet(str(tmp_path / "orders")).filter("status = 'paid'").groupBy(F.col("paid_at").cast("date").alias("day")) \
        .agg(F.count(F.lit(1)), F.sum("final_amount"))
    assert sorted(map(tuple, sinks.last_complete(table).collect())) == sorted(map(tuple, batch.collect()))


def test_payment_matching(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    orders = [(i, 10, start + dt.timedelta(hours=6 * i)) for i in range(60)]
    payments = [(f"p{i}", i, 11 if i % 5 == 0 else 10, "FAILED" if i % 7 == 0 else "PAID",
                 start + dt.timedelta(hours=6 * i, days=4 if i % 11 == 0 else 1)) for i in range(60) if i % 3]
    order_schema = "order_id bigint, final_amount bigint, created_at timestamp_ntz"
    payment_schema = "payment_id string, order_id bigint, amount bigint, payment_status string, paid_at timestamp_ntz"
    spark.createDataFrame(orders, order_schema).write.parquet(str(tmp_path / "o"))
    spark.createDataFrame(payments, payment_schema).write.parquet(str(tmp_path / "p"))
    live = jobs.match_payments(spark.readStream.schema(order_schema).parquet(str(tmp_path / "o")),
                               spark.readStream.schema(payment_schema).parquet(str(tmp_path / "p")))
    found = sinks.appended(sinks.run(live, "append", run_dir(spark, "t"))).collect()
    matched = {r.order_id for r in found if r.payment_id}
    expected = {p[1] for p in payments if p[2] == 10 and p[3] == "PAID" and p[4] - orders[p[1]][2] <= dt.timedelta(days=3)}
    assert matched == expected
    unmatched = {r.order_id for r in found if r.payment_id is None}
    assert unmatched and not unmatched & matched
    # The unmatched ones are exactly those the watermark has passed.
    mark = min(max(o[2] for o in orders), max(p[4] for p in payments if p[3] == "PAID")) - dt.timedelta(days=1)
    assert unmatched == {o[0] for o in orders if o[2] + dt.timedelta(days=3) < mark} - expected


def test_replayed_batch_replaces_itself(spark, stored):
    folder, _ = stored
    path = run_dir(spark, "t")
    first = sinks.run(jobs.like_toggles(stream(spark, folder)), "update", path)
    count = first.count()
    again = sinks.run(jobs.like_toggles(stream(spark, folder)), "update", path)
    assert again.count() == count


def test_stream_reads_a_table_that_is_a_folder(spark, data_dir, tmp_path):
    events = tables.read_table(spark, data_dir, "events")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for folder in (data_dir, str(tmp_path)):
        stream = tables.stream_table(spark, folder, "events", maxFilesPerTrigger=1).select("event_id")
        found = sinks.run(stream, "append", tempfile.mkdtemp(dir=tmp_path))
        assert sorted(r.event_id for r in found.collect()) == sorted(r.event_id for r in events.select("event_id").collect())
