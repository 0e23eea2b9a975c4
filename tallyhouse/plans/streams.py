"""Streaming queries: each runs a stream over the whole table to its end."""

import datetime as dt

from pyspark.sql import functions as F

from ..functions.fixed_values import LOGIN_LIMIT
from ..operators import limits
from ..operators.changes import balances_from_buckets
from ..session import run_dir
from ..streaming import jobs, ledger, sinks
from ..streaming import limits as live_limits
from .output import plain
from .registry import query
from .shop import Shop


#: The lengths of the login and the registration window.
LOGIN_SECONDS, REGISTER_SECONDS = 15 * 60, 60 * 60


def _utc(shop):
    """The shop in a session of its own, so that UTC holds for the stream and the caller's time zone stays."""
    own = shop.spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return Shop(own, shop.folder)


def _run(shop, build, mode, label):
    return sinks.run(build(_utc(shop).live()), mode, run_dir(shop.spark, label))


# The test table has 150 users, so the limit here is one request per window.
BREACHES = """
SELECT time_bucket(INTERVAL 15 MINUTE, created_at) AS window_start, user_id, count(*)::BIGINT AS requests
FROM shop_events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) > 1
"""


@query("R1", sql=BREACHES)
def rate_limit_breaches(shop):
    return jobs.rate_limit_breaches(shop.events_of("error"), "user_id", 1, LOGIN_LIMIT[1])


@query("R1", sql=BREACHES)
def stream_rate_limit_breaches(shop):
    table = _run(shop, lambda live: jobs.rate_limit_breaches(live.events_of("error"), "user_id", 1, LOGIN_LIMIT[1]),
                 "complete", "rate-limits")
    return sinks.last_complete(table)


@query("R1", sql="""
SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS window_start, item_id, count(*)::BIGINT AS requests
FROM shop_events WHERE event_type = 'signup' GROUP BY 1, 2 HAVING count(*) > 1
""")
def registration_limit_breaches(shop):
    return jobs.rate_limit_breaches(shop.events_of("signup"), "item_id", 1, "1 hour")


def _anchored(events, client, minutes):
    """Window by window from each client's first request: the next one starts at the first request after its end."""
    return f"""
WITH RECURSIVE asked AS ({events}),
starts(client, start) AS (
  SELECT client, min(seen) FROM asked GROUP BY client
  UNION ALL
  SELECT s.client, min(a.seen) FROM starts s JOIN asked a ON a.client = s.client AND a.seen >= s.start + INTERVAL {minutes} MINUTE
  GROUP BY s.client)
SELECT start AS window_start, a.client AS {client}, count(*)::BIGINT AS requests
FROM asked a ASOF JOIN starts s ON s.client = a.client AND a.seen >= s.start
GROUP BY ALL HAVING count(*) > 1
"""


ERRORS = "SELECT user_id AS client, created_at AS seen FROM shop_events WHERE event_type = 'error'"


@query("R1", sql=_anchored(ERRORS, "user_id", 15))
def login_limit_breaches(shop):
    return limits.breaches(shop.events_of("error"), "user_id", 1, LOGIN_SECONDS)


@query("R1", sql=_anchored("SELECT item_id AS client, created_at AS seen FROM shop_events WHERE event_type = 'signup'", "item_id", 60))
def signup_limit_breaches(shop):
    return limits.breaches(shop.events_of("signup"), "item_id", 1, REGISTER_SECONDS)


# Requests that the watermark (one hour behind the newest, in milliseconds) has passed.
@query("R1", sql=_anchored(f"""SELECT * FROM ({ERRORS}) WHERE seen <=
  (SELECT date_trunc('milliseconds', max(created_at)) - INTERVAL 1 HOUR FROM shop_events WHERE event_type = 'error')""", "user_id", 15))
def stream_login_limit_breaches(shop):
    table = _run(shop, lambda live: live_limits.breaches(live.events_of("error"), "user_id", 1, LOGIN_SECONDS, "1 hour"),
                 "update", "login-limits")
    return sinks.latest_per_key(table, ["window_start", "user_id"])


@query("R2 M11", sql="""
SELECT item_id, count(*)::BIGINT AS n, max(created_at) AS last_at FROM shop_events WHERE event_type = 'view' GROUP BY item_id
""")
def stream_counters(shop):
    table = _run(shop, lambda live: jobs.counters(live.events_of("view"), "item_id"), "update", "counters")
    return jobs.counter_totals(sinks.latest_per_key(table, ["day", "item_id"]), "item_id")


@query("R3 A4", sql="""
SELECT CAST(CAST(paid_at AS DATE) AS VARCHAR) AS day, count(*)::BIGINT AS order_count, sum(final_amount)::BIGINT AS amount
FROM shop_orders WHERE status = 'paid' GROUP BY CAST(paid_at AS DATE)
""")
def stream_daily_sales(shop):
    return plain(sinks.last_complete(_run(shop, lambda live: jobs.daily_sales(live.orders), "complete", "daily-sales")))


@query("R4 M4", sql="""
SELECT item_id, count(*)::BIGINT AS likes FROM (
  SELECT item_id, user_id FROM shop_events WHERE event_type = 'click' GROUP BY item_id, user_id HAVING count(*) % 2 = 1)
GROUP BY item_id
""")
def stream_like_state(shop):
    table = _run(shop, lambda live: jobs.like_toggles(live.toggles), "update", "likes")
    return jobs.likes_from_toggles(sinks.latest_per_key(table, ["item_id", "fingerprint"]))


# Only buckets the watermark (one day behind the newest entry) has passed.
@query("R5 M5", sql="""
WITH closed AS (SELECT * FROM shop_ledger WHERE date_trunc('hour', created_at) + INTERVAL 1 HOUR
                <= (SELECT max(created_at) FROM shop_ledger) - INTERVAL 1 DAY),
sums AS (SELECT *, sum(amount) OVER (PARTITION BY user_id ORDER BY created_at, entry_id) AS s FROM closed),
lows AS (SELECT *, least(0, min(s) OVER (PARTITION BY user_id ORDER BY created_at, entry_id)) AS low FROM sums)
SELECT user_id, count(*)::BIGINT AS entries, (sum(amount) - min(low))::BIGINT AS balance FROM lows GROUP BY user_id
""")
def stream_point_balance(shop):
    states = _ledger(shop)
    newest = states.agg(F.max("last.created_at")).first()[0]
    passed = newest - dt.timedelta(days=1) if newest else dt.datetime(1970, 1, 1)
    hours = (passed - dt.datetime(1970, 1, 1)) // dt.timedelta(hours=1)
    return plain(balances_from_buckets(states.filter(F.col("_bucket") < hours)), "user_id", "entries", "balance")


def _ledger(shop):
    folder = run_dir(shop.spark, "ledger")
    ledger.maintain(_utc(shop).live().ledger, folder).awaitTermination()
    return ledger.buckets(shop.spark, folder)


@query("R5 M5", sql="""
WITH sums AS (SELECT *, sum(amount) OVER (PARTITION BY user_id ORDER BY created_at, entry_id) AS s FROM shop_ledger),
lows AS (SELECT *, least(0, min(s) OVER (PARTITION BY user_id ORDER BY created_at, entry_id)) AS low FROM sums)
SELECT user_id, count(*)::BIGINT AS entries, (sum(amount) - min(low))::BIGINT AS balance FROM lows GROUP BY user_id
""")
def stream_point_balance_open(shop):
    return plain(balances_from_buckets(_ledger(shop)), "user_id", "entries", "balance")


# All matches; of the orders without payment those a payment can no longer reach.
@query("R6 J12", sql="""
WITH paid AS (SELECT * FROM shop_payments WHERE payment_status = 'PAID'),
mark AS (SELECT least((SELECT max(created_at) FROM shop_orders), (SELECT max(paid_at) FROM paid)) - INTERVAL 1 DAY AS passed)
SELECT o.order_id, o.final_amount::BIGINT AS final_amount, o.created_at AS ordered_at, p.payment_id, p.paid_at AS payment_at
FROM shop_orders o LEFT JOIN paid p ON p.order_id = o.order_id AND p.amount = o.final_amount
WHERE p.order_id IS NOT NULL OR o.created_at + INTERVAL 3 DAY < (SELECT passed FROM mark)
""")
def stream_payment_match(shop):
    table = _run(shop, lambda live: jobs.match_payments(live.orders, live.payments), "append", "payments")
    matched = sinks.appended(table)
    return plain(matched.withColumn("ordered_at", F.col("ordered_at").cast("timestamp_ntz"))
                 .withColumn("payment_at", F.col("payment_at").cast("timestamp_ntz")))
