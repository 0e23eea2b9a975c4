"""Times the registered queries and prints one JSON line.

Every query runs over the whole tables and is written to the ``noop`` sink, so
all its columns are computed.  One warm-up pass, then the median of the runs.
"""

import json
import os
import statistics
import sys
import time

from tallyhouse.plans.all import QUERIES
from tallyhouse.session import session_builder

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "settlement_by_product", "settlement_by_product_all_time", "settlement_summary", "settlement_monthly", "payment_mix",
    "daily_sales_filled", "dashboard_kpis", "top_products", "recent_orders", "order_product_names", "order_list_by_product_search",
    "customer_rfm", "customer_grades", "customer_kpis", "customer_360", "latest_orders_per_user", "product_stats", "review_summary",
    "cart_totals", "orders_with_items_json", "catalog_view", "price_orders", "quote_coupons", "claim_coupons", "link_identities",
    "reconcile_payments", "apply_payments", "grant_downloads", "refund_items", "refund_orders", "like_counts", "point_balances",
    "point_balance_running", "upsert_latest", "validate_reviews", "check_unique", "check_foreign_keys", "document_keyword_search",
    "stream_daily_sales", "stream_counters",
]


def main(names):
    spark = session_builder("bench").master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS) \
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name):
        begin = time.perf_counter()
        QUERIES[name].run(spark, FOLDER).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    for name in names:
        seconds(name)
    timed = {name: round(statistics.median(seconds(name) for _ in range(RUNS)), 3) for name in names}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(timed.values()), 3), "unit": "sec",
                      "queries": timed, "sf": os.path.basename(FOLDER.rstrip("/")), "cpus": CPUS,
                      "spark": spark.version, "runs": RUNS}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
