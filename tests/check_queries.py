"""Run registered queries against their SQL: check_queries.py [folder] [name ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyhouse.plans.all import QUERIES  # noqa: E402
from tallyhouse.session import session_builder  # noqa: E402
from tests import oracle  # noqa: E402

TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}


def main(folder, names):
    spark = session_builder().master("local[8]").config("spark.ui.enabled", "false") \
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db = oracle.connect(folder)
    failed = 0
    for name in names or QUERIES:
        q = QUERIES[name]
        begin = time.time()
        try:
            df = q.run(spark, folder)
            if q.sql is None:
                print(f"rows {name} {df.count()} {time.time() - begin:.1f}s", flush=True)
                continue
            n, expected, found = oracle.compare(df, db, q.sql)
            odd = {c: (found[c], t) for c, t in expected.items() if TYPES.get(t) != found[c]}
            print(f"{'ok  ' if n else 'EMPTY'} {name} {n} {time.time() - begin:.1f}s {odd or ''}", flush=True)
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name} {type(error).__name__}: {str(error)[:600]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
