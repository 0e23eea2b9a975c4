"""Catalog files, CSV, bundles and the shared folder."""

import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyhouse import session
from tallyhouse.functions import dates
from tallyhouse.operators import reports
from tallyhouse.sources import bundles, catalog


def test_array_file_and_lines_read_alike(spark, tmp_path):
    rows = [{"id": "1", "name": "a", "cat": "excel", "price": 0, "visible": True, "views": 3},
            {"id": "2", "name": "b", "cat": "web", "price": 5, "detailImageUrls": ["u"]}]
    (tmp_path / "catalog.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "lines.json").write_text(json.dumps(rows))
    found = catalog.read_catalog(spark, str(tmp_path / "catalog.json")).orderBy("id").collect()
    assert [(r.id, r.price, r.views, r.detailImageUrls) for r in found] == [("1", 0, 3, None), ("2", 5, None, ["u"])]
    assert catalog.read_catalog_lines(spark, str(tmp_path / "lines.json")).orderBy("id").collect() == found


def test_array_files_split_and_hold_every_row(spark, folder):
    rows = spark.range(95).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("name"), F.lit("big").alias("detailImages"))
    catalog.write_array_files(rows, folder, "id", rows_per_file=10)
    files = glob.glob(folder + "/*.txt")
    assert len(files) == 10
    stored = [row for f in files for row in json.loads(open(f).read())]
    assert sorted(int(r["id"]) for r in stored) == list(range(95)) and all(set(r) == {"id", "name"} for r in stored)
    assert catalog.read_catalog(spark, folder).count() == 95


def test_spellings_and_defaults(spark):
    first = spark.createDataFrame([("1", "a", "excel", "", None, False, "2026-05-10")],
                                  "id string, name string, cat string, type string, price int, visible boolean, date string")
    second = spark.createDataFrame([("2", "b", "web", "inquiry", 7, 0, 3, True, "2026-01-02T03:04:05Z")],
                                   "productId string, productName string, category string, sale_type string, price int, discount int, "
                                   "discountPrice int, is_active boolean, created_at string")
    third = spark.createDataFrame([("3", "c")], "id string, name string")
    found = [tuple(r) for r in catalog.merge_catalogs(first, second, third).orderBy("id").collect()]
    assert found == [("1", "a", "excel", "file", "📦", 0, 0, False, "2026-05-10"),
                     ("2", "b", "web", "inquiry", "📦", 7, 3, True, "2026-01-02"),
                     ("3", "c", None, "file", "📦", 0, 0, True, "")]


def test_csv_quotes_and_labels(spark, folder):
    rows = spark.createDataFrame([("1", 'say "hi", now', "excel", 5, 0, "file", True, "2026-05-10"),
                                  ("2", "line\nbreak", "other", 0, 0, "inquiry", False, "")],
                                 "id string, name string, cat string, price bigint, discount bigint, type string, visible boolean, date string")
    catalog.export_csv(rows.coalesce(1), folder)
    raw = open(glob.glob(folder + "/*.csv")[0], encoding="utf-8").read()
    assert raw.startswith('"ID","상품명","카테고리","판매가","할인가","판매유형","노출","등록일"\n')
    assert '"1","say ""hi"", now","엑셀 프로그램","5","0","파일판매","ON","2026-05-10"' in raw
    back = catalog.read_csv_export(spark, folder).orderBy("ID").collect()
    assert back[0][1] == 'say "hi", now' and back[1][1] == "line\nbreak" and back[1][2] == "other"


def test_marked_csv_begins_with_the_mark(spark, folder):
    rows = spark.createDataFrame([(str(i), 'say "hi", now' if i % 2 else "line\nbreak", "excel", i, 0, "file", True, None) for i in range(40)],
                                 "id string, name string, cat string, price bigint, discount bigint, type string, visible boolean, date string")
    catalog.export_marked_csv(rows, folder, 3)
    files = glob.glob(folder + "/file=*/*.txt")
    assert len(files) == 3
    for name in files:
        raw = open(name, "rb").read()
        assert raw.startswith("\ufeff\"ID\",\"상품명\"".encode()) and raw.count("\ufeff".encode()) == 1
    back = catalog.read_csv_export(spark, folder)
    assert sorted((r[0], r[1], r[3]) for r in back.collect()) == sorted((r.id, r.name, str(r.price)) for r in rows.collect())
    catalog.export_marked_csv(rows.limit(0), folder + "-empty", 2)
    assert catalog.read_csv_export(spark, folder + "-empty").count() == 0


def test_bundles_on_disk(shop, spark, folder):
    full = bundles.user_bundles(shop.users, shop.orders, shop.items, shop.products, shop.downloads, shop.user_reviews,
                                shop.typed_ledger, "2024-01-31")
    bundles.write_bundles(full, folder, buckets=3)
    assert len(glob.glob(folder + "/bucket=*")) == 3
    back = spark.read.schema(full.schema).json(folder)
    assert back.filter("section = 'profile'").count() == shop.users.count()
    assert back.filter("section = 'orders'").select(F.sum(F.size("orders.items"))).first()[0] == shop.items.count()


def test_bundles_take_a_fraction_of_their_text(shop, folder):
    full = bundles.user_bundles(shop.users, shop.orders, shop.items, shop.products, shop.downloads, shop.user_reviews,
                                shop.typed_ledger, "2024-01-31").repartition(2, "user_id")
    bundles.write_bundles(full, folder, buckets=2)
    text = full.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    assert 4 * sum(os.path.getsize(f) for f in glob.glob(folder + "/bucket=*/*")) < text


def test_bundles_hold_known_users_only(spark):
    at = dt.datetime(2001, 6, 3)
    users = spark.createDataFrame([(1, "a", "n", "p"), (1, "a", "n", "p"), (2, None, None, None)], "user_id bigint, email string, name string, provider string")
    orders = spark.createDataFrame([(i, u, 5, "paid", at, at) for i, u in enumerate([1, 2, 3, None])] + [(0, 1, 5, "paid", at, at)],
                                   "order_id bigint, user_id bigint, final_amount bigint, status string, paid_at timestamp_ntz, created_at timestamp_ntz")
    items = spark.createDataFrame([(i, 7, 1, 5) for i in range(4)], "order_id bigint, product_id bigint, line_no int, price bigint")
    products = spark.createDataFrame([(7, "x", "c")], "product_id bigint, name string, category string")
    rights = spark.createDataFrame([(u, 7, at) for u in (1, 3, None)], "user_id bigint, product_id bigint, created_at timestamp_ntz")
    reviews = spark.createDataFrame([(9, u, 7, 4, at) for u in (2, 3, None)],
                                    "review_id bigint, user_id bigint, product_id bigint, rating int, created_at timestamp_ntz")
    ledger = spark.createDataFrame([(4, u, 1, "t", at) for u in (2, 2, 3, None)],
                                   "entry_id bigint, user_id bigint, amount bigint, type string, created_at timestamp_ntz")
    full = bundles.user_bundles(users, orders, items, products, rights, reviews, ledger, "2024-01-31")
    assert sorted((r.section, r.user_id) for r in full.collect()) == [
        ("downloads", 1), ("orders", 1), ("orders", 1), ("orders", 2), ("point_history", 2), ("point_history", 2),
        ("profile", 1), ("profile", 1), ("profile", 2), ("reviews", 2)]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == named
    first, second = session.run_dir(spark, "x"), session.run_dir(spark, "x")
    assert first.startswith(named + "/x-") and first != second


class Unset:
    """A session in which no checkpoint folder is named."""

    def __init__(self, master):
        self.master, self.folder, self.conf, self.sparkContext = master, None, self, self

    def get(self, key, default=None):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.shared_dir(Unset("yarn"))


def test_local_session_gets_one_folder():
    local = Unset("local[2]")
    assert session.shared_dir(local) == session.shared_dir(local) == local.folder


def test_a_day_column_prunes_the_scan(spark, folder):
    """Without it the reader hands over every row, as it does not skip by TIMESTAMP_NTZ."""
    at = F.timestamp_add("HOUR", F.col("id").cast("int"), dates.ntz("2001-01-01"))
    rows = spark.range(24 * 40).select(F.col("id").alias("order_id"), F.lit("paid").alias("status"), F.lit(1).cast("decimal(18,0)").alias("final_amount"),
                                       at.alias("paid_at")).withColumn("paid_day", F.col("paid_at").cast("date"))
    rows.write.partitionBy("paid_day").parquet(folder + "/by-day")
    stored = spark.read.parquet(folder + "/by-day")

    def rows_read(report):
        found = report.collect()
        node = report._jdf.queryExecution().executedPlan()
        while not node.nodeName().startswith("Scan"):
            if node.nodeName() == "AdaptiveSparkPlan":
                node = node.executedPlan()
            elif node.nodeName().endswith("QueryStage"):
                node = node.plan()
            else:
                assert node.children().nonEmpty(), node.nodeName()
                node = node.collectLeaves().apply(0)
        return found, node.metrics().apply("numOutputRows").value()

    for make, n in ((lambda d: reports.day_kpi(stored, "2001-01-10", day=d), 24),
                    (lambda d: reports.month_kpi(stored, "2001-02-03", day=d), 24 * 9),
                    (lambda d: reports.settlement_summary(stored, "2001-01-05", "2001-01-06", day=d), 48)):
        pruned, all_rows = rows_read(make("paid_day")), rows_read(make(None))
        assert pruned[0] == all_rows[0] and pruned[1] == n and all_rows[1] == 24 * 40
