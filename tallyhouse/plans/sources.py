"""Source and sink queries.  Written files go below the shared folder."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import catalog as catalog_operators
from ..session import run_dir
from ..sources import bundles, catalog
from ..sources.tables import TABLES, load_tables
from .output import plain
from .registry import query
from .shop import CATEGORIES, EVENTS_AS_OF


@query("S1", sql="\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS n_rows FROM {t}" for t in TABLES))
def table_inventory(shop):
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
              for name, df in load_tables(shop.spark, shop.folder).items()]
    return reduce(DataFrame.unionByName, counts)


def _catalog(shop, products=None):
    """Products in the catalog file's layout."""
    return (shop.products if products is None else products).select(
        F.col("product_id").cast("string").alias("id"), F.col("name"), F.col("category").alias("cat"),
        "price", F.col("discount_price").alias("discount"),
        F.col("sale_type").alias("type"), F.col("is_active").alias("visible"),
        F.date_format("created_at", "yyyy-MM-dd").alias("date"), F.col("new_badge").alias("newBadge"),
        F.array(F.col("description"), F.col("name")).alias("detailImages"))


CATALOG = """
SELECT CAST(product_id AS VARCHAR) AS id, name, category AS cat, price,
       CAST(discount_price AS BIGINT) AS discount, sale_type AS type, is_active AS visible,
       strftime(created_at, '%Y-%m-%d') AS date, new_badge AS "newBadge"
FROM shop_products
"""
COLUMNS = ["id", "name", "cat", "price", "discount", "type", "visible", "date", "newBadge"]


@query("S2", sql=CATALOG)
def catalog_from_array_files(shop):
    path = run_dir(shop.spark, "catalog-arrays")
    catalog.write_array_files(_catalog(shop), path, "id", rows_per_file=5_000)
    return catalog.read_catalog(shop.spark, path).select(*COLUMNS)


@query("S4 S2", sql=CATALOG)
def catalog_from_lines(shop):
    path = run_dir(shop.spark, "catalog-lines")
    catalog.write_catalog(_catalog(shop), path)
    return catalog.read_catalog_lines(shop.spark, path).select(*COLUMNS)


@query("S3 X19", sql="""
SELECT CAST(product_id AS VARCHAR) AS id, name, category AS cat,
       CASE WHEN coalesce(sale_type, '') = '' THEN 'file' ELSE sale_type END AS type, '📦' AS emoji,
       price, CAST(coalesce(discount_price, 0) AS BIGINT) AS discount, is_active AS visible,
       strftime(created_at, '%Y-%m-%d') AS date
FROM shop_products
""")
def catalog_normalized(shop):
    rows = _catalog(shop).withColumn("size", F.col("price"))
    older = rows.filter(F.col("newBadge")).select(
        F.col("id").alias("productId"), F.col("name").alias("productName"), F.col("cat").alias("category"), "price",
        F.col("discount").alias("discount_price"), F.col("type").alias("saleType"), F.col("visible").alias("is_active"),
        F.concat("date", F.lit("T00:00:00Z")).alias("created_at"))
    newer = rows.filter(~F.col("newBadge")).drop("newBadge", "size", "detailImages")
    return catalog.merge_catalogs(newer, older)


@query("S5 J14", sql="""
SELECT CAST(product_id AS VARCHAR) AS id, name || ' "' || description || '", new' AS name, coalesce(l.label, p.category) AS category,
       CAST(price AS VARCHAR) AS price, CASE WHEN is_active THEN 'ON' ELSE 'OFF' END AS shown,
       CASE WHEN coalesce(sale_type, '') = '' THEN '파일판매' ELSE '문의형' END AS sale, strftime(created_at, '%Y-%m-%d') AS date
FROM shop_products p LEFT JOIN shop_category_labels l ON l.code = p.category
""")
def catalog_csv(shop):
    path = run_dir(shop.spark, "catalog-csv")
    quoted = shop.products.withColumn("name", F.concat("name", F.lit(' "'), "description", F.lit('", new')))
    catalog.export_csv(catalog.normalize_catalog(_catalog(shop, quoted)), path, CATEGORIES)
    id_, name, category, price, _, sale, shown, date = [F.col(h) for h in catalog.CSV_HEADER]
    return catalog.read_csv_export(shop.spark, path).select(
        id_.alias("id"), name.alias("name"), category.alias("category"), price.alias("price"), shown.alias("shown"),
        sale.alias("sale"), date.alias("date"))


@query("S6 A21 J7", sql="""
WITH bought AS (SELECT o.user_id, count(DISTINCT o.order_id) AS orders, count(*) AS items, sum(i.price) AS spent
                FROM shop_orders o JOIN shop_items i USING (order_id) GROUP BY o.user_id),
rights AS (SELECT user_id, count(*) AS downloads FROM shop_downloads d JOIN shop_products p USING (product_id) GROUP BY user_id),
written AS (SELECT o.user_id, count(*) AS reviews FROM shop_reviews r JOIN shop_orders o USING (order_id) GROUP BY o.user_id),
points AS (SELECT user_id, count(*) AS points FROM shop_ledger GROUP BY user_id)
SELECT u.user_id, u.email, coalesce(b.orders, 0)::BIGINT AS orders, coalesce(b.items, 0)::BIGINT AS items,
       coalesce(b.spent, 0)::BIGINT AS spent, coalesce(r.downloads, 0)::BIGINT AS downloads,
       coalesce(w.reviews, 0)::BIGINT AS reviews, coalesce(p.points, 0)::BIGINT AS point_history
FROM shop_users u LEFT JOIN bought b USING (user_id) LEFT JOIN rights r USING (user_id)
LEFT JOIN written w USING (user_id) LEFT JOIN points p USING (user_id)
""")
def user_bundles(shop):
    path = run_dir(shop.spark, "bundles")
    full = bundles.user_bundles(shop.users, shop.orders, shop.items, shop.products, shop.downloads, shop.user_reviews,
                                shop.typed_ledger, EVENTS_AS_OF)
    bundles.write_bundles(full, path, buckets=4)
    stored = shop.spark.read.schema(full.schema).json(path)

    def entries(name):
        return F.count_if(F.col("section") == name).alias(name)

    items = F.col("orders.items")
    spent = F.aggregate(items, F.lit(0).cast("bigint"), lambda a, i: a + i["price"])
    zero = F.lit(0).cast("bigint")
    return plain(stored.withColumns({"_items": F.size(items).cast("bigint"), "_spent": spent}).groupBy("user_id").agg(
        F.max("profile.email").alias("email"), F.count_distinct("orders.order_id").alias("orders"),
        F.coalesce(F.sum("_items"), zero).alias("items"), F.coalesce(F.sum("_spent"), zero).alias("spent"),
        entries("downloads"), entries("reviews"), entries("point_history")))


@query("A20 A21", sql="""
SELECT order_id, count(*)::BIGINT AS items FROM shop_items JOIN shop_products USING (product_id) GROUP BY order_id
""")
def order_item_parts(shop):
    """Item lists cut into small pages; together they hold every item."""
    parts = catalog_operators.orders_with_items(shop.orders.select("order_id"), shop.items, shop.products, page_lines=2)
    return parts.groupBy("order_id").agg(F.sum(F.size("items")).alias("items"))
