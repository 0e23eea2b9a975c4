"""The product catalog as JSON and CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..functions.fixed_values import (CATEGORY_LABELS, CSV_HEADER, CSV_SALE_FILE, CSV_SALE_INQUIRY,
                                      DEFAULT_EMOJI, DEFAULT_SALE_TYPE)

CATALOG_SCHEMA = (
    "id string, name string, cat string, price bigint, discount bigint, type string, visible boolean, "
    "emoji string, date string, `desc` string, detail string, fileType string, fileUrl string, fileName string, "
    "newBadge boolean, bestBadge boolean, uuid string, thumbUrl string, detailImageUrls array<string>, "
    "views bigint, downloads bigint")


def read_catalog(spark: SparkSession, path: str, schema: str | StructType = CATALOG_SCHEMA) -> DataFrame:
    """Files that each hold one JSON array, pretty-printed or not.  Every file
    is one task, so a large catalog should be many files (``write_array_files``)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_catalog_lines(spark: SparkSession, path: str, schema: str | StructType = CATALOG_SCHEMA) -> DataFrame:
    """One object, or one array of objects, per line; splittable."""
    return spark.read.schema(schema).json(path)


def write_catalog(products: DataFrame, path: str, heavy: tuple[str, ...] = ("detailImages",)) -> None:
    """JSON lines without the heavy columns (embedded images)."""
    products.drop(*heavy).write.mode("errorifexists").json(path)


def write_array_files(products: DataFrame, path: str, key: str, rows_per_file: int = 10_000,
                      heavy: tuple[str, ...] = ("detailImages",)) -> None:
    """The catalog as files that each hold one JSON array of about ``rows_per_file`` objects.

    The number of files follows from a count; an array never holds more than
    its hash share of the rows.
    """
    products = products.drop(*heavy)
    files = max(1, -(-products.count() // rows_per_file))
    arrays = products.groupBy(F.pmod(F.xxhash64(key), F.lit(files)).alias("_file")) \
        .agg(F.to_json(F.collect_list(F.struct(*products.columns))).alias("value"))
    arrays.select("value").write.mode("errorifexists").option("maxRecordsPerFile", 1).text(path)


def _first_set(df: DataFrame, names: list[str], empty=None) -> Column:
    """First of the columns that is there and set; ``empty`` counts as unset."""
    given = [F.col(n) if empty is None else F.nullif(F.col(n), F.lit(empty)) for n in names if n in df.columns]
    return F.coalesce(*given) if given else F.lit(None)


def normalize_catalog(df: DataFrame) -> DataFrame:
    """One layout from the spellings a catalog row may come in, with defaults.

    Missing, null and empty values move on to the next spelling; a visibility
    flag counts as set even when false.
    """
    visible = _first_set(df, ["visible", "is_active", "visibility"])
    created = F.substring(_first_set(df, ["created_at"]).cast("string"), 1, 10)
    return df.select(
        _first_set(df, ["id", "productId"], "").cast("string").alias("id"),
        _first_set(df, ["name", "productName"], "").cast("string").alias("name"),
        _first_set(df, ["cat", "category"], "").cast("string").alias("cat"),
        F.coalesce(_first_set(df, ["type", "saleType", "sale_type"], ""), F.lit(DEFAULT_SALE_TYPE)).alias("type"),
        F.coalesce(_first_set(df, ["emoji", "selectedEmoji"], ""), F.lit(DEFAULT_EMOJI)).alias("emoji"),
        F.coalesce(_first_set(df, ["price"]), F.lit(0)).cast("bigint").alias("price"),
        F.coalesce(_first_set(df, ["discount", "discountPrice", "discount_price"], 0), F.lit(0)).cast("bigint").alias("discount"),
        F.coalesce(visible.cast("boolean"), F.lit(True)).alias("visible"),
        F.coalesce(F.nullif(_first_set(df, ["date"], "").cast("string"), F.lit("")), created, F.lit("")).alias("date"))


def merge_catalogs(*parts: DataFrame) -> DataFrame:
    """Catalogs of different layouts in one."""
    merged = normalize_catalog(parts[0])
    for part in parts[1:]:
        merged = merged.unionByName(normalize_catalog(part))
    return merged


def csv_rows(catalog: DataFrame, labels: dict[str, str] = CATEGORY_LABELS) -> DataFrame:
    """Catalog rows as shown in the CSV, under its headings."""
    cells = [F.col("id"), F.col("name"), text.label_of(F.col("cat"), labels), F.col("price"), F.col("discount"),
             F.when(F.col("type") == "file", CSV_SALE_FILE).otherwise(CSV_SALE_INQUIRY),
             F.when(F.col("visible"), "ON").otherwise("OFF"), F.col("date")]
    return catalog.select(*[c.cast("string").alias(h) for c, h in zip(cells, CSV_HEADER)])


def export_csv(catalog: DataFrame, path: str, labels: dict[str, str] = CATEGORY_LABELS) -> None:
    """Quoted CSV parts with a header each; quotes inside a cell are doubled.
    ``export_marked_csv`` adds the byte order mark some spreadsheets look for."""
    csv_rows(catalog, labels).write.mode("errorifexists") \
        .option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_marked_csv(catalog: DataFrame, path: str, files: int, labels: dict[str, str] = CATEGORY_LABELS) -> None:
    """The same as ``files`` files, ``file=0/``, ``file=1/`` and so on, each beginning with a byte order mark and the header.

    Spark's CSV writer would put the mark inside the first quotes, so the lines
    are put together here.  Rows are dealt out by a hash of all cells; ``files`` should grow with the catalog.
    """
    def line(cells: list[Column]) -> Column:
        return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells])

    rows = csv_rows(catalog, labels)
    cells = [F.col(f"`{h}`") for h in CSV_HEADER]
    lines = rows.select(F.pmod(F.xxhash64(*cells), F.lit(files)).alias("file"), F.lit(1).alias("_part"), line(cells).alias("value"))
    heads = catalog.sparkSession.range(files).select(F.col("id").alias("file"), F.lit(0).alias("_part"),
                                                     F.concat(F.lit("\ufeff"), line([F.lit(h) for h in CSV_HEADER])).alias("value"))
    lines.union(heads).repartition("file").sortWithinPartitions("file", "_part", "value").select("file", "value") \
        .write.mode("errorifexists").partitionBy("file").text(path)


def read_csv_export(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType()
    for heading in CSV_HEADER:
        schema = schema.add(heading, "string")
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


