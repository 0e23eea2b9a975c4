"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Declared, so that opening a table starts no job to look at its files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = list(SCHEMAS)


def read_table(spark: SparkSession, folder: str, name: str, declared: bool = True) -> DataFrame:
    """One table; with ``declared`` off its schema comes from the files."""
    reader = spark.read.schema(SCHEMAS[name]) if declared else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str, **options) -> DataFrame:
    """A table as a stream, be it one file or a folder of part files.  A stream's plain path has to be a folder; a pattern may be either."""
    return spark.readStream.schema(SCHEMAS[name]).options(**options).parquet(f"{folder.rstrip('/')}/{name}.parque[t]")


def load_tables(spark: SparkSession, folder: str, names=TABLES) -> dict[str, DataFrame]:
    """Lazy scans by name; columns and filters are pushed into each by its use."""
    return {name: read_table(spark, folder, name) for name in names}


def key_ranges(key: str, cuts: list[str]) -> list[str]:
    """SQL conditions that are disjoint and cover all rows, null keys too: one
    range of ``key`` per gap between the rising texts ``cuts``."""
    cuts = sorted(set(cuts))
    literals = ["'" + c.replace("'", "''") + "'" for c in cuts]
    if not cuts:
        return ["1 = 1"]
    return [f"{key} < {literals[0]} OR {key} IS NULL",
            *(f"{key} >= {low} AND {key} < {high}" for low, high in zip(literals, literals[1:])), f"{key} >= {literals[-1]}"]


def uuid_cuts(partitions: int) -> list[str]:
    """UUIDs that cut the space of all UUIDs into ``partitions`` ranges of about one size; random keys spread evenly over them."""
    edges = [(i << 128) // partitions for i in range(1, partitions)]
    return [f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}" for h in (f"{e:032x}" for e in edges)]


def sampled_cuts(keys: DataFrame, key: str, partitions: int, sample: int = 10_000) -> list[str]:
    """Cuts at the quantiles of ``sample`` keys, for text keys that are not spread evenly (time-ordered UUIDs, say).
    ``keys`` may be a JDBC read of a sampling query."""
    found = sorted(r[0] for r in keys.filter(F.col(key).isNotNull()).select(F.col(key).cast("string")).limit(sample).collect())
    return sorted({found[len(found) * i // partitions] for i in range(1, partitions)}) if found else []


def read_jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int | None = None, upper: int | None = None,
                    partitions: int = 8, cuts: list[str] | None = None, **options) -> DataFrame:
    """A relational table read in ``partitions`` ranges of its key at once: of
    whole numbers between ``lower`` and ``upper``, or else of texts between
    ``cuts``, by default those of UUIDs."""
    if lower is None or upper is None:
        ranges = key_ranges(key, uuid_cuts(partitions) if cuts is None else cuts)
        return spark.read.jdbc(url, table, predicates=ranges, properties={"fetchsize": "10000", **options})
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, fetchsize=10_000, **options).load()
