"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import run_dir


def stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (a, b) with a > b."""
    both = links.select("a", "b").union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("least"))
    small = large.join(least, "a")
    return small.select("a", F.col("least").alias("b")).union(small.where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))) \
        .where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b), with the smallest id reachable.  Every round is written to the shared folder, as the
    next one reads it twice; the number of rounds grows with the logarithm of the largest component."""
    spark = links.sparkSession
    folder = run_dir(spark, "components")

    def written(frame: DataFrame, n: int) -> DataFrame:
        frame.write.parquet(f"{folder}/{n}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{n}")

    def print_of(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links, seen, n = written(links, 0), None, 0
    now = print_of(links)
    while now != seen and now[0]:
        seen, n = now, n + 1
        links = written(stars(links), n)
        now = print_of(links)
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")) \
        .union(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
