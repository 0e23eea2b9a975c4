"""Building blocks that keep hot keys from landing whole in one task.

Plain joins and aggregates are left to Spark: aggregates combine on the map
side, and adaptive execution splits skewed join partitions.  What Spark does
not split is a window or a collected list over one hot key; those cases are
handled here, exactly and without dropping rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Lines of a page of a list that cannot be bounded otherwise.
PAGE_LINES = 1000
#: About how many rows of one (key, bucket) a window may hold before it is cut into ranges, and how finely hot buckets are sampled.
RANGE_ROWS, SAMPLES_PER_RANGE = 1_000_000, 32


def join_measured(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join whose partitioning by ``keys`` is shared with no other step.

    Where a side was itself grouped by the keys, or the result is grouped by
    them next, Spark reuses the partitioning; adaptive execution then neither
    sees the right side's size (to broadcast it when small) nor may split the
    left side's hot partitions.  Joining on the keys and their hash keeps the
    shuffles apart, which allows both.
    """
    tag = F.xxhash64(*keys)
    return left.withColumn("_hash", tag).join(right.withColumn("_hash", tag), [*keys, "_hash"], how).drop("_hash")


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int,
                  rank: str = "position") -> DataFrame:
    """The first n rows per key, with their 1-based position.

    Spark plans the rank filter as a group limit before the shuffle, so each
    map task ships at most n rows of a key however many it holds.  ``order``
    has to end in a unique column.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def page_of(line: str = "line_no", page_lines: int = PAGE_LINES) -> Column:
    """The page a line stands on.  Only the line's own number decides, so the
    lists of all keys are cut alike and none has to be counted first.  Lines
    are unique within a key; one without a number stands on page 0."""
    return F.coalesce(F.floor(F.col(line) / page_lines), F.lit(0)).cast("bigint")


def collect_pages(lines: DataFrame, keys: list[str], entry: Column, name: str) -> DataFrame:
    """One sorted list per (keys, page_no).  Read in the order of the pages,
    the lists of a key are the whole list, where ``entry`` starts with the line."""
    return lines.groupBy(*keys, "page_no").agg(F.sort_array(F.collect_list(entry)).alias(name))


def cut_buckets(df: DataFrame, key: str, order: list[str], bucket: Column, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``_bucket``, a struct that ascends with ``order`` within a key: the
    given bucket and, where a (key, bucket) holds more than about
    ``range_rows`` rows, the range of ``order`` the row lies in.

    The cuts are every ``SAMPLES_PER_RANGE``-th row of a sample that a hash of
    the row's own order decides, so reruns and the branches of a plan agree,
    and a bucket too small to be cut has next to no rows in it.  Rows compare
    with the cuts in two steps, so a row costs the root of their number.
    """
    at = F.struct(*order)
    rows = df.withColumn("_at", at).withColumn("_hour", bucket)
    stride = max(1, range_rows // SAMPLES_PER_RANGE)
    sample = rows.filter(F.pmod(F.xxhash64(key, *order), F.lit(stride)) == 0) \
        .groupBy(F.col(key).alias("_key"), F.col("_hour").alias("_of")).agg(F.sort_array(F.collect_list("_at")).alias("_sample")) \
        .filter(F.size("_sample") >= 2 * SAMPLES_PER_RANGE)
    every = F.filter("_sample", lambda x, i: (i + 1) % SAMPLES_PER_RANGE == 0)
    cuts = sample.withColumn("_cuts", every).withColumn("_wide", F.ceil(F.sqrt(F.size("_cuts"))).cast("int")) \
        .withColumn("_blocks", F.transform(F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / F.col("_wide")).cast("int")),
                                           lambda i: F.slice("_cuts", i * F.col("_wide") + 1, F.col("_wide")))) \
        .select("_key", "_of", "_wide", "_blocks", F.transform("_blocks", lambda b: b[0]).alias("_firsts"))
    found = rows.join(cuts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_hour").eqNullSafe(F.col("_of")), "left")
    block = F.size(F.filter("_firsts", lambda c: c <= F.col("_at"))) - 1
    inside = F.size(F.filter(F.get("_blocks", block), lambda c: c <= F.col("_at")))
    part = F.when(F.col("_firsts").isNull() | (block < 0), F.lit(0)).otherwise(block * F.col("_wide") + inside)
    return found.withColumn("_bucket", F.struct(F.col("_hour"), part.alias("_range"))) \
        .drop("_at", "_hour", "_key", "_of", "_wide", "_blocks", "_firsts")


def running_sums(df: DataFrame, key: str, order: list[str], bucket: Column, value: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Running sum and running minimum of that sum per key, in ``order``.

    A segmented scan in two levels, so that a hot key is split: within (key,
    bucket) by a window, then over the few bucket totals per key.  ``bucket`` has to ascend
    with ``order`` (a time truncated to hours, say), and ``order`` has to be
    unique within a key; a bucket with very many rows is cut into ranges of ``order``.
    Adds ``running_sum`` and ``running_min`` (at most 0).
    """
    rows = cut_buckets(df, key, order, bucket, range_rows)
    inside = Window.partitionBy(key, "_bucket").orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_sum", F.sum(value).over(inside)) \
        .withColumn("_min", F.min("_sum").over(inside))
    starts = bucket_starts(
        rows.groupBy(key, "_bucket").agg(F.sum(value).alias("total"), F.min("_sum").alias("low")), key)
    return rows.join(starts.select(key, "_bucket", "_before", "_low_before"), [key, "_bucket"]) \
        .withColumn("running_sum", F.col("_before") + F.col("_sum")) \
        .withColumn("running_min", F.least(F.col("_low_before"), F.col("_before") + F.col("_min"))) \
        .drop("_bucket", "_sum", "_min", "_before", "_low_before")


def bucket_starts(buckets: DataFrame, key: str, bucket: str = "_bucket") -> DataFrame:
    """Carry bucket totals along each key.  Input: key, bucket, ``total`` and
    ``low`` (lowest running sum inside the bucket).  Adds the sum before the
    bucket and the lowest running sum before it, starting from 0."""
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return buckets \
        .withColumn("_before", F.coalesce(F.sum("total").over(before), F.lit(0) * F.col("total"))) \
        .withColumn("_low", F.col("_before") + F.col("low")) \
        .withColumn("_low_before", F.least(F.lit(0) * F.col("total"),
                                           F.coalesce(F.min("_low").over(before), F.lit(0) * F.col("total"))))
