"""Mixing sources to target weights.

``targets`` spreads a share of all words over the sources by weight; no source gets more than ``most`` times its words,
and the excess goes to the others by weight until none is above.

``mixed_blocks`` fills the targets: each source's documents are put in a permuted order, the order is passed through as
often as the target asks, and the last pass stops at the exact word, so of its last document only its first words count.
The passes are cut into blocks of ``block_words``; a multivariate-hypergeometric splitting tree deals every source's
block quota out to the output shards, and each shard draws its blocks disjointly from the permuted ones and orders its
rows anew.  The mix takes what the shards draw: a block that the tree deals to none is in no shard and does not count.

Defined cases: a null text has no words, and such documents and those of sources without words are taken 0 times; a
null source is a source of its own, the last one; null doc_ids and repeated rows each count as documents (equal ids are
ordered by text); an empty table gives no rows.  Other columns are ignored.  Reruns agree, as order and draws follow
from hashes of ids and a seed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import run_dir
from .splitters import parts_of

WEIGHTS = (3.0, 1.0, 2.0)
#: Ranges of the permuted order whose sums are added up first, so that no task meets a whole source.
STEPS = 1024
#: The splitting tree runs on one number per source and shard; more sources than this are refused.
MOST_SOURCES = 100_000


def key_of(tie: str = "tie") -> F.Column:
    """One text that tells documents apart by doc_id, source and text digest, nulls too."""
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    return F.md5(F.concat(F.col(tie), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), source))


def keyed(documents: DataFrame) -> DataFrame:
    """(key, doc_id, text, lang, source) once for rows that repeat a doc_id, source and text; of their langs the smallest."""
    tied = documents.withColumn("tie", F.md5(F.coalesce("text", F.lit("")))).withColumn("key", key_of())
    one = lambda c: F.any_value(c).alias(c)
    return tied.groupBy("key").agg(one("doc_id"), one("text"), F.min("lang").alias("lang"), one("source"))


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw, tie): the number of words, and the place in the permuted order."""
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix"))), 1, 12), 16, 10).cast("long")
    return documents.select("doc_id", "source", size.alias("size"), draw.alias("draw"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size).  Sources are capped in the order of cap by weight; the first k
    are capped exactly where the rest of the words, spread over the remaining weight, reaches their caps."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    named = named.withColumn("left", F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) \
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    named = named.withColumn("capped", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
    first_open = F.first(F.when(~F.col("capped"), F.col("left") / F.col("open")), ignorenulls=True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return named.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * first_open).alias("target"))


def placed(sizes: DataFrame) -> DataFrame:
    """Adds ``before``: the source's words ahead of the document in the permuted order.  Sums of the order's ranges come
    first, so that the fine sums stay within a range."""
    step = F.floor(F.col("draw") / F.lit((1 << 48) // STEPS)).cast("int")
    stepped = sizes.withColumn("step", step)
    sums = stepped.groupBy("source", "step").agg(F.sum("size").alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("of_source"), F.col("step").alias("of_step"), ahead.alias("ahead"))
    fine = Window.partitionBy("source", "step").orderBy("draw", F.col("doc_id").asc_nulls_last(), "tie")
    within = stepped.withColumn("inside", F.coalesce(F.sum("size").over(fine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("nth", F.row_number().over(Window.partitionBy("source", "step", "draw", "doc_id", "tie").orderBy(F.lit(0))))
    return within.join(sums, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("step") == F.col("of_step"))) \
        .select("doc_id", "source", "size", "tie", "nth", (F.col("ahead") + F.col("inside")).cast("long").alias("before"))


def taken_words(documents: DataFrame, **rule) -> DataFrame:
    """(doc_id, source, tie, nth, size, before, source_size, target, passes, rest, taken)."""
    sizes = sized(documents)
    goals = targets(sizes, **rule).select(F.col("source").alias("goal_source"), "source_size", "target")
    known = placed(sizes).join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    wanted = F.round("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    known = known.withColumn("passes", F.floor(wanted / size).cast("long")).withColumn("rest", wanted - F.col("passes") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return known.withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long"))


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """The splitting tree: an array (shards, sources) whose columns add up to ``counts``.  At each node the left half of
    the shards gets its exact share of the blocks, composed by one multivariate-hypergeometric draw."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    share = int(counts.sum()) * left // shards
    drawn = rng.multivariate_hypergeometric(counts, share, method="marginals") if counts.sum() else counts * 0
    return np.vstack([split(drawn, left, rng), split(counts - drawn, shards - left, rng)])


def mixed_blocks(documents: DataFrame, shards: int = 16, block_words: int = 100_000, seed: int = 7, **rule) -> DataFrame:
    """One row per document and pass it is taken in: (doc_id, source, tie, nth, size, source_size, target, taken, pass_no,
    words, block, shard, position); documents that are not taken have one row with null pass_no.

    The split needs each source's block count, one row per source, on the driver (``MOST_SOURCES`` at most).  A source's
    blocks are permuted by ``(block * stride + shift) mod n``, and the shards draw consecutive ranges of that order.
    """
    spark = documents.sparkSession
    folder = run_dir(spark, "mix")
    taken_words(documents, **rule).write.parquet(f"{folder}/taken")
    taken = spark.read.parquet(f"{folder}/taken")
    blocks = F.ceil((F.col("passes") * F.col("source_size") + F.col("rest")) / block_words)
    quotas = taken.groupBy("source").agg(F.max(blocks).alias("blocks")).orderBy(F.col("source").asc_nulls_last()).limit(MOST_SOURCES + 1).collect()
    if len(quotas) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rng = np.random.default_rng(seed)
    dealt = split(np.array([q["blocks"] for q in quotas], np.int64), shards, rng) if quotas else np.zeros((shards, 0), np.int64)
    rows = []
    for i, quota in enumerate(quotas):
        n = max(1, int(quota["blocks"]))
        stride = next(a for a in range(int(rng.integers(n)) + 1, 2 * n + 2) if math.gcd(a, n) == 1)
        rows.append((quota["source"], n, stride, int(rng.integers(n)), np.cumsum(dealt[:, i]).tolist()))
    kind = documents.schema["source"].dataType.simpleString()
    owner = spark.createDataFrame(rows, f"owner_source {kind}, n bigint, stride bigint, shift bigint, ends array<bigint>")
    passes = F.sequence(F.lit(0).cast("long"), F.when(F.col("before") < F.col("rest"), F.col("passes")).otherwise(F.col("passes") - 1))
    passes = F.when((F.col("size") > 0) & (F.col("taken") > 0), passes)
    copies = taken.withColumn("pass_no", F.explode_outer(passes))
    words = F.when(F.col("pass_no") < F.col("passes"), F.col("size")).otherwise(F.least(F.col("size"), F.col("rest") - F.col("before")))
    block = F.floor((F.col("pass_no") * F.col("source_size") + F.col("before")) / block_words)
    copies = copies.withColumn("words", words).withColumn("block", block)
    copies = copies.join(owner, F.col("source").eqNullSafe(F.col("owner_source"))) \
        .withColumn("drawn", (F.col("block") * F.col("stride") + F.col("shift")) % F.col("n")) \
        .withColumn("place", F.expr("size(filter(ends, e -> e <= drawn))")).withColumn("shard", F.when(F.col("place") < shards, F.col("place")))
    position = F.xxhash64(F.col("doc_id"), F.col("pass_no"), F.col("shard"), F.lit(seed))
    return copies.select("doc_id", "source", "tie", "nth", "size", "source_size", "target", "taken", "pass_no", "words", "block", "shard",
                         F.when(F.col("pass_no").isNotNull(), position).alias("position"))


def per_document(copies: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, n_copies) per document: the words, and the copies, that the shards have drawn of it."""
    drawn = F.col("pass_no").isNotNull() & F.col("shard").isNotNull()
    one = lambda c: F.any_value(c).alias(c)
    return copies.groupBy("doc_id", "source", "tie", "nth").agg(
        one("size"), one("source_size"), one("target"), F.coalesce(F.sum(F.when(drawn, F.col("words"))), F.lit(0)).cast("long").alias("taken"),
        F.count_if(drawn).alias("n_copies")).drop("source", "tie", "nth")


def locally_shuffled(copies: DataFrame, shards: int = 16) -> DataFrame:
    """Taken rows ordered by position within each shard.  A shard is dealt out in pieces of its positions, several to a task and none too large for one."""
    parts = parts_of(copies.sparkSession)
    piece = F.floor(F.col("position").cast("double") / 2.0 ** 64 * math.ceil(4 * parts / shards))
    return copies.withColumn("piece", piece).repartition(parts, "shard", "piece").sortWithinPartitions("shard", "position").drop("piece")
