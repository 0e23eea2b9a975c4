"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by pseudo-rotations (three rounds of random signs and a fast Hadamard transform) and hashed to
the nearest signed axis.  A table's bucket is the axis of one rotation and, to keep buckets from growing with the table (``bucket_rows``),
that of a second rotation among fewer dimensions.  A query looks into the buckets with the smallest loss of projection in each table
(multiprobe), and all vectors found there are scored exactly.  Split buckets part near vectors more often, so the probes grow with the
square root of the number of buckets an axis is split into.

Equal vectors are hashed once, with the ``count + 1`` smallest of their ids, as no query can have more of them as neighbours; queries of equal
vectors ask once too, and each leaves itself out of the common answer.  (A vec_id with several vectors asks for itself.)  The vectors of a
bucket and the queries that probe it are dealt out in blocks of about ``block_rows``; every block of queries meets every block of vectors, and
each meeting yields no more than ``count + 1`` a query.  So no vector is left out and no bucket lies in one task.

A query that has met fewer than ``count`` vectors though there are more looks again, into ``WIDER`` times the buckets each round
and at last into all of them, so that small tables and lonely vectors lose no neighbour.

Vectors that are null, empty, all zero or hold null or non-finite components take no part.  Only vectors of one length are
compared with each other.  Equal scores are ordered by vec_id; rows with the same vec_id and vector count as one, and a query's own vec_id is never its
neighbour; an empty table gives no rows.  Other columns are ignored.  Vectors are hashed by direction, so
recall is meant for vectors of about equal norm; the score is always the inner product of the original vectors, summed in order in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import run_dir

TABLES, PROBES, BUCKET_ROWS, BLOCK_ROWS, SEED = 10, 16, 192, 2_048, 11
#: How many times the buckets the next round probes for queries with too few hits.
WIDER = 8

#: More lengths of vectors than this are refused; one row for each comes to the driver.
MOST_LENGTHS = 10_000

#: ``digest`` tells vectors apart, ``ids`` are the smallest that have one.
CLASS = "digest bigint, ids array<bigint>, vector array<double>"
#: ``own`` holds the id of a query that asks for itself and is empty for what all queries of a vector ask.
MEMBER = "vec_id bigint, digest bigint, own array<bigint>"
ASKED = "digest bigint, own array<bigint>, vector array<double>"
HASHED = ", slot int, bucket bigint"
FOUND = "own array<bigint>, digest bigint, vec_id bigint, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def rotated(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    """One pseudo-rotation of unit rows."""
    n, d = x.shape
    wide = max(2, 1 << (d - 1).bit_length())
    x = np.concatenate([x, np.zeros((n, wide - d))], axis=1)
    rng = np.random.default_rng([seed, number, wide])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], wide)) / np.sqrt(wide)
    return x


def fine_dims(rows: int, dims: int, bucket_rows: int) -> int:
    """How many dimensions of the second rotation are told apart (0: none): the buckets grow in number with the rows."""
    wide = max(2, 1 << (dims - 1).bit_length())
    buckets = rows / bucket_rows / (2 * wide)
    return 0 if buckets < 2 else min(wide, 1 << int(np.log2(buckets / 2)))


def probes_for(probes: int, fine: int) -> int:
    """How many buckets a table is probed in: ``probes``, and more where ``fine`` splits the buckets of an axis."""
    return math.ceil(probes * math.sqrt(max(1, 2 * fine)))


def axes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row all signed axes by falling projection, and how far each falls short of the best."""
    both = np.concatenate([turned, -turned], axis=1)
    order = np.argsort(-both, axis=1, kind="stable")
    value = np.take_along_axis(both, order, axis=1)
    return order, value[:, :1] - value


def buckets(unit: np.ndarray, table: int, fine: int, probes: int, seed: int) -> np.ndarray:
    """(rows, probes) buckets, best first."""
    order, short = axes(rotated(unit, 2 * table, seed))
    order, short = order[:, :probes], short[:, :probes]
    if not fine:
        return order.astype(np.int64)
    second, lack = axes(rotated(unit, 2 * table + 1, seed)[:, :fine])
    second, lack = second[:, :probes], lack[:, :probes] * np.sqrt(fine / unit.shape[1])
    # Both lists rise, so a pair has (i + 1)(j + 1) - 1 pairs at least before it.
    i, j = np.divmod(np.arange(short.shape[1] * lack.shape[1]), lack.shape[1])
    near = (i + 1) * (j + 1) <= probes
    i, j = i[near], j[near]
    loss = short[:, i] ** 2 + lack[:, j] ** 2
    both = order[:, i] * (2 * fine) + second[:, j]
    best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(both, best, axis=1).astype(np.int64)


def hasher(fines: dict[int, int], tables: int, probes: dict[int, int], seed: int):
    """``fines`` and ``probes`` by vector length."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            if not batch.num_rows:
                continue
            sizes = np.asarray(vectors.value_lengths())
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                step = max(1, min(1_000, 16_000 // probes[int(d)]))
                for at in range(0, len(rows), step):
                    some = rows[at:at + step]
                    x = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), d)
                    largest = np.abs(x).max(axis=1, keepdims=True)
                    unit = x / largest
                    unit /= np.sqrt((unit ** 2).sum(axis=1, keepdims=True))
                    for t in range(tables):
                        found = buckets(unit, t, fines[int(d)], probes[int(d)], seed)
                        k = found.shape[1]
                        out = batch.take(pa.array(np.repeat(some, k)))
                        yield pa.RecordBatch.from_arrays(
                            [*out.columns, pa.array(np.full(len(some) * k, t + tables * int(d), np.int32)), pa.array(found.ravel())],
                            [*out.schema.names, "slot", "bucket"])

    return hashed


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products added up component by component, so equal vectors score alike wherever they stand."""
    total = np.zeros((len(queries), len(vectors)))
    for j in range(vectors.shape[1]):
        total += queries[:, j, None] * vectors[None, :, j]
    return total


def nearest_in(count: int):
    """The ``count`` nearest (id, vector) of each query in a meeting of two blocks."""
    def nearest(key, queries, vectors):
        import pandas as pd

        if not len(queries) or not len(vectors):
            return pd.DataFrame({"own": pd.Series(dtype=object), "digest": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                                 "score": pd.Series(dtype="float64")})
        held = vectors["ids"].to_list()
        sizes = np.array([len(ids) for ids in held])
        ids, begins, v = np.concatenate(held), np.cumsum(sizes) - sizes, np.stack(vectors["vector"].to_numpy())
        owner, single = np.repeat(np.arange(len(held)), sizes), np.where(sizes == 1, ids[begins], 0)
        owns, digests, found_ids, found_scores = [], [], [], []
        for at in range(0, len(queries), 256):
            some = queries.iloc[at:at + 256]
            for own, digest, row in zip(some["own"], some["digest"].to_numpy(), scores(np.stack(some["vector"].to_numpy()), v)):
                if len(own):
                    row = np.where((sizes == 1) & (single == own[0]), -np.inf, row)
                near = row >= np.partition(row, -count)[-count] if len(row) > count else np.ones(len(row), bool)
                best = np.flatnonzero((near & (row > -np.inf))[owner])
                if len(own):
                    best = best[ids[best] != own[0]]
                best = best[np.lexsort((ids[best], -row[owner[best]]))][:count]
                owns += [own] * len(best)
                digests.append(np.full(len(best), digest))
                found_ids.append(ids[best])
                found_scores.append(row[owner[best]])
        return pd.DataFrame({"own": pd.Series(owns, dtype=object), "digest": np.concatenate(digests), "vec_id": np.concatenate(found_ids),
                             "score": np.concatenate(found_scores)})

    return nearest


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector, digest) of the vectors that take part."""
    vectors = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.expr("size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND abs(x) < double('Infinity')) AND exists(vector, x -> x != 0)")
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).withColumn("digest", F.xxhash64("vector"))


def classes(vectors: DataFrame, count: int) -> DataFrame:
    """The different vectors, each with the ``count`` smallest of its ids."""
    once = vectors.dropDuplicates(["digest", "vec_id"])
    smallest = Window.partitionBy("digest").orderBy("vec_id")
    few = once.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= count)
    return few.groupBy("digest").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"))


def members(asked: DataFrame) -> DataFrame:
    """(vec_id, digest, own) of the queries."""
    several = asked.groupBy("vec_id").agg((F.min("digest") != F.max("digest")).alias("several")).where("several").select("vec_id", "several")
    own = F.when(F.col("several"), F.array("vec_id")).otherwise(F.array().cast("array<bigint>"))
    return asked.select("vec_id", "digest").distinct().join(several, "vec_id", "left").select("vec_id", "digest", own.alias("own"))


def met(vectors: DataFrame, asked: DataFrame, fines: dict[int, int], tables: int, probes: dict[int, int], count: int, block_rows: int,
        seed: int) -> DataFrame:
    """(own, digest, vec_id, score): the ``count`` nearest in the probed buckets."""
    index = vectors.mapInArrow(hasher(fines, tables, dict.fromkeys(fines, 1), seed), CLASS + HASHED)
    asked = asked.select("digest", "own", "vector").mapInArrow(hasher(fines, tables, probes, seed), ASKED + HASHED)

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("slot", "bucket").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        """Each row in one block of its own side, for every block of the other."""
        return rows.join(both, ["slot", "bucket"]).withColumn(mine, F.pmod(F.xxhash64("digest"), F.col(mine)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    both = blocks(index, "part").join(blocks(asked, "askers"), ["slot", "bucket"])
    key = ["slot", "bucket", "part", "askers"]
    found = dealt(asked, "askers", "part").groupBy(*key).cogroup(dealt(index, "part", "askers").groupBy(*key)).applyInPandas(nearest_in(count), FOUND)
    best = Window.partitionBy("own", "digest").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count).drop("rank")


def too_few(vectors: DataFrame, asked: DataFrame, found: DataFrame, count: int) -> DataFrame:
    """(digest, own) of the questions with fewer hits than ``count`` and than there are vectors of their length that may be hits."""
    hits = found.groupBy("own", "digest").agg(F.count("*").alias("hits"))
    few = asked.select("own", "digest", F.size("vector").alias("d")).join(hits, ["own", "digest"], "left") \
        .withColumn("hits", F.coalesce("hits", F.lit(0))).where(F.col("hits") < count)
    if few.isEmpty():
        return few.select("digest", "own")
    known = vectors.select("vec_id", "digest", F.size("vector").alias("d")).distinct()
    left_out = known.groupBy(F.array("vec_id").alias("own"), "d").agg(F.count("*").alias("left_out"))
    every = known.groupBy("d").agg(F.count("*").alias("every"))
    return few.join(every, "d").join(left_out, ["own", "d"], "left") \
        .where(F.col("hits") < F.col("every") - F.coalesce("left_out", F.lit(0))).select("digest", "own")


def search(embeddings: DataFrame, is_query: F.Column, count: int = 20, tables: int = TABLES, probes: int = PROBES,
           bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest found.  ``is_query`` is a condition on vec_id."""
    spark, path = embeddings.sparkSession, run_dir(embeddings.sparkSession, "nearest")
    vectors = usable(embeddings)
    classes(vectors, count + 1).write.parquet(f"{path}/classes")
    index = spark.read.schema(CLASS).parquet(f"{path}/classes")
    members(vectors.where(is_query)).write.parquet(f"{path}/members")
    mine = spark.read.schema(MEMBER).parquet(f"{path}/members")
    lengths = index.groupBy(F.size("vector").alias("d")).count().limit(MOST_LENGTHS + 1).collect()
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} lengths of vectors")
    fines = {r["d"]: fine_dims(r["count"], r["d"], bucket_rows) for r in lengths}
    whole = {d: 2 * max(2, 1 << (d - 1).bit_length()) * max(1, 2 * fine) for d, fine in fines.items()}
    wide = {d: min(whole[d], probes_for(probes, fine)) for d, fine in fines.items()}
    asked, rounds = mine.select("digest", "own").distinct().join(index.select("digest", "vector"), "digest"), 0
    while True:
        everywhere = wide == whole
        met(index, asked, fines, 1 if everywhere else tables, wide, count + 1, block_rows, seed).write.parquet(f"{path}/found-{rounds}")
        rounds += 1
        if everywhere:
            break
        found = spark.read.schema(FOUND).parquet(f"{path}/found-{rounds - 1}")
        too_few(vectors, asked, found, count + 1).write.parquet(f"{path}/few-{rounds}")
        few = spark.read.schema("digest bigint, own array<bigint>").parquet(f"{path}/few-{rounds}")
        if few.isEmpty():
            break
        asked = asked.join(few, ["digest", "own"], "left_semi").select("digest", "own", "vector")
        wide = {d: min(whole[d], WIDER * n) for d, n in wide.items()}
    found = spark.read.schema(FOUND).parquet(*(f"{path}/found-{n}" for n in range(rounds)))
    each = mine.withColumnRenamed("vec_id", "query_id").join(found, ["digest", "own"]).where(F.col("query_id") != F.col("vec_id")) \
        .select("query_id", "vec_id", "score").distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count) \
        .select("query_id", "rank", "vec_id", "score")
