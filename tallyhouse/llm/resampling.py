"""Drawing the documents nearest a target distribution by importance resampling.

1. Every feature (run of 1 to ``longest`` words) falls into one of ``buckets``; each task adds its counts up in one array, and the sums, one
   row a bucket, give each bucket's gain: how much likelier the target's texts are to hold it.
2. A document's weight is the mean gain of its features, looked up in that array; with Gumbel noise from a hash of its doc_id the highest
   scores are a draw without replacement in proportion to exp(weight / 1000).
3. The scores are ranked by parallel sorting by regular sampling: each task sorts its documents into a run, each run gives every
   ``stride``-th of its keys, splitters at regular places of these cut the keys into segments, the runs' segments are exchanged
   and merged, and a prefix sum over the segments' counts makes a row's place in its segment its exact rank.

The driver sees one row a bucket, a bounded sample of keys and one count a segment; no task sees all scores.  Equal keys are told apart by
their place in the runs, so that not even a repeated row makes a hot segment.

Defined cases: null texts and texts without words have no features, weight 0 and take no part in the draw, like all with fewer than
``least_words`` words; a null doc_id is hashed as an empty text and comes after the others of its score; rows that repeat a doc_id all count; without target texts every
bucket's target count is 0; an empty table gives no rows.  Texts are read whole.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import run_dir
from .splitters import PLACE, parts_of, place, splitters, with_part

BUCKETS, LONGEST, LEAST_WORDS, PER_CENT, SEED = 10_000, 1, 20, 10, 2024
#: Lower-cases A-Z and blanks all other bytes below 0x80 but digits and letters, so that ``bytes.split`` gives the words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A memo of buckets is emptied at this size; results do not depend on it.
MEMO = 800_000

SCORED = "doc_id long, n_features long, weight long, score long, takes_part boolean"


class Buckets(dict):
    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.buckets
        return value


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def features(found: list[bytes], longest: int, known: Buckets) -> np.ndarray:
    """The buckets of all runs of 1 to ``longest`` words."""
    runs = [np.fromiter(map(known.__getitem__, found), np.int64, len(found))]
    for n in range(2, min(longest, len(found)) + 1):
        runs.append(np.fromiter((known[b" ".join(found[i:i + n])] for i in range(len(found) - n + 1)), np.int64))
    return np.concatenate(runs)


def counter(buckets: int, longest: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                held = features(words(text.as_py()), longest, known)
                total += np.bincount(held, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return counted


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    counts = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(counter(buckets, longest), "bucket long, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t + 1)(S + buckets)) / ((s + 1)(T + buckets)))) by bucket."""
    every, wanted = int(source.sum()) + len(source), int(target.sum()) + len(source)
    return np.array([math.floor(1000 * math.log((int(t) + 1) * every / ((int(s) + 1) * wanted))) for s, t in zip(source, target)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scorer(gain: np.ndarray, longest: int, least_words: int, seed: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gain))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = words(text.as_py())
                held = features(found, longest, known)
                weight = int(gain[held].sum()) // len(held) if len(held) else 0
                rows.append((doc_id, len(held), weight, weight + noise(doc_id, seed), len(found) >= least_words))
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                             ["doc_id", "n_features", "weight", "score", "takes_part"])

    return scored


def ranked(runs: DataFrame, folder: str) -> DataFrame:
    """Adds ``rank``, from 1, by falling score and rising doc_id.  ``runs`` is a written table of sorted runs, with ``at``, the row's task and place in it."""
    spark, parts, rows = runs.sparkSession, parts_of(runs.sparkSession), runs.count()
    key = {"falling": -F.col("score"), "nameless": F.col("doc_id").isNull(), "named": F.coalesce("doc_id", F.lit(0)), "at": F.col("at")}
    keyed = runs.withColumns(key)
    cuts = splitters(keyed.select(*key, F.col("at").bitwiseAND(F.lit(PLACE)).alias("place")), rows, parts)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + ", part int"
    merged = keyed.mapInArrow(with_part(list(key), cuts), schema).repartitionById(parts, F.col("part")) \
        .sortWithinPartitions(*key).withColumn("place", place())
    merged.write.parquet(f"{folder}/segments")
    merged = spark.read.schema(merged.schema).parquet(f"{folder}/segments")
    held = sorted(tuple(r) for r in merged.groupBy("part").count().collect())
    before = [0, *itertools.accumulate(n for _, n in held)]
    prefix = spark.createDataFrame([(part, n) for (part, _), n in zip(held, before)], "part int, before long")
    return merged.join(F.broadcast(prefix), "part").withColumn("rank", F.col("before") + F.col("place") + 1).drop(*key, "part", "place", "before")


def resampled(documents: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, longest: int = LONGEST,
              buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of documents (doc_id, text), for a target of texts (text); ``rank`` is null
    where a document is not drawn."""
    spark = documents.sparkSession
    folder = run_dir(spark, "resampling")
    gain = gains(bucket_counts(documents, buckets, longest), bucket_counts(target, buckets, longest))
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    runs = texts.mapInArrow(scorer(gain, longest, least_words, seed), SCORED) \
        .sortWithinPartitions(F.col("takes_part").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()) \
        .withColumn("at", F.monotonically_increasing_id())
    runs.write.parquet(f"{folder}/runs")
    runs = spark.read.schema(runs.schema).parquet(f"{folder}/runs")
    taking = runs.where("takes_part")
    drawn = taking.count() * per_cent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    places = ranked(taking, folder).select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return places.union(runs.where("NOT takes_part").select(*out, F.lit(None).cast("long").alias("rank")))
