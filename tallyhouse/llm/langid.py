"""Language ID by bit-sliced Bloom filters of n-grams.

Every slot of the filter holds one bit per language.  Adding an n-gram of a language sets that language's bit in a few
slots; the AND of an n-gram's slots is the set of all languages that (seem to) contain it.  A text's score for a
language counts its n-grams with that bit, corrected for the share of false positives that the language's fill predicts;
the largest corrected share decides, ties going to the language that sorts first.

n-grams are runs of lower-case letters and single blanks.  A language's filter takes those that make up at least
``LEAST_SHARE`` of its n-grams and are, by share, not ``OUTWEIGHED`` times more frequent in another language.  The fit reads a bounded sample: the
``SAMPLE`` different labelled texts with letters, or all if fewer, whose hashes are smallest in their language, each once however often it is repeated.  The
filter is put together on the executors; what comes to the driver is at most its ``SLOTS`` words for each 64 languages.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows with a null language are never learnt
from; with nothing to learn every text is ``und``; very long texts are read whole; repeated rows give one result each; an
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_batches
from .words import release_kept

GRAM, SLOTS, PROBES = 4, 1 << 19, 2
#: Texts up to this multiple of the sample are read to draw it, as the number of different texts is only estimated.
SPARE = 2
SAMPLE, LEAST_SHARE, OUTWEIGHED = 2_000, 2e-5, 4.0
#: No language has more than 1 / LEAST_SHARE n-grams in the filter.  More languages than this are refused.
MOST_LANGUAGES = 1_000

LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> np.ndarray:
    """The hash of every n-gram of a text, case and all but letters set aside; empty without a letter."""
    if not text or not LETTER.search(text):
        return np.empty(0, np.uint64)
    clean = OTHER.sub(" ", f" {text.lower()} ")
    points = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < GRAM:
        points = np.concatenate([points, np.full(GRAM - len(points), 32, np.uint64)])
    count = len(points) - GRAM + 1
    total = points[:count].copy()
    for i in range(1, GRAM):
        total = (total << np.uint64(21)) ^ (total >> np.uint64(43)) ^ points[i:count + i]
    total *= np.uint64(0x9E3779B97F4A7C15)
    return total ^ (total >> np.uint64(29))


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    spread = hashes * np.uint64(0xBF58476D1CE4E5B9)
    return [((spread >> np.uint64(64 - 20 * (i + 1))) % np.uint64(SLOTS)).astype(np.int64) for i in range(PROBES)]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each batch."""
    release_kept()
    for batch in batches:
        held: dict[str, list] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            held.setdefault(lang, []).append(grams(text))
        for lang, found in held.items():
            values, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)],
                                             ["lang", "gram", "n"])


def count_bits(places: dict[str, int]):
    """(slot, word, bits) of the n-grams of each batch, by the number of each language."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.array([places[lang] for lang in batch.column("lang").to_pylist()], np.int64)
            hashes = batch.column("gram").to_numpy().view(np.uint64)
            at = np.concatenate(slots(hashes))
            word, bit = np.tile(number // 64, PROBES), np.tile(np.uint64(1) << (number % 64).astype(np.uint64), PROBES)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(word.astype(np.int32)), pa.array(bit.view(np.int64))],
                                             ["slot", "word", "bits"])

    return counted


def sampled(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text): at most ``sample`` different texts with letters per language, those of the smallest hashes."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("hash"))
    sizes = usable.groupBy(F.col("lang").alias("of")).agg(F.approx_count_distinct("hash").alias("texts"))
    limit = F.least(F.lit(1.0), F.lit(float(SPARE * sample)) / F.col("texts"))
    # A hash as a number from 0 to 1, rising with it, so that the candidates hold the smallest hashes.
    part = F.col("hash") / F.lit(2.0 ** 64) + 0.5
    near = usable.join(F.broadcast(sizes.limit(MOST_LANGUAGES + 1)), F.col("lang") == F.col("of")).where((F.col("texts") <= SPARE * sample) | (part < limit))
    once = near.groupBy("lang", "hash").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("hash")
    return once.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample).select("lang", "text")


def learn(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages and the filter, an array (slots, 64-bit words of languages)."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    langs = [r["lang"] for r in labelled.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    wide = (max(1, len(langs)) + 63) // 64
    table = np.zeros((SLOTS, wide), np.uint64)
    if not langs:
        return langs, table
    small_batches(labelled.sparkSession)
    chosen = sampled(labelled, sample)
    counted = chosen.mapInArrow(count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("total"))
    shares = counted.join(F.broadcast(totals), F.col("lang") == F.col("of")).withColumn("share", F.col("n") / F.col("total"))
    common = shares.where(F.col("share") >= LEAST_SHARE)
    best = common.groupBy(F.col("gram").alias("best_gram")).agg(F.max("share").alias("most"))
    kept = common.join(best, F.col("gram") == F.col("best_gram")).where(F.col("share") * OUTWEIGHED >= F.col("most"))
    places = {lang: i for i, lang in enumerate(langs)}
    bits = kept.select("lang", "gram").mapInArrow(count_bits(places), "slot int, word int, bits bigint") \
        .groupBy("slot", "word").agg(F.bit_or("bits").alias("bits"))
    rows = bits.toPandas()
    table[rows["slot"].to_numpy(np.int64), rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return langs, table


class Judge:
    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table
        bits = [(table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(langs))]
        self.false = np.array([float(b.mean()) ** PROBES for b in bits])

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = grams(text)
        if not len(found) or not self.langs:
            return "und", 0.0
        at = slots(found)
        counts = np.empty(len(self.langs))
        for w in range(self.table.shape[1]):
            sets = self.table[:, w][at[0]]
            for more in at[1:]:
                sets &= self.table[:, w][more]
            values, n = np.unique(sets, return_counts=True) if len(self.langs) > 8 else (np.arange(1 << len(self.langs), dtype=np.uint64), np.bincount(sets.astype(np.int64), minlength=1 << len(self.langs)))
            for i in range(w * 64, min(len(self.langs), w * 64 + 64)):
                counts[i] = n[(values >> np.uint64(i % 64)) & np.uint64(1) == 1].sum()
        corrected = np.clip((counts / len(found) - self.false) / np.maximum(1e-9, 1 - self.false), 0.0, 1.0)
        best = int(np.argmax(corrected))
        return self.langs[best], float(corrected[best])


def predictor(langs, table):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        judge = Judge(langs, table.value)
        for batch in batches:
            said = [judge(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"])

    return predict


def predict(documents: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """Adds lang_pred and score to a table with a text column; any columns of those names are replaced.  The filter has a
    fixed size of ``SLOTS`` words for each 64 languages."""
    small_batches(documents.sparkSession)
    documents = documents.drop("lang_pred", "score")
    held = documents.sparkSession.sparkContext.broadcast(table)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + ", lang_pred string, score double"
    return documents.mapInArrow(predictor(langs, held), schema)


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def identify(documents: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Learns from the labelled documents that are not held out."""
    return learn(documents.where(~held_out()), sample)
