"""The corpus pipeline: language ID, near-dedup, substring dedup, mixing and encoding, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.  Nulls,
empty texts and repeated rows are treated as the operators say; columns beyond those of ``documents`` are not passed on.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import langid, minhash, mixing, phrases, pieces
from tallyhouse.session import recorded_dirs, run_dir
from tallyhouse.sources import folders
from tallyhouse.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Of a text in a learnt language this share of n-grams, at the least, is in the language's filter.
LEAST_SCORE = 0.3


#: Folders below the shared one that the last stages have made and no stage has removed yet.
LEFT: list[str] = []


def cleaned(stage):
    """A stage that first removes what earlier ones left in the shared folder, but for what its input reads.  So write a stage's output
    before the next one is called."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if LEFT:
            read = "\n".join(docs.inputFiles())
            for path in [p for p in LEFT if p.rsplit("/", 1)[1] not in read]:
                folders.remove(spark, path)
                LEFT.remove(path)
        with recorded_dirs() as made:
            out = stage(spark, docs, sf_dir)
        LEFT.extend(made)
        return out

    return run_stage


def columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


@cleaned
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose n-grams no learnt language has, go."""
    docs = columns(docs)
    langs, table = langid.identify(docs)
    said = langid.predict(docs, langs, table)
    return columns(said.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


@cleaned
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document of the smallest doc_id stays, and of
    rows that repeat it one."""
    docs = columns(docs)
    kept = minhash.judged(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_digest").alias("kept_text")).distinct()
    known = docs.where("doc_id IS NOT NULL").withColumn("same", F.xxhash64("text"))
    known = known.join(kept, (F.col("doc_id") == F.col("kept_id")) & (F.col("same") == F.col("kept_text")), "left_semi")
    once = known.dropDuplicates(["doc_id", "same"]).drop("same")
    return once.union(docs.where("doc_id IS NULL"))


@cleaned
def phrase_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay where they stand first; a document of which no word is left goes."""
    cut = phrases.without_repeats(columns(docs))
    return cut.withColumn("n_chars", F.length("text").cast("long")).where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("text") == ""))


@cleaned
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the shards of the mix draw it, whole; the one at the edge of a source's quota is taken if half of it or more lies
    within.  Of rows that repeat a doc_id, source and text each counts, and their smallest lang stands for all."""
    docs = columns(docs)
    path = run_dir(spark, "mixed")
    mixing.mixed_blocks(docs).where("pass_no IS NOT NULL AND shard IS NOT NULL AND 2 * words >= size") \
        .select(mixing.key_of().alias("key"), "shard", "position").write.parquet(path)
    copies = spark.read.schema("key string, shard int, position long").parquet(path)
    mixed = mixing.locally_shuffled(mixing.keyed(docs).join(copies, "key"))
    return columns(mixed.withColumn("n_chars", F.length("text").cast("long")))


@cleaned
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document, its n best segmentations, and whether the ids decode to the text."""
    return pieces.encode(columns(docs))


STAGES = [("language ID", known_language), ("MinHash near-dedup", near_dedup), ("substring dedup", phrase_dedup),
          ("mixing to target weights", mix), ("SentencePiece encoding", encode)]

#: The filter learnt by language ID and the piece lattice cannot be said in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next; of the stages' outputs the last one stays."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES):
        path = run_dir(spark, f"stage-{n + 1}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            folders.remove(spark, before)
        before = path
    return docs
