"""Tokeniser fertility: how well public vocabularies fit a text.

For every text, each word is encoded as in running text (with a blank before it) by two public vocabularies: the piece
vocabulary gives characters per token, the share of byte-fallback tokens and the entropy of the tokens; the byte-level
vocabulary gives characters per token.  The values are held against bands that are learnt per language from all texts: a
band reaches between two multiples of the language's median (``BANDS``).  Values of texts with fewer than ``FEW_TOKENS`` tokens vary more, so
the band widens for them as the root of the tokens falls (``WIDENING``), and they count for the medians only in languages
that have no longer text.

Beside it stand the plain rules on words, symbols, repeated lines and repeated five-word windows.

Defined cases: null and empty texts have no words and fail the plain rules; a null language is a language of its own;
very long texts are read whole; repeated rows give one result each; an empty table gives no rows.  Other columns of the
input are ignored.  The vocabulary folder is a parameter; every executor must have it.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import run_dir
from .words import MEMO_WORDS, Grown, ascii_words, mixed, ranges, run_hashes

VOCABULARIES = "/opt/tokenizers"
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: The byte-level vocabulary never sees more than a blank and one word, so the split pattern has no say.
ONE_PIECE = r"[\s\S]+"

FEW_TOKENS, WIDENING = 200, 0.1
BANDS = {"chars_per_token": (0.7, 1.5), "chars_per_byte_token": (0.85, 1.5), "entropy": (0.5, 1.6)}
#: The most byte-fallback tokens a text may have in any language, and the room above three times the median share.
MOST_FALLBACK, FALLBACK_ROOM = 0.5, 0.1
#: Medians are read from counts of values rounded to this step, so they are exact to it and need no sample.
STEP = 0.005

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"

COLUMNS = [("doc_id", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
           ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_tokens", pa.int64()),
           ("chars_per_token", pa.float64()), ("chars_per_byte_token", pa.float64()), ("fallback_share", pa.float64()),
           ("entropy", pa.float64())]
MEASURES = ("doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
            "n_repeat_words bigint, n_tokens bigint, chars_per_token double, chars_per_byte_token double, "
            "fallback_share double, entropy double")
BANDED = (*BANDS, "fallback_share")


@functools.lru_cache(maxsize=2)
def vocabularies(folder: str) -> tuple:
    """The piece vocabulary and the byte-level one, loaded once for each Python worker, which runs many tasks."""
    import sentencepiece
    import tiktoken

    with open(os.path.join(folder, BYTES), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return (sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECES)),
            tiktoken.Encoding("fertility", pat_str=ONE_PIECE, mergeable_ranks=ranks, special_tokens={}))


class Encodings:
    """For each distinct word its pieces, and how many byte-level tokens it has."""

    def __init__(self, folder: str):
        self.pieces, self.bytes = vocabularies(folder)
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.start, self.length, self.byte_tokens = Grown(np.int32), Grown(np.int64), Grown(np.int64), Grown(np.int64)

    def add(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        ids = self.pieces.encode(texts, num_threads=1)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start.add(self.ids.size + np.cumsum(lengths) - lengths)
        self.length.add(lengths)
        self.ids.add(np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lengths.sum())))
        encode = self.bytes.encode_ordinary
        self.byte_tokens.add([len(encode(" " + t)) for t in texts])
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            if len(self.number) + len(new) > MEMO_WORDS:
                self.clear()
                new = list(dict.fromkeys(words))
            self.add(new)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def repeat_words(numbers: np.ndarray, width: int = 5) -> int:
    """Words covered by windows that occur twice or more in the text."""
    if len(numbers) <= width:
        return 0
    keys = run_hashes(mixed(numbers.astype(np.uint64)), width)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(keys), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    change = np.zeros(len(numbers) + 1, np.int64)
    change[:len(keys)] += hit
    change[width:] -= hit
    return int((np.cumsum(change[:-1]) > 0).sum())


def dup_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def measured(text: str | None, known: Encodings) -> tuple:
    words = ascii_words(text)
    if not words:
        return 0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0, 0, None, None, None, None
    numbers = known.numbers(words)
    chars = len(text) - sum(map(text.count, SPACES))
    lengths = known.length[numbers]
    ids = known.ids[ranges(known.start[numbers], lengths)]
    used = np.bincount(ids)
    share = used[used > 0] / len(ids)
    return (len(words), chars, sum(map(text.count, SYMBOLS)), dup_lines(text), repeat_words(numbers), len(ids),
            chars / len(ids), chars / int(known.byte_tokens[numbers].sum()), float(known.fallback[ids].mean()),
            float(-(share * np.log2(share)).sum()) / max(1.0, float(np.log2(len(ids)))))


def measurer(folder: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Encodings(folder)
        for batch in batches:
            rows = [measured(text.as_py(), known) for text in batch.column("text")]
            columns = list(zip(*rows)) or [()] * 10
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), *(pa.array(c, t) for c, (_, t) in zip(columns, COLUMNS[2:]))],
                [name for name, _ in COLUMNS])

    return measure


def measure(documents: DataFrame, vocabularies: str = VOCABULARIES) -> DataFrame:
    """(doc_id, lang) with the values of every text; one pass without a shuffle."""
    return documents.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(measurer(vocabularies), MEASURES)


def bands(measures: DataFrame) -> DataFrame:
    """(lang, value, median) over all texts with enough tokens, or all with any where a language has none, from counts per rounded value."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("value"), F.round(F.col(c) / STEP).cast("long").alias("at")) for c in BANDED)))
    counted = measures.where("n_tokens > 0").select("lang", (F.col("n_tokens") >= FEW_TOKENS).cast("long").alias("long"), values.alias("v")) \
        .groupBy("lang", "v.value", "v.at").agg(F.count("*").alias("any"), F.sum("long").alias("long"))
    key = Window.partitionBy("lang", "value")
    counted = counted.withColumn("n", F.when(F.sum("long").over(key) > 0, F.col("long")).otherwise(F.col("any"))).where("n > 0")
    ranked = counted.withColumn("upto", F.sum("n").over(key.orderBy("at"))).withColumn("all", F.sum("n").over(key))
    return ranked.where(F.col("upto") * 2 >= F.col("all")).groupBy("lang", "value").agg((F.min("at") * STEP).alias("median"))


def judge(measures: DataFrame, medians: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept``.  Medians come as one row per language, which is small."""
    wide = medians.groupBy(F.col("lang").alias("band_lang")).pivot("value", list(BANDED)).agg(F.first("median"))
    wide = wide.select("band_lang", *(F.col(c).alias(f"{c}_median") for c in BANDED))
    held = measures.join(wide, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    wider = F.lit(1.0) + WIDENING * (F.sqrt(FEW_TOKENS / F.least(F.lit(FEW_TOKENS), F.greatest(F.lit(1), F.col("n_tokens")))) - 1)
    inside = F.lit(True)
    for c, (low, high) in BANDS.items():
        inside = inside & F.col(c).between(F.col(f"{c}_median") * low / wider, F.col(f"{c}_median") * high * wider)
    most = F.least(F.lit(MOST_FALLBACK), F.col("fallback_share_median") * 3 + FALLBACK_ROOM * wider)
    inside = inside & (F.col("fallback_share") <= most)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return held.withColumn("base_failed", failed) \
        .withColumn("kept", ~failed & F.coalesce(inside, F.lit(True))) \
        .drop("band_lang", *(f"{c}_median" for c in BANDED))


def fertility(documents: DataFrame, vocabularies: str = VOCABULARIES) -> DataFrame:
    """Measures, bands and verdict of every document.  The measures are written once, as bands and verdicts both read them."""
    spark = documents.sparkSession
    path = run_dir(spark, "fertility")
    measure(documents, vocabularies).write.parquet(path)
    measures = spark.read.schema(MEASURES).parquet(path)
    return judge(measures, bands(measures))
