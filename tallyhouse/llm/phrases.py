"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document.  A word is removed if a window that covers it, judged on the input, also starts in a
document with a smaller doc_id.

1. Seeds.  Every window chooses the smallest hash of its runs of ``GRAM`` words, so equal windows choose the same seed at the same place.  The windows around a
   place that choose it form a neighbourhood; there is one for about 22 words.
2. Claims.  A neighbourhood that recurs as a whole is claimed from the smallest document that has it.  What is left are different
   neighbourhoods of one seed; only their single windows are keyed, and a recurring window is claimed from its smallest document.  Both counts are
   pre-aggregated per key, so no hot passage is gathered anywhere.
3. Automata.  The claimed passages of the smaller documents are cut into blocks of half a window and compiled into
   Aho-Corasick automata, in shards of about ``SHARD_WORDS`` words.  The claiming documents' regions are streamed through the
   shards they claim from, hot shards in several parts.  Every window holds a whole block, so each recurring window is hit; hits
   are extended word by word and count from ``WINDOW`` equal words on.  This confirms the passages on the words themselves.
4. Located words are cut out of the documents.

The documents are written once, bucketed by doc_id, so the steps that go back to the texts do not shuffle them again.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; a null doc_id has no order, so such rows neither lose words nor cost
others any; rows that repeat a doc_id are judged each by its own text, and lose nothing to each other; very long texts are read whole; an
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import run_dir
from .words import ODD, WordHashes, ascii_words, mixed, ranges, release_kept, run_hashes

WINDOW, GRAM = 50, 8
BLOCK = WINDOW // 2
SHARD_WORDS, PART_WORDS = 50_000, 400_000
#: Regions are cut into pieces of so many windows, so that a long document does not stay in one piece.
PIECE = 5_000

SEEDS = "seed bigint, near bigint, near2 int, doc_id bigint, row int, low int, high int"
WINDOWS = "key bigint, key2 int, doc_id bigint, row int, low int"
PIECES = "shard int, kind int, doc_id bigint, row int, low int, n_words int, words string"
FOUND = "doc_id bigint, row int, low int, high int"
CLEANED = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"

OTHER = np.uint64(0xD6E8FEB86659FD93)


def row_key(text: str) -> int:
    """Tells apart rows that repeat a doc_id with other text."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) - (1 << 31)


def chosen_places(grams: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` values the place of the first smallest one."""
    low, at, have = grams, np.arange(len(grams)), 1
    while have < width:
        step = min(have, width - have)
        left = low[:-step] <= low[step:]
        low, at = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:])
        have += step
    return at


def spans_hash(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of the words from each start to each stop, from running sums."""
    n = len(hashes)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(n, base)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(pow(int(base), -1, 1 << 64)))])
    sums = np.r_[np.uint64(0), np.cumsum(hashes * powers[:n])]
    # Dividing by the power of the start makes a span's hash independent of where it stands.
    return mixed((sums[stops] - sums[starts]) * inverse[starts])


def neighbourhoods(hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(seed, near, near2, low, high): the windows from low to high choose the same seed."""
    grams = run_hashes(hashes, GRAM)
    places = chosen_places(grams, WINDOW - GRAM + 1)
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    last = np.r_[first[1:], len(places)] - 1
    length = (last - first).astype(np.uint64)
    near = spans_hash(hashes, first, last + WINDOW, ODD) + length
    near2 = spans_hash(mixed(hashes), first, last + WINDOW, OTHER) + length
    return grams[places[first]].view(np.int64), near.view(np.int64), (near2 >> np.uint64(32)).astype(np.uint32).view(np.int32), first, last


def seed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_kept()
    known = WordHashes()
    names = ["seed", "near", "near2", "doc_id", "row", "low", "high"]
    for batch in batches:
        rows = [[] for _ in names]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = ascii_words(text := text.as_py())
            if len(words) < WINDOW or doc_id is None:
                continue
            seed, near, near2, low, high = neighbourhoods(known.of(words))
            n = len(seed)
            for column, values in zip(rows, (seed, near, near2, np.full(n, doc_id), np.full(n, row_key(text), np.int32), low.astype(np.int32), high.astype(np.int32))):
                column.append(values)
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in rows], names)


def window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of the single windows in the listed neighbourhoods of each document."""
    release_kept()
    known = WordHashes()
    names = ["key", "key2", "doc_id", "row", "low"]
    for batch in batches:
        for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans")):
            text = text.as_py()
            row = row_key(text)
            listed = [s["low"] for s in spans.as_py() if s["row"] == row]
            if not listed:
                continue
            hashes = known.of(ascii_words(text))
            _, near, near2, low, high = neighbourhoods(hashes)
            # A neighbourhood that repeats in its first document is listed once; its repeats are looked up here.
            same = np.isin(near, near[np.searchsorted(low, listed)])
            at = ranges(low[same], high[same] - low[same] + 1)
            key = spans_hash(hashes, at, at + WINDOW, ODD).view(np.int64)
            key2 = (spans_hash(mixed(hashes), at, at + WINDOW, OTHER) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(key2), pa.array(np.full(len(at), doc_id)), pa.array(np.full(len(at), row, np.int32)), pa.array(at.astype(np.int32))], names)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges, joined where they touch."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the listed ranges out of each document, per shard and kind (0: passage, 1: region to look through)."""
    schema = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int32()), ("low", pa.int32()),
                        ("n_words", pa.int32()), ("words", pa.string())])
    for batch in batches:
        for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans")):
            text = text.as_py()
            row, wanted = row_key(text), {}
            for s in spans.as_py():
                if s["row"] == row:
                    wanted.setdefault((s["shard"], s["kind"]), []).append((s["low"], s["high"]))
            words, rows = ascii_words(text) if wanted else [], []
            for (shard, kind), parts in wanted.items():
                for low, high in merged(parts):
                    for at in range(low, high + 1, PIECE):
                        part = words[at:min(at + PIECE - 1, high) + WINDOW]
                        rows.append({"shard": shard, "kind": kind, "doc_id": doc_id, "row": row, "low": at, "n_words": len(part),
                                     "words": b" ".join(part).decode("utf-8", "surrogatepass")})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


class Shard:
    """The automaton over the blocks of one shard's passages.

    A window that holds a block reaches no further than half a window to either side of it.  So a block's entry is the words within that reach,
    with the smallest document that has them; passages that are equal around a block share one entry, however many documents bring them.
    """

    def __init__(self):
        import ahocorasick

        self.automaton, self.blocks, self.ready = ahocorasick.Automaton(), {}, False

    def add(self, doc_id: int, text: str) -> None:
        words = text.split(" ")
        for at in range(0, len(words) - BLOCK + 1, BLOCK):
            entries = self.blocks.setdefault(f" {' '.join(words[at:at + BLOCK])} ", {})
            around = tuple(words[max(at - BLOCK, 0):at]), tuple(words[at + BLOCK:at + 2 * BLOCK])
            entries[around] = min(entries.get(around, doc_id), doc_id)

    def compile(self) -> None:
        for block, entries in self.blocks.items():
            self.automaton.add_word(block, sorted((doc_id, *around) for around, doc_id in entries.items()))
        self.automaton.make_automaton()
        self.blocks, self.ready = {}, True

    def spans(self, doc_id: int, text: str) -> list[tuple[int, int]]:
        """Ranges of words (from, up to) of a region that a passage of a smaller document has too, ``WINDOW`` words or more."""
        if not self.ready:
            self.compile()
        if not len(self.automaton):
            return []
        words = text.split(" ")
        ends = np.cumsum([len(w) + 1 for w in words])
        out = []
        for end, entries in self.automaton.iter(f" {text} "):
            stop = int(np.searchsorted(ends, end)) + 1
            start = stop - BLOCK
            before, behind = words[max(start - BLOCK, 0):start], words[stop:stop + BLOCK]
            for owner, left, right in entries:
                if owner >= doc_id:
                    break
                low, high = alike(reversed(before), reversed(left)), alike(behind, right)
                if low + BLOCK + high >= WINDOW:
                    out.append((start - low, stop + high))
                    if low == len(before) and high == len(behind):
                        break
        return joined(out)


def alike(a: Iterable[str], b: Iterable[str]) -> int:
    """How many of the first words are equal."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (from, up to) of words; a word between two of them stays out."""
    return [(low, high + 1) for low, high in merged([(low, high - 1) for low, high in spans])]


def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, part, kind): an automaton is compiled from the passages, then the regions stream through it."""
    now, shard = None, None
    for batch in batches:
        found = []
        columns = [batch.column(c).to_pylist() for c in ("shard", "part", "kind", "doc_id", "row", "low")]
        for number, part, kind, doc_id, row, low, words in zip(*columns, batch.column("words")):
            if now != (number, part):
                now, shard = (number, part), Shard()
            if kind == 0:
                shard.add(doc_id, words.as_py())
            else:
                found += [(doc_id, row, low + a, low + b) for a, b in shard.spans(doc_id, words.as_py())]
        if found:
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["doc_id", "row", "low", "high"])


def kept_mask(count: int, spans: list[dict] | None, row: int) -> np.ndarray:
    change = np.zeros(count + 1, np.int64)
    for s in spans or ():
        if s["row"] == row:
            change[s["low"]] += 1
            change[s["high"]] -= 1
    return np.cumsum(change[:-1]) == 0


def clean_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans")):
            text, spans = text.as_py(), spans.as_py()
            words = ascii_words(text)
            kept = words
            if spans:
                mask = kept_mask(len(words), spans, row_key(text))
                kept = [w for w, ok in zip(words, mask.tolist()) if ok]
            rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], CLEANED.replace(" bigint", "").replace(" string", "").split(", "))


def shortened(text: str | None, spans: list[dict] | None) -> str | None:
    """The text without the located words and the white space behind each; other white space stays."""
    if not spans or not text:
        return text
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    mask, out, at = kept_mask(len(words), spans, row_key(text)), [], 0
    for i, (word, ok) in enumerate(zip(words, mask.tolist())):
        begin = data.index(word, at)
        if ok or not i or mask[i - 1]:
            out.append(data[at:begin])
        at = begin + len(word)
        if ok:
            out.append(word)
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def shorten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [shortened(t.as_py(), s.as_py()) for t, s in zip(batch.column("text"), batch.column("spans"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("held")], ["doc_id", "text", "held"])


class Located:
    """The documents, written in buckets, and the located spans of words."""

    def __init__(self, documents: DataFrame, others: list[str] = ()):  # noqa: D107
        self.spark = documents.sparkSession
        self.folder = run_dir(self.spark, "phrases")
        held = F.struct(*others) if others else F.lit(None).cast("int")
        texts = documents.select(F.col("doc_id").cast("long"), "text", held.alias("held"))
        self.texts = self.bucketed(texts)
        self.spans = self.located()

    def written(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.folder}/{name}")

    def bucketed(self, texts: DataFrame) -> DataFrame:
        """The texts as a table with one bucket for each shuffle partition, so joins by doc_id leave it in place."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"phrases_{uuid.uuid4().hex}"
        texts.repartition(buckets, "doc_id").write.option("compression", "zstd").option("path", f"{self.folder}/texts") \
            .bucketBy(buckets, "doc_id").saveAsTable(name)
        table = self.spark.table(name)
        # The plan holds files and buckets by now; its path makes the table external, so they stay.
        self.spark.sql(f"DROP TABLE {name}")
        return table

    def spans_of(self, spans: DataFrame, *columns: str, keep_all: bool = False) -> DataFrame:
        """The texts with their list of spans, which is no longer than the text."""
        lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("spans"))
        return self.texts.join(lists, "doc_id", "left" if keep_all else "inner")

    def located(self) -> DataFrame:
        place = F.struct("doc_id", "row", "low", "high")
        seeds = self.written(self.texts.select("doc_id", "text").mapInArrow(seed_batches, SEEDS), "seeds")
        near = seeds.groupBy("near", "near2").agg(F.min(place).alias("first"), F.max("doc_id").alias("last"), F.first("seed").alias("seed"))
        near = self.written(near, "near")
        whole = near.where("first.doc_id < last").select("near", "near2", "first")
        claims = seeds.join(whole, ["near", "near2"]).where("doc_id > first.doc_id").select("doc_id", "row", "low", "high", "first")
        several = near.groupBy("seed").agg(F.min("first.doc_id").alias("low_doc"), F.max("first.doc_id").alias("high_doc")).where("low_doc < high_doc")
        apart = near.join(several.select("seed"), "seed").select("near", "near2", "first")
        apart = self.with_rows_alike(apart, seeds)
        windows = self.spans_of(apart, "row", "low").mapInArrow(window_batches, WINDOWS)
        windows = self.written(windows, "windows")
        single = F.struct("doc_id", "row", "low", F.col("low").alias("high"))
        keyed = windows.groupBy("key", "key2").agg(F.min(single).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
        more = windows.join(keyed.drop("last"), ["key", "key2"]).where("doc_id > first.doc_id") \
            .select("doc_id", "row", "low", F.col("low").alias("high"), "first")
        claims = self.written(claims.union(more), "claims")
        return self.written(self.confirmed(claims), "spans")

    def with_rows_alike(self, apart: DataFrame, seeds: DataFrame) -> DataFrame:
        """(doc_id, row, low) of the first holders of neighbourhoods; where other rows repeat the holder's doc_id, of those too, as nothing claims
        for them what the holder has.  Texts lie in buckets of doc_id, so finding such rows shuffles nothing."""
        row = F.crc32(F.col("text").cast("binary"))
        twice = self.texts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(row).alias("low"), F.max(row).alias("high"))
        twice = self.written(twice.where("low < high").select("doc_id"), "twice")
        holders = apart.select("first.doc_id", "first.row", "first.low")
        if not twice.count():
            return holders
        rows = seeds.drop("seed").join(twice, "doc_id", "left_semi").join(apart, ["near", "near2"]) \
            .where("doc_id = first.doc_id AND row <> first.row")
        return holders.union(rows.groupBy("near", "near2", "doc_id", "row").agg(F.min("low").alias("low")).select("doc_id", "row", "low"))

    def confirmed(self, claims: DataFrame) -> DataFrame:
        passages = claims.select("first.*").distinct()
        words = passages.agg(F.sum(F.col("high") - F.col("low") + 1)).first()[0] or 0
        shards = 1 + words // SHARD_WORDS
        shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int").alias("shard")
        wanted = passages.select("doc_id", "row", "low", "high", shard("doc_id"), F.lit(0).alias("kind")).union(
            claims.select("doc_id", "row", "low", "high", shard("first.doc_id"), F.lit(1).alias("kind")).distinct())
        pieces = self.spans_of(wanted, "row", "low", "high", "shard", "kind").mapInArrow(piece_batches, PIECES)
        pieces = self.written(pieces, "pieces")
        parts = pieces.where("kind = 1").groupBy("shard").agg((1 + F.floor(F.sum("n_words") / PART_WORDS)).cast("int").alias("parts"))
        dealt = pieces.join(parts, "shard")
        part = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("parts") - 1)) \
            .otherwise(F.array(F.pmod(F.xxhash64("doc_id", "low"), "parts").cast("int")))
        dealt = dealt.withColumn("part", F.explode(part)).select("shard", "part", "kind", "doc_id", "row", "low", "words")
        return dealt.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind").mapInArrow(locate, FOUND)

    def digests(self) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256) of every row."""
        return self.spans_of(self.spans, "row", "low", "high", keep_all=True).select("doc_id", "text", "spans").mapInArrow(clean_batches, CLEANED)

    def cleaned(self) -> DataFrame:
        """(doc_id, text, held) of every row, the located words cut out of the text."""
        kind = self.texts.schema["held"].dataType.simpleString()
        return self.spans_of(self.spans, "row", "low", "high", keep_all=True).select("doc_id", "text", "spans", "held") \
            .mapInArrow(shorten_batches, f"doc_id bigint, text string, held {kind}")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of documents (doc_id, text)."""
    return Located(documents).digests()


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with the repeated words cut out of the text, all other columns as they were."""
    others = [c for c in documents.columns if c not in ("doc_id", "text")]
    cleaned = Located(documents, others).cleaned()
    return cleaned.select(*(F.col("held")[c].alias(c) if c in others else F.col(c) for c in documents.columns))
