"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the distinct ``width``-word shingles of its lower-cased words; its sketch are the ``SKETCH`` smallest shingle hashes.

1. Documents with equal sets form a class, which its smallest doc_id represents.
2. Inverted lists of the retained values give candidates.  Similar sets share at least ``shared_values`` retained values, so of a
   sketch ordered from rare to common values all but the last ``shared_values`` - 1 are enough to meet in a list (prefix filter);
   common values, as of passages that many documents quote, stay out of it.  Lists with the same smallest document make one cluster.
3. In every cluster the smallest document, the hub, is compared with each other; links join documents to components.  Where a cluster stays
   in several components, ``HUBS`` further hubs are compared with the members of other components.
4. Only members of different components in a cluster remain to be compared: those outside its largest component with all.  They are dealt out in
   pairs of blocks, so that no cluster lies in one task; a pair of blocks gives no more links than join its components (a spanning forest).
   A near copy thus meets a number of others that does not grow with its group, unless many of a cluster are similar to none of its hubs.
5. In all steps union sketches estimate the similarity and filter, then the exact Jaccard on the full sets of hashes confirms.

A pair exactly at the limit is lost if its sketches share fewer values than ``DEVIATIONS`` standard deviations allow for, with a probability of about
1e-8; sets of up to ``small_set`` shingles lose none.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; a text with fewer words than a shingle has one, the whole sequence;
a null doc_id takes no part (its component is null, and it is kept); rows that repeat a doc_id are all returned, each with
the component of its own text; very long texts are read whole; an empty table gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import run_dir, small_batches
from .components import components
from .words import WordHashes, ascii_words, release_kept, run_hashes

SKETCH, BLOCK = 64, 512
#: How many words' hashes a task holds.
MEMO = 200_000
#: How many further hubs a cluster of several components is compared with.
HUBS = 8
#: How many buckets of doc_ids the sieve before the texts' shuffle has; where all are in use it keeps nothing out.
SIEVE = 1 << 20
#: How many standard deviations of the overlap are allowed for.
DEVIATIONS = 6.5

FEATURES = "doc_id bigint, text_digest bigint, n_shingles bigint, digest string, sketch array<bigint>"
UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, UPPER.lower())


def shingle_set(text: str | None, hashes: WordHashes, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes, as signed integers in the order of the hash."""
    words = ascii_words(text, LOWER)
    if not words:
        return np.empty(0, np.int64)
    found = np.sort(run_hashes(hashes.of(words), min(width, len(words))).view(np.int64))
    return found[np.r_[True, found[1:] != found[:-1]]]


def featurer(width: int):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        hashes = WordHashes(MEMO)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(t.as_py(), hashes, width) for t in batch.column("text")[at:at + 512]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[at:at + 512], batch.column("text_digest")[at:at + 512], pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets], pa.string()),
                     pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64()))], ["doc_id", "text_digest", "n_shingles", "digest", "sketch"])

    return features


def shared_values(per_cent: int) -> int:
    """How many of ``SKETCH`` retained values two similar sets share at the least, but for ``DEVIATIONS``."""
    p = per_cent / 100
    return int(SKETCH * p - DEVIATIONS * (SKETCH * p * (1 - p)) ** 0.5)


def small_set(per_cent: int) -> int:
    """Sets up to this size fit into the sketch of any set they can be similar to, so their least overlap is exact."""
    return SKETCH * per_cent // 100


def least_shared(n: str, per_cent: int) -> F.Column:
    size = F.col(n)
    return F.when(size <= small_set(per_cent), F.ceil(size * per_cent / 100)).otherwise(shared_values(per_cent))


def inverted_lists(nodes: DataFrame, per_cent: int) -> DataFrame:
    """(value, node): the retained values that count for each node, from nodes (node, n_shingles, sketch)."""
    values = nodes.select("node", F.explode("sketch").alias("value"))
    frequency = values.groupBy("value").agg(F.count("*").alias("held_by")).where("held_by > 1")
    shared = values.join(frequency, "value").join(nodes.select("node", "n_shingles"), "node")
    own = Window.partitionBy("node")
    kept = F.least(F.col("n_shingles"), F.lit(SKETCH))
    prefix = kept - least_shared("n_shingles", per_cent) + 1
    ranked = shared.withColumn("unique", kept - F.count("*").over(own)) \
        .withColumn("place", F.row_number().over(own.orderBy("held_by", "value")) + F.col("unique")).where(F.col("place") <= prefix)
    return ranked.select("value", "node")


def clusters(lists: DataFrame) -> DataFrame:
    """(hub, node): who meets whom; lists with the same smallest node are one cluster."""
    hubs = lists.groupBy("value").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
    return lists.join(hubs, "value").select("hub", "node").distinct()


def maybe_similar(x: str, y: str, per_cent: int) -> F.Column:
    """The estimate from two sketches: how much of the union's sketch both hold."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, SKETCH)
    seen = F.size(F.array_intersect(F.array_intersect(x, y), union))
    return seen * SKETCH >= F.size(union) * shared_values(per_cent)


def similar(a: str, b: str, per_cent: int) -> F.Column:
    """The exact Jaccard on two full sets."""
    common = F.size(F.array_intersect(a, b))
    return common * 100 >= (F.size(a) + F.size(b) - common) * per_cent


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The intersection sizes of all pairs of two blocks of sets, by products of incidence matrices over the values that occur on both sides."""
    out = np.zeros((len(x), len(y)), np.float32)
    xv, yv = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(xv, yv)
    if not len(common):
        return out
    place = []
    for sets, values in ((x, xv), (y, yv)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[at] == values
        place.append((row[hit], at[hit]))
    for begin in range(0, len(common), 4096):
        parts = []
        for (row, at), n in zip(place, out.shape):
            part = np.zeros((n, min(4096, len(common) - begin)), np.float32)
            inside = (at >= begin) & (at < begin + 4096)
            part[row[inside], at[inside] - begin] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def forest(sure: np.ndarray, ids: np.ndarray, others: np.ndarray, components: np.ndarray, other_components: np.ndarray) -> dict[str, list[int]]:
    """Of the links of two blocks as many as join their components, no two of which join the same."""
    top = {c: c for c in (*components.tolist(), *other_components.tolist())}

    def root(c: int) -> int:
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    found, apart = {"a": [], "b": []}, len(top) - 1
    for a, b in zip(*(x.tolist() for x in np.nonzero(sure))):
        one, two = root(int(components[a])), root(int(other_components[b]))
        if one != two:
            top[one] = two
            found["a"].append(int(ids[a]))
            found["b"].append(int(others[b]))
            apart -= 1
            if not apart:
                break
    return found


def block_links(per_cent: int):
    def links(key, rows):
        import pandas as pd

        _, first, second = key
        left, right = rows[rows["block"] == first], rows[rows["block"] == second]
        found = {"a": [], "b": []}
        if len(left) and len(right):
            x, y = list(left["shingles"]), list(right["shingles"])
            nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
            ids, others = left["node"].to_numpy(), right["node"].to_numpy()
            open_ = left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]
            if first == second:
                open_ &= ids[:, None] < others[None, :]
            open_ &= np.minimum(nx[:, None], ny[None, :]) * 100 >= np.maximum(nx[:, None], ny[None, :]) * per_cent
            sketched = overlaps([s[:SKETCH] for s in x], [s[:SKETCH] for s in y])
            smaller = np.minimum(nx[:, None], ny[None, :])
            open_ &= sketched >= np.where(smaller <= small_set(per_cent), 1, shared_values(per_cent))
            i, j = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if len(i):
                common = overlaps([x[k] for k in i], [y[k] for k in j]).astype(np.int64)
                sure = open_[np.ix_(i, j)] & (common * 100 >= (nx[i][:, None] + ny[j][None, :] - common) * per_cent)
                found = forest(sure, ids[i], others[j], left["component"].to_numpy()[i], right["component"].to_numpy()[j])
        return pd.DataFrame(found).astype("int64")

    return links


def joined(names: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after further links (a, b); an id without a name is a component of its own."""
    links = links.distinct()
    for side in ("a", "b"):
        named = names.select(F.col("id").alias(side), F.col("component").alias(f"{side}_component"))
        links = links.join(named, side, "left").withColumn(f"{side}_component", F.coalesce(f"{side}_component", side))
    tops = components(links.select(F.col("a_component").alias("a"), F.col("b_component").alias("b")))
    moved = names.join(tops.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left") \
        .select("id", F.coalesce("top", "component").alias("component"))
    return moved.union(tops).distinct()


def open_clusters(met: DataFrame, names: DataFrame) -> DataFrame:
    """(hub, node, component, odd) of the clusters (hub, node) that hold several components and more than two documents; ``odd`` members are
    outside the cluster's largest component."""
    placed = met.join(names.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    shares = placed.groupBy("hub", "component").agg(F.count("*").alias("n"))
    several = shares.groupBy("hub").agg(F.count("*").alias("parts"), F.sum("n").alias("members"), F.max(F.struct("n", "component")).alias("main")) \
        .where("parts > 1 AND members > 2").select("hub", F.col("main.component").alias("main"))
    return placed.join(several, "hub").select("hub", "node", "component", (F.col("component") != F.col("main")).alias("odd"))


def in_blocks(still: DataFrame) -> DataFrame:
    """(hub, node, component, block, low, high): every member in each pair of blocks it has to be compared in.  Odd members meet all
    others, those of the largest component odd ones only."""
    sizes = still.groupBy("hub").agg(F.ceil(F.count_if("odd") / BLOCK).cast("int").alias("odd_blocks"),
                                     F.ceil(F.count_if(~F.col("odd")) / BLOCK).cast("int").alias("main_blocks"))
    at = F.xxhash64("node")
    block = F.when(F.col("odd"), F.pmod(at, "odd_blocks")).otherwise(F.col("odd_blocks") + F.pmod(at, "main_blocks")).cast("int")
    last = F.when(F.col("odd"), F.col("odd_blocks") + F.col("main_blocks")).otherwise(F.col("odd_blocks")) - 1
    dealt = still.join(sizes, "hub").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select("hub", "node", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def near_duplicates(documents: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of documents (doc_id, text)."""
    return judged(documents, width, per_cent).drop("text_digest")


def judged(documents: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """``near_duplicates`` with ``text_digest``, xxhash64 of the text, which tells apart rows that share a doc_id."""
    spark = documents.sparkSession
    small_batches(spark)
    folder = run_dir(spark, "minhash")

    def written(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    texts = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_digest"))
    features = written(texts.mapInArrow(featurer(width), FEATURES), "features")
    sets = features.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(sets.groupBy("digest").agg(F.min("doc_id").alias("first_doc")), "classes")
    # One node per class: its smallest doc_id, and where that stands for several classes the digest tells them apart.
    numbered = sets.join(classes, "digest").where("doc_id = first_doc").dropDuplicates(["digest"]) \
        .withColumn("node", F.xxhash64("digest")).select("node", "digest", "doc_id", "n_shingles", "sketch")
    numbered = written(numbered, "nodes")
    met = written(clusters(written(inverted_lists(numbered, per_cent), "lists")), "clusters")
    asked = met.select("node").distinct()
    wanted = written(numbered.join(asked, "node").select("node", F.col("doc_id").alias("of_doc"), "digest"), "wanted")
    # A broadcast of at most ``SIEVE`` rows keeps most of the other texts out of the shuffle.
    sieve = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE)).alias("sieve")
    near = texts.join(F.broadcast(wanted.select(sieve("of_doc")).distinct()), sieve("doc_id") == F.col("sieve"), "left_semi")
    shingles = near.join(wanted, F.col("doc_id") == F.col("of_doc")).select("node", "digest", "text") \
        .mapInArrow(checked_setter(width), "node bigint, shingles array<bigint>").dropDuplicates(["node"])
    shingles = written(shingles, "sets")
    sketches = numbered.select("node", "n_shingles", "sketch")
    hub_sketches = sketches.select(F.col("node").alias("hub"), F.col("n_shingles").alias("hub_size"), F.col("sketch").alias("hub_sketch"))
    near_size = F.least("n_shingles", "hub_size") * 100 >= F.greatest("n_shingles", "hub_size") * per_cent
    hub_sets = shingles.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links (a, b) among pairs (hub, node)."""
        maybe = pairs.join(sketches, "node").join(hub_sketches, "hub") \
            .where(near_size & maybe_similar("sketch", "hub_sketch", per_cent)).select("hub", "node")
        return maybe.join(shingles, "node").join(hub_sets, "hub").where(similar("shingles", "hub_shingles", per_cent)) \
            .select(F.col("hub").alias("a"), F.col("node").alias("b"))

    names = components(confirmed(met.where("hub != node")))
    still = written(open_clusters(met, names), "open-1")
    by_hash = Window.partitionBy("hub").orderBy(F.xxhash64("node"), "node")
    hubs = still.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= HUBS) \
        .select("hub", F.col("node").alias("more"), F.col("component").alias("more_component"))
    again = still.join(hubs, "hub").where("component != more_component").select(F.col("more").alias("hub"), "node").distinct()
    names = written(joined(names, confirmed(again)), "names-1")
    still = written(open_clusters(still.select("hub", "node"), names), "open-2")
    dealt = in_blocks(still).join(shingles, "node")
    names = joined(names, dealt.groupBy("hub", "low", "high").applyInPandas(block_links(per_cent), "a bigint, b bigint"))
    whole = numbered.select("node", "digest", "doc_id").join(names.select(F.col("id").alias("node"), F.col("component").alias("top")), "node", "left") \
        .withColumn("top", F.coalesce("top", "node"))
    smallest = whole.groupBy("top").agg(F.min("doc_id").alias("component_id"))
    named = whole.join(smallest, "top").select("digest", "component_id")
    return finished(features, named)


def finished(features: DataFrame, named: DataFrame) -> DataFrame:
    """The component of every row; rows without a set are their own."""
    out = features.drop("sketch").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_digest", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def checked_setter(width: int):
    """Full sets of the rows whose text has the wanted digest."""
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        hashes = WordHashes(MEMO)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingle_set(t.as_py(), hashes, width) for t in part.column("text")]
                right = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() == d for s, d in zip(sets, part.column("digest").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").filter(pa.array(right)), pa.array([s for s, ok in zip(sets, right) if ok], pa.list_(pa.int64()))],
                    ["node", "shingles"])

    return full
