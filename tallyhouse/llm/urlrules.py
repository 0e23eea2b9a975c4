"""Allow and block rules on urls by a sort-merge range join.

A rule is a host and a path; it fits the host and its subdomains where the url's path starts with the rule's.  Hosts are written
backwards by labels, so that ``a.b.org`` and ``/fr/x`` make the key ``org.b.a./fr/x`` and every rule is the interval of all keys that
start with its own.  A url asks with its host and each parent domain that has rules.  Keys are cut into ranges by regular samples; a
rule goes to each range that its interval meets, and each range is swept in sorted order with a stack of the rules whose intervals are
open.  Intervals of prefixes are nested or apart, so the top of the stack is the longest rule that fits; the longest of all of a url's
answers wins, at equal length that with the longer host.

Nothing is held but the stack: neither the rules nor the urls of a hot host lie in one task, as a range ends within a host's paths, and
within equal urls by page_id.

Defined cases: a null url or one without ``://`` has an empty host and path; a host ends at ``/``, ``?``, ``#`` or the end and keeps its
port; only A-Z are lower-cased; rules with a path that does not start with ``/`` fit nothing, those with an empty path every path, those with a null host, path or
verdict are no rules; of equal rules that disagree the blocking one counts; repeated rows and null page_ids are all returned; without rules every url gets the default
verdict; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splitters import parts_of, place, splitters, with_part

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
EVENT = "key string, kind int, id long, page_id long, host string, path string, rule string, verdict string"
ANSWER = "page_id long, host string, path string, rule string, verdict string, length int, host_length int"
LEAST_ID = -(1 << 63)


def parsed(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    return pages.select(F.col("page_id").cast("long"), F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER).alias("host"),
                        F.regexp_extract(url, PATH, 1).alias("path"))


def backwards(host) -> F.Column:
    """The labels of a host from the last to the first, each ended by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def after(prefix: str) -> str:
    """The smallest text above all that start with ``prefix``."""
    kept = prefix.rstrip(chr(0x10FFFF))
    return kept[:-1] + chr(ord(kept[-1]) + 1)


def spread(cuts: list[tuple]):
    """Every rule in each range that its interval meets."""
    from bisect import bisect_right

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                first, last = bisect_right(cuts, (key, LEAST_ID)), bisect_right(cuts, (after(key), LEAST_ID))
                rows += [i] * (last - first + 1)
                parts += range(first, last + 1)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns, pa.array(parts, pa.int32())],
                                             [*batch.schema.names, "part"])

    return dealt


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longest rule for every asking url of a sorted range; urls without one give no row."""
    stack = []
    for batch in batches:
        keys, kinds = batch.column("key").to_pylist(), batch.column("kind").to_pylist()
        rules, verdicts = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
        hit, answers = [], []
        for i, key in enumerate(keys):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kinds[i] == 0:
                stack.append((key, (rules[i], verdicts[i], len(rules[i]), len(rules[i].partition("/")[0]))))
            elif stack:
                hit.append(i)
                answers.append(stack[-1][1])
        asked = batch.select(["page_id", "host", "path"]).take(pa.array(hit, pa.int64()))
        found = [pa.array([a[k] for a in answers], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*asked.columns, *found], ["page_id", "host", "path", "rule", "verdict", "length", "host_length"])


def longest_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of the urls (page_id, host, path) that a rule (host, path, verdict) fits, once for equal rows."""
    spark, parts = urls.sparkSession, parts_of(urls.sparkSession)
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna() \
        .where(F.col("path").startswith("/") | (F.col("path") == "")).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asks = urls.withColumn("domain", F.explode(parents)) \
        .join(rules.select(F.col("host").alias("domain")).distinct(), "domain", "left_semi") \
        .select(F.concat(backwards("domain"), "path").alias("key"), F.lit(1).alias("kind"), F.coalesce("page_id", F.lit(LEAST_ID)).alias("id"),
                "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    starts = rules.select(F.concat(backwards("host"), "path").alias("key"), F.lit(0).alias("kind"), F.lit(LEAST_ID).alias("id"),
                          F.lit(None).cast("long").alias("page_id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    cuts = splitters(asks.select("key", "id", place().alias("place")), asks.count(), parts)
    events = asks.mapInArrow(with_part(["key", "id"], cuts), f"{EVENT}, part int").union(starts.mapInArrow(spread(cuts), f"{EVENT}, part int"))
    found = events.repartitionById(parts, F.col("part")).sortWithinPartitions("key", "kind", "id").drop("part").mapInArrow(sweep, ANSWER)
    best = F.max_by(F.struct("rule", "verdict"), F.struct("length", "host_length")).alias("best")
    return found.groupBy("page_id", "host", "path").agg(best).select("page_id", "host", "path", "best.rule", "best.verdict")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of pages (page_id, url); rules are (host, path, verdict: allow or block)."""
    urls = parsed(pages)
    found = longest_rules(urls, rules).select(*(F.col(c).alias(f"of_{c}") for c in ("page_id", "host", "path")), "rule", "verdict")
    same = F.col("page_id").eqNullSafe(F.col("of_page_id")) & (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path"))
    return urls.join(found, same, "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
