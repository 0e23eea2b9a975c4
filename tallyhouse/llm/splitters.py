"""Splitting sort keys into ranges by regular samples: at most ``PER_PART`` keys a part and one a task come to the driver."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_PART = 32
#: Of monotonically_increasing_id() the low bits count the rows of a task.
PLACE = (1 << 33) - 1


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def place() -> F.Column:
    """The number of a row in its task, from 0."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE))


def splitters(keys: DataFrame, rows: int, parts: int) -> list[tuple]:
    """Up to ``parts`` - 1 rising keys (tuples) that cut ``rows`` keys into about equal ranges.  ``keys`` has the columns of a key and, as the
    last one, ``place``; every task gives each of its ``stride``-th rows."""
    stride = max(1, rows // (parts * PER_PART))
    sample = sorted(tuple(r)[:-1] for r in keys.where(F.col("place") % stride == stride // 2).collect())
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def with_part(columns: list[str], cuts: list[tuple]):
    """Adds ``part``, the range a key falls into; for mapInArrow."""
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in columns))
            parts = pa.array([bisect_right(cuts, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], [*batch.schema.names, "part"])

    return dealt
