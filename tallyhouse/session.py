"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the jobs rely on.  Adaptive execution coalesces small shuffle
# partitions, splits skewed join partitions and turns a shuffled join into a
# broadcast one only after it has measured the small side.
CLUSTER_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
}


def session_builder(app_name: str = "tallyhouse") -> SparkSession.Builder:
    """A builder with CLUSTER_SETTINGS; the caller sets master and memory."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in CLUSTER_SETTINGS.items():
        builder = builder.config(key, value)
    return builder

#: An Arrow batch of texts stands in an executor several times at once: as the JVM builds it, in the Python worker, and as it comes back.
BATCH_BYTES = "4m"
#: A scan of Parquet holds so many rows of texts or lists in arrays of twice their size, for each task and each side of its joins.
SCAN_ROWS = "512"


def small_batches(spark: SparkSession) -> None:
    """From now on no Arrow batch of the session is larger than ``BATCH_BYTES``, but for a single row, and no scan of Parquet holds more than
    ``SCAN_ROWS`` rows; a lazy result needs this until it is written, so it stays.  Results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Where the setting is absent, the folder set on the context counts.  Where
    that is absent too (local tests), one is made; this is only right on a
    single machine, so a remote master gets an error instead.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyhouse-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


_RECORDS: list[list[str]] = []


@contextmanager
def recorded_dirs() -> Iterator[list[str]]:
    """A list that gets every ``run_dir`` made meanwhile, for callers that
    remove these folders once nothing reads them any more."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not made]


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for record in _RECORDS:
        record.append(path)
    return path
