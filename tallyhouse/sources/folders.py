"""Looking at folders and removing them, in whatever store the paths name."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    store, found = _at(spark, path)
    return store.exists(found)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds; one that is not there is no error."""
    store, found = _at(spark, path)
    store.delete(found, True)


def numbers(spark: SparkSession, path: str, name: str, committed: bool = False) -> list[int]:
    """The rising numbers N of the folders ``name``=N; with ``committed`` only of those a write has finished in."""
    store, found = _at(spark, path)
    if not store.exists(found):
        return []
    names = [s.getPath().getName() for s in store.listStatus(found)]
    held = [int(n.split("=", 1)[1]) for n in names if n.startswith(f"{name}=")]
    return sorted(n for n in held if not committed or exists(spark, f"{path}/{name}={n}/_SUCCESS"))
