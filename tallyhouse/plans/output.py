"""Result types that both engines print alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ByteType, DateType, DecimalType, IntegerType, ShortType


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns (or all): decimals as double, dates as text, whole numbers as bigint."""
    chosen = df.select(*columns) if columns else df

    def cast(field):
        kind, col = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, DecimalType):
            return col.cast("double").alias(field.name)
        if isinstance(kind, DateType):
            return col.cast("string").alias(field.name)
        if isinstance(kind, (ByteType, ShortType, IntegerType)):
            return col.cast("bigint").alias(field.name)
        return col

    return chosen.select(*[cast(f) for f in chosen.schema])
