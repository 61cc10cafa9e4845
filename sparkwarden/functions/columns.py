"""Column helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def us(column: str = "timestamp") -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def num(x: float) -> Column:
    """A double literal."""
    return F.lit(float(x))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for results that are compared with another engine's."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
