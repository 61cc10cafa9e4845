"""Windows over (key, time) that a key with very many rows does not put into one task.

Which keys are hot (over ``HOT_ROWS`` rows) is counted once and written. Where none is, windows are plain. Rows of a hot
key are cut into slices of time at least as long as the widest frame; a row also goes, as context, to the neighbouring
slice whose frames can reach it, so each frame is whole within its slice and results are exact. All columns that one
call makes share an exchange of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.columns import us
from .iterate import cut

HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, hot_rows: int | None = None) -> DataFrame:
    """The key's values with more rows than that, as a small written table (key, _hot)."""
    most = HOT_ROWS if hot_rows is None else hot_rows
    return cut(df.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most).select(key, F.lit(True).alias("_hot")))


def with_frames(
    df: DataFrame, key: str, back: int, ahead: int, make: Callable[[Callable[[int, int], WindowSpec]], dict[str, Column]], hot: DataFrame | None = None, previous: str | None = None
) -> DataFrame:
    """Adds the columns that ``make`` builds from frames; it gets a function from offsets (microseconds) to a frame. No frame may reach beyond ``back`` and ``ahead``.

    With ``previous``, also a column of that name: the time (microseconds) of the key's row before, by (timestamp, transaction_id).
    ``hot``: what ``hot_keys`` gave for this key, if it is known.
    """
    hot = hot_keys(df, key) if hot is None else hot
    before = lambda *keys: {previous: F.lag(us()).over(Window.partitionBy(*keys).orderBy(us(), "transaction_id"))} if previous else {}
    if not hot.head(1):
        made = make(lambda start, end: Window.partitionBy(key).orderBy(us()).rangeBetween(start, end))
        return df.withColumns(made | before(key))
    width = max(back, ahead, 1)
    shifts = F.array(F.lit(0), *([F.lit(1)] if back else []), *([F.lit(-1)] if ahead else []))
    rows = df.join(hot, key, "left").withColumn("_shift", F.explode(F.when(F.col("_hot"), shifts).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumn("_slice", F.when(F.col("_hot"), F.floor(us() / width) + F.col("_shift")).otherwise(F.lit(0).cast("long")))
    made = make(lambda start, end: Window.partitionBy(key, "_slice").orderBy(us()).rangeBetween(start, end))
    out = rows.withColumns(made | before(key, "_slice")).where("_shift = 0")
    if previous:
        ends = df.join(hot, key).groupBy(key, F.floor(us() / width).alias("_slice")).agg(F.max(us()).alias("_end"))
        ends = ends.select(key, "_slice", F.lag("_end").over(Window.partitionBy(key).orderBy("_slice")).alias("_carried"))  # a row a slice
        out = out.join(ends, [key, "_slice"], "left").withColumn(previous, F.coalesce(previous, "_carried")).drop("_carried")
    return out.drop("_hot", "_shift", "_slice")
