"""Running values along a place, in two levels, so that no key is one task.

A key's rows are cut into bins of places.  Each bin is scanned by itself; a second scan goes over
one row a bin, and its result is carried into the bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in a bin, if not given.
WIDTH = 100_000


def _binned(df: DataFrame, place: str, width: int) -> DataFrame:
    return df.withColumn("_bin", F.floor(F.col(place) / width))


def running(df: DataFrame, keys: list[str], place: str, value: Column, how: str = "sum", out: str = "running", ties: tuple[str, ...] = (), before: bool = False, width: int = WIDTH) -> DataFrame:
    """``df`` with the sum or max of ``value`` over the rows up to each row (or, ``before``, without it), by place and then ``ties``.

    Null values count as nothing; where nothing came before, the result is null.
    """
    f = {"sum": F.sum, "max": F.max}[how]
    rows = _binned(df, place, width).withColumn("_v", value)
    local = Window.partitionBy(*keys, "_bin").orderBy(place, *ties).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    bins = rows.groupBy(*keys, "_bin").agg(f("_v").alias("_v"))
    over = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "_bin", f("_v").over(over).alias("_carry"))
    rows = rows.withColumn("_own", f("_v").over(local)).drop("_v").join(bins, [*keys, "_bin"])
    both = F.greatest("_own", "_carry") if how == "max" else F.coalesce(F.col("_own") + F.col("_carry"), "_own", "_carry")
    return rows.withColumn(out, both).drop("_own", "_carry", "_bin")


def following(df: DataFrame, keys: list[str], place: str, out: str = "next", width: int = WIDTH) -> DataFrame:
    """``df`` with the place of the next row of its key, null for the last."""
    rows = _binned(df, place, width)
    bins = rows.groupBy(*keys, "_bin").agg(F.min(place).alias("_first"))
    bins = bins.select(*keys, "_bin", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bin")).alias("_next"))
    rows = rows.withColumn("_own", F.lead(place).over(Window.partitionBy(*keys, "_bin").orderBy(place))).join(bins, [*keys, "_bin"])
    return rows.withColumn(out, F.coalesce("_own", "_next")).drop("_own", "_next", "_bin")


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int, *more: Column, width: int = WIDTH) -> DataFrame:
    """Unions of segments whose starts lie at most ``gap`` after all ends before: keys, start, end and the aggregates ``more``.

    Segments are united within bins first; only what is left of a bin goes through the two-level scans.
    ``more`` are sums, minima, maxima or counts over columns of the same name.
    """
    w = Window.partitionBy(*keys, "_bin").orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = _binned(df, start, width).withColumn("_new", (reach.isNull() | (F.col(start) > reach + gap)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*keys, "_bin", "_island").agg(F.min(start).alias(start), F.max(end).alias(end), *more).drop("_bin", "_island")
    # Within a bin unions are apart, so one joins what came before only if an earlier bin reaches it.
    parts = running(parts, keys, start, F.col(end), "max", "_reach", before=True, width=width)
    fresh = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap), F.col(start))
    parts = running(parts.withColumn("_fresh", fresh).drop("_reach"), keys, start, F.col("_fresh"), "max", "_island", width=width)
    return parts.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), *more).drop("_island")
