"""Interval algebra on inclusive, 0-based segments, as tables or as arrays.

Table forms take one row per segment with a key column; array forms take one array of
(start, end) per row and stay within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import let
from strandline.operators import scans


def merge(df: DataFrame, key: str | list[str], start: str = "start", end: str = "end", gap: int = 1, bin_width: int | None = None) -> DataFrame:
    """Unions of segments that overlap or lie at most ``gap`` apart (1: adjacent ones join).

    With ``bin_width``, segments are merged within bins of their starts and their unions by a two-level scan, so that a key
    with very many segments is shared by its bins.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if bin_width:
        return scans.islands(df, keys, start, end, gap, width=bin_width)
    return _merged(df, keys, start, end, gap)


def _merged(df: DataFrame, keys: list[str], start: str, end: str, gap: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_new", fresh).withColumn("_island", island).groupBy(*keys, "_island")
    return out.agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def partition(merged: DataFrame, lengths: DataFrame, key: str, length: str = "length", start: str = "start", end: str = "end") -> DataFrame:
    """Covered and free pieces, with a flag, of each whole [0, length - 1]; ``merged`` is disjoint."""
    w = Window.partitionBy(key).orderBy(start)
    rows = lengths.select(key, length).join(merged, key, "left")
    before = F.coalesce(F.lag(end).over(w) + 1, F.lit(0))
    last = F.lead(start).over(w).isNull()
    rows = rows.withColumn("_before", before).withColumn("_last", last)
    piece = lambda a, b, covered: F.struct(a.cast("long").alias(start), b.cast("long").alias(end), F.lit(covered).alias("covered"))
    none = F.col(start).isNull()
    pieces = F.when(none, F.array(piece(F.lit(0), F.col(length) - 1, False))).otherwise(
        F.array(
            piece(F.col("_before"), F.col(start) - 1, False), piece(F.col(start), F.col(end), True),
            piece(F.when(F.col("_last"), F.col(end) + 1).otherwise(F.lit(0)), F.when(F.col("_last"), F.col(length) - 1).otherwise(F.lit(-1)), False),
        )
    )
    out = rows.select(key, F.explode(pieces).alias("p")).select(key, "p.*")
    return out.where(F.col(end) >= F.col(start))


def complement(merged: DataFrame, lengths: DataFrame, key: str, length: str = "length", start: str = "start", end: str = "end") -> DataFrame:
    return partition(merged, lengths, key, length, start, end).where(~F.col("covered")).drop("covered")


def longest_free(merged: DataFrame, lengths: DataFrame, key: str, length: str = "length", start: str = "start", end: str = "end") -> DataFrame:
    """The longest free piece of each key, the first on a tie; keys without one are absent."""
    free = complement(merged, lengths, key, length, start, end)
    top = F.max(F.struct((F.col(end) - F.col(start) + 1).alias("n"), (-F.col(start)).alias("s"), F.col(end).alias("e"))).alias("t")
    return free.groupBy(key).agg(top).select(key, (-F.col("t.s")).alias(start), F.col("t.e").alias(end), F.col("t.n").alias("free_length"))


def covered_length(df: DataFrame, key: str | list[str], start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """Total length of the merged segments of each key."""
    keys = [key] if isinstance(key, str) else list(key)
    return merge(df, keys, start, end, gap).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start) + 1).alias("covered"))


def reverse(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """A segment on the other strand."""
    return length - end - 1, length - start - 1


def merge_array(segments: Column) -> Column:
    """Merged form of an array of (start, end), adjacent segments joined; a fold within the row."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(s["start"] <= last["end"] + 1, joined).otherwise(F.concat(acc, F.array(s))).cast(kind)

    def fold(ordered: Column) -> Column:
        first = F.slice(ordered, 1, 1).cast(kind)
        rest = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))).cast(kind)
        return F.aggregate(rest, first, step)

    return let(F.sort_array(F.filter(segments, lambda s: s["end"] >= s["start"])), fold)


def free_array(merged: Column, length: Column) -> Column:
    """Free pieces of [0, length - 1] beside a merged array."""

    def cut(m: Column, n: Column) -> Column:
        piece = lambda i: F.struct(F.coalesce(F.get(m, i - 1)["end"] + 1, F.lit(0)).alias("start"), F.coalesce(F.get(m, i)["start"] - 1, n - 1).alias("end"))
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(m)), piece), lambda s: s["end"] >= s["start"])

    return let(merged, lambda m: let(length, lambda n: cut(m, n)))


def longest_array(segments: Column) -> Column:
    """The longest (start, end) of an array, the first on a tie; null for an empty array."""
    keyed = F.transform(segments, lambda s: F.struct((s["end"] - s["start"]).alias("n"), (-s["start"]).alias("s"), s["end"].alias("end")))
    return let(F.array_max(keyed), lambda best: F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["end"].alias("end"))))


def range_join(points: DataFrame, segments: DataFrame, key: str, at: str, start: str, end: str, width: int = 10_000) -> DataFrame:
    """Points with the segments that hold them: an equi-join on (key, bin), each segment under every bin it meets.

    A frequent key is spread over its bins; choose ``width`` near the segments' length.
    """
    binned = segments.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    left = points.withColumn("_bin", F.floor(F.col(at) / width))
    return left.join(binned, [key, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bin")


def elementary(a: DataFrame, b: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Elementary pieces of two segment sets, with flags of which sets cover each."""
    one = a.select(key, F.col(start).alias("p"), F.lit(1).alias("da"), F.lit(0).alias("db")).unionByName(a.select(key, (F.col(end) + 1).alias("p"), F.lit(-1).alias("da"), F.lit(0).alias("db")))
    two = b.select(key, F.col(start).alias("p"), F.lit(0).alias("da"), F.lit(1).alias("db")).unionByName(b.select(key, (F.col(end) + 1).alias("p"), F.lit(0).alias("da"), F.lit(-1).alias("db")))
    events = one.unionByName(two).groupBy(key, "p").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(key).orderBy("p")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("in_a", F.sum("da").over(run) > 0).withColumn("in_b", F.sum("db").over(run) > 0).withColumn(end, F.lead("p").over(w) - 1)
    return out.where(F.col(end).isNotNull()).select(key, F.col("p").alias(start), end, "in_a", "in_b")
