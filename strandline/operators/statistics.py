"""Distribution statistics, all from tables of value counts.

A value-count table has as many rows as distinct values, so quantiles and histograms
over it need one shuffle of partial counts, however many rows there were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, sum, extremes, mean and population variance."""
    v = F.col(value)
    aggs = [F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("average"), F.var_pop(v).alias("variance")]
    return df.groupBy(*(by or [])).agg(*aggs)


def value_counts(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*(by or []), F.col(value).alias("value")).agg(F.count("*").alias("n"))


def cumulative(counts: DataFrame, by: list[str] | None = None, cuts: int = 200) -> DataFrame:
    """``counts`` (value, n) with ``upto``, the rows at or below each value, within the groups ``by``.

    Values are dealt to ranges between sampled cut points, so neither many values nor one
    large group meet in one task; only the ranges' sums do.
    """
    keys = by or []
    points = sorted({r[0] for r in counts.select("value").orderBy(F.xxhash64("value", *keys)).limit(cuts).collect()})
    kind = dict(counts.dtypes)["value"]
    edges = F.array(*[F.lit(x) for x in points]).cast(f"array<{kind}>")
    rows = counts.withColumn("_b", F.size(F.filter(edges, lambda c: c <= F.col("value"))))
    sums = rows.groupBy(*keys, "_b").agg(F.sum("n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("n").over(Window.partitionBy(*keys, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_w", within).join(sums.select(*keys, "_b", before.alias("_before")), [*keys, "_b"]).withColumn("upto", F.col("_w") + F.col("_before")).drop("_b", "_w", "_before")


def quantiles(counts: DataFrame, fractions: list[float], by: list[str] | None = None) -> DataFrame:
    """Linearly interpolated quantiles (fraction, value) of value counts, in each group."""
    keys = by or []
    t = cumulative(counts, by)
    one = F.lit(1) if not keys else None
    n = t.groupBy(*(keys or [one.alias("_one")])).agg(F.sum("n").alias("_total"))
    asked = n.select(*keys, "_total", F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
    place = F.col("fraction") * (F.col("_total") - 1)
    asked = asked.withColumn("_lo", F.floor(place)).withColumn("_hi", F.ceil(place)).withColumn("_w", place - F.floor(place))
    rows = t.join(asked, keys) if keys else t.crossJoin(F.broadcast(asked))
    first = F.col("upto") - F.col("n")
    at = lambda p: F.max(F.when((F.col(p) >= first) & (F.col(p) < F.col("upto")), F.col("value")))
    near = rows.where(((F.col("_lo") >= first) & (F.col("_lo") < F.col("upto"))) | ((F.col("_hi") >= first) & (F.col("_hi") < F.col("upto"))))
    out = near.groupBy(*keys, "fraction", "_w").agg(at("_lo").cast("double").alias("a"), at("_hi").cast("double").alias("b"))
    return out.select(*keys, "fraction", (F.col("a") + (F.col("b") - F.col("a")) * F.col("_w")).alias("value"))


def quartiles(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Median, quartiles, inter-quartile range and outlier limits of integers.

    A position that falls on the last row of a value gives the mean (cut to an integer)
    of it and the next value that occurs; at the very end, the value itself.  The
    median of n values is at n div 2 and the one after, or the middle one; the lower
    quartile is the median's rule at its position, the upper at its position plus n.
    """
    keys = by or []
    counts = value_counts(df, value, by)
    if not keys:
        counts, keys = counts.withColumn("_k", F.lit(1)), ["_k"]
    w = Window.partitionBy(*keys).orderBy("value")
    t = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("value").over(w))
    n = t.groupBy(*keys).agg(F.sum("n").alias("total"))
    place = lambda m: F.floor(m / 2) + F.when(m % 2 == 0, 0).otherwise(1)
    mid = place(F.col("total"))
    n = n.withColumn("p2", mid).withColumn("p1", place(mid)).withColumn("p3", place(mid + F.col("total")))
    rows = t.join(n, keys)

    def at(p: str) -> Column:
        here = (F.col(p) <= F.col("upto")) & (F.col(p) > F.col("upto") - F.col("n"))
        mean = F.floor((F.col("value") + F.coalesce("next", "value")) / 2)
        return F.max(F.when(here, F.when(F.col(p) == F.col("upto"), mean).otherwise(F.col("value")))).cast("long")

    out = rows.groupBy(*keys).agg(at("p1").alias("quartile_1"), at("p2").alias("median"), at("p3").alias("quartile_3"))
    iqr = F.col("quartile_3") - F.col("quartile_1")
    reach = F.floor(iqr * 1.5 + 0.5).cast("long")
    out = out.withColumn("iqr", iqr).withColumn("low_limit", F.col("quartile_1") - reach).withColumn("high_limit", F.col("quartile_3") + reach)
    return out.drop("_k")


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None, clip: tuple[float, float] | None = None, integers: bool = False) -> DataFrame:
    """Equal bins, the last one closed; values out of range are left out; empty bins stay with 0.

    ``clip`` takes percentiles as limits where they cut anything.  Integer bins have
    integer widths: there are no more of them than the span, which is widened to a
    multiple of their number.
    """
    row = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError("no numbers")
    lo, hi = (row["lo"] if low is None else low), (row["hi"] if high is None else high)
    if clip:
        ends = {r["fraction"]: r["value"] for r in quantiles(value_counts(df, value), [c / 100 for c in clip]).collect()}
        lo, hi = max(lo, ends[clip[0] / 100]), min(hi, ends[clip[1] / 100])
    if integers:
        lo, hi = int(lo // 1), int(-(-hi // 1))
    if lo == hi:
        hi = lo + 1
    span = hi - lo
    if integers:
        bins = min(bins, span)
        span += -span % bins
        width: float = span // bins
    else:
        width = span / bins
    v = F.col(value).cast("double")
    bin_ = F.least(F.floor((v - lo) / float(width)).cast("long"), F.lit(bins - 1))
    got = df.where(v.between(float(lo), float(lo + span))).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    edge = lambda k: (F.lit(float(lo)) + k * float(width))
    return every.join(got, "bin", "left").select("bin", edge(F.col("bin")).alias("left_edge"), edge(F.col("bin") + 1).alias("right_edge"), F.coalesce("n", F.lit(0)).alias("n"))


# Limits of the automatic number of bins, and values in one.
MIN_BINS, MAX_BINS, VALUES_IN_BIN = 20, 500, 10000


def distribution(df: DataFrame, value: str, bins: int | None = None, outliers_percent: float | None = None, min_bins: int = MIN_BINS, max_bins: int = MAX_BINS, mean_in_bin: int = VALUES_IN_BIN) -> DataFrame:
    """Histogram of integers with automatic bins, and optionally without rank-percent outliers at both ends."""
    counts = value_counts(df, value)
    s = counts.agg(F.min("value"), F.max("value"), F.sum("n")).first()
    if s[0] is None:
        return df.sparkSession.createDataFrame([], "bin long, left_edge double, right_edge double, n long")
    lo, hi, n = int(s[0]), int(s[1]), int(s[2])
    if outliers_percent:
        upto = cumulative(counts)
        left = int(n * outliers_percent // 100)
        a = upto.where(F.col("upto") > left).agg(F.min("value")).first()[0]
        b = upto.where(F.col("upto") > n - left).agg(F.min("value")).first()[0]
        lo, hi = max(lo, int(a)), min(hi, int(b) if b is not None else hi)
    if bins is None:
        bins = 1 if hi == lo else hi - lo if hi - lo < min_bins else min(max(n // mean_in_bin, min_bins), max_bins, hi - lo)
    return histogram(df, value, bins, lo, hi, integers=True)


def boxplot(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, deviation and quartiles of each group."""
    q = quantiles(value_counts(df, value, [by]), [0.25, 0.5, 0.75], [by])
    q = q.groupBy(F.col(by).alias("_by")).agg(*[F.max(F.when(F.col("fraction") == f, F.col("value"))).alias(a) for f, a in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    out = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.join(q, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "mean", "std", "q1", "median", "q3")


def qualities_by_position(df: DataFrame, quality: str = "qual") -> DataFrame:
    return boxplot(df.select(F.posexplode(quality).alias("pos", "q")), "pos", "q")


def percentiles(df: DataFrame, value: str, percents: list[float]) -> DataFrame:
    """Linearly interpolated percentiles, one row each."""
    got = quantiles(value_counts(df, value), [p / 100 for p in percents])
    asked = df.sparkSession.createDataFrame([(float(p), p / 100) for p in percents], "percent double, fraction double")
    return asked.join(got, "fraction", "left").select("percent", "value")


def stacked(df: DataFrame, by: str, classes: str) -> DataFrame:
    """Counts of each class in each group, with totals over either and both."""
    return df.cube(by, classes).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def joint_histogram(df: DataFrame, a: str, b: str, bins: int | tuple[int, int] = 20, clip: tuple[float, float] | None = None, low: tuple = (None, None), high: tuple = (None, None)) -> DataFrame:
    """Counts over equal bins of two columns at once: a_bin, b_bin, their left edges a_left and b_left, and n; cells without rows are absent.

    Limits come from one pass over both columns, unless ``low`` and ``high`` give them; ``clip`` takes percentiles of each column as limits where they cut anything.
    Rows with a null, or with a value beyond a limit, are left out; a limit's own value falls into the last bin.
    """
    n = (bins, bins) if isinstance(bins, int) else bins
    rows = df.select(F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).where("_a is not null and _b is not null and not isnan(_a) and not isnan(_b)")
    got = rows.agg(*[f(c) for c in ("_a", "_b") for f in (F.min, F.max)]).first()
    if got[0] is None:
        return df.sparkSession.createDataFrame([], "a_bin long, b_bin long, a_left double, b_left double, n long")
    cells = []
    for k, c in enumerate(("_a", "_b")):
        lo, hi = got[2 * k] if low[k] is None else float(low[k]), got[2 * k + 1] if high[k] is None else float(high[k])
        if clip:
            ends = {r["fraction"]: r["value"] for r in quantiles(value_counts(rows, c), [x / 100 for x in clip]).collect()}
            lo, hi = max(lo, ends[clip[0] / 100]), min(hi, ends[clip[1] / 100])
        hi = hi if hi > lo else lo + 1
        width = (hi - lo) / n[k]
        cells.append((F.least(F.floor((F.col(c) - lo) / width).cast("long"), F.lit(n[k] - 1)), F.col(c).between(lo, hi), lo, width))
    (a_bin, a_in, a_lo, a_w), (b_bin, b_in, b_lo, b_w) = cells
    out = rows.where(a_in & b_in).groupBy(a_bin.alias("a_bin"), b_bin.alias("b_bin")).agg(F.count("*").alias("n"))
    return out.select("a_bin", "b_bin", (F.lit(a_lo) + F.col("a_bin") * a_w).alias("a_left"), (F.lit(b_lo) + F.col("b_bin") * b_w).alias("b_left"), "n")


def distribution_difference(df: DataFrame, value: str, side: Column, bins: int = 20) -> DataFrame:
    """Two distributions over the same equal bins, in one pass: bin, left_edge, n_true and n_false by ``side``, and their difference; empty bins stay.

    Rows with a null value or a null side are left out.
    """
    rows = df.select(F.col(value).cast("double").alias("_v"), side.alias("_s")).where("_v is not null and _s is not null")
    lo, hi = rows.agg(F.min("_v"), F.max("_v")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin long, left_edge double, n_true long, n_false long, difference long")
    width = ((hi if hi > lo else lo + 1) - lo) / bins
    count = lambda c: F.sum(c.cast("long"))
    got = rows.groupBy(F.least(F.floor((F.col("_v") - lo) / width).cast("long"), F.lit(bins - 1)).alias("bin")).agg(count(F.col("_s")).alias("t"), count(~F.col("_s")).alias("f"))
    out = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(got, "bin", "left")
    t, f = F.coalesce("t", F.lit(0)), F.coalesce("f", F.lit(0))
    return out.select("bin", (F.lit(lo) + F.col("bin") * width).alias("left_edge"), t.alias("n_true"), f.alias("n_false"), (t - f).alias("difference"))
