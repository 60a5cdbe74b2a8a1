"""Search hits: filters, reciprocal pairs, annotations and clusters.

A hit table has one row per aligned part: query, subject, match_rank, part_rank, spans
and scores.  Filters work on parts, then on matches (parts of one query and subject).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import intervals as I


def matches(parts: DataFrame, score: str = "expect") -> DataFrame:
    """One row per query and subject: spans, and the first part's score."""
    first = F.min_by(score, F.col("part_rank"))
    return parts.groupBy("query", "subject").agg(
        F.min("match_rank").alias("match_rank"), F.min("q_start").alias("start"), F.max("q_end").alias("end"), F.min("s_start").alias("subject_start"), F.max("s_end").alias("subject_end"), first.alias(score), F.count("*").alias("parts"),
    )


def score_threshold(parts: DataFrame, score: str, least: float | None = None, most: float | None = None) -> DataFrame:
    """Parts at or above ``least``, or at or below ``most``."""
    if least is None and most is None:
        raise ValueError("a least or a most score is needed")
    ok = F.lit(False)
    if least is not None:
        ok = ok | (F.col(score) >= least)
    if most is not None:
        ok = ok | (F.col(score) <= most)
    return parts.where(ok)


def best_scores(parts: DataFrame, score: str, tolerance: float, least: float | None = None, most: float | None = None) -> DataFrame:
    """Parts whose score lies within a factor of the query's first match's.

    With ``most`` set, zero always passes; scores at or beyond a limit don't.  A best
    score of zero counts as log 0, so only zeros and scores within the factor of 1 pass.
    """
    w = Window.partitionBy("query").orderBy("match_rank", "part_rank", "subject", "q_start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.first(score).over(w)
    s = F.col(score)
    log_best = F.when(F.col("_best") == 0, 0.0).otherwise(F.log10(F.abs("_best")))
    near = F.abs(F.log10(F.when(s != 0, s)) - log_best) < F.log10(F.lit(float(tolerance)))
    ok = F.lit(False)
    if most is not None:
        ok = s == 0
    inside = F.lit(True)
    if least is not None:
        inside = inside & (s > least)
    if most is not None:
        inside = inside & (s < most)
    return parts.withColumn("_best", best).where(ok | (inside & F.coalesce(near, F.lit(False)))).drop("_best")


def min_length(parts: DataFrame, residues: int | None = None, percent: float | None = None, on_query: bool = True, length: str | None = None) -> DataFrame:
    """Matches that cover enough residues, or enough percent, of the query (or subject)."""
    if (residues is None) == (percent is None):
        raise ValueError("either residues or percent")
    start, end = ("q_start", "q_end") if on_query else ("s_start", "s_end")
    covered = I.covered_length(parts, ["query", "subject"], start, end)
    if residues is not None:
        good = covered.where(F.col("covered") >= residues)
    else:
        length = length or ("q_len" if on_query else "s_len")
        sizes = parts.groupBy("query", "subject").agg(F.max(length).alias("_n"))
        good = covered.join(sizes, ["query", "subject"]).where(F.col("covered") * 100.0 / F.col("_n") >= percent)
    return parts.join(good.select("query", "subject"), ["query", "subject"], "left_semi")


def without_self(parts: DataFrame) -> DataFrame:
    return parts.where("query <> subject")


def with_hits(seqs: DataFrame, parts: DataFrame, name: str = "name", reverse: bool = False) -> DataFrame:
    """Sequences that have a hit (or, reversed, none)."""
    return seqs.join(parts.select(F.col("query").alias(name)), name, "left_anti" if reverse else "left_semi")


def without_match(seqs: DataFrame, parts: DataFrame, name: str = "name") -> DataFrame:
    """Sequences that are neither a query nor a subject."""
    named = parts.select(F.col("query").alias(name)).union(parts.select(F.col("subject").alias(name)))
    return seqs.join(named, name, "left_anti")


def reciprocal(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs that hit each other in both directions."""
    a = first.select("query", "subject").distinct()
    b = second.select(F.col("subject").alias("query"), F.col("query").alias("subject")).distinct()
    return a.join(b, ["query", "subject"])


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that are in one of the tables only."""
    both = a.select(key, F.lit(1).alias("_s")).unionByName(b.select(key, F.lit(2).alias("_s")))
    return both.groupBy(key).agg(F.min("_s").alias("_a"), F.max("_s").alias("_b")).where("_a = _b").select(key)


def orthologs(seqs: DataFrame, pairs: DataFrame, name: str = "name", out: str = "orthologs") -> DataFrame:
    """Sequences with the sorted array of their partners (empty where none)."""
    found = pairs.groupBy(F.col("query").alias(name)).agg(F.array_sort(F.collect_set("subject")).alias(out))
    return seqs.join(found, name, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def describe(seqs: DataFrame, parts: DataFrame, descriptions: DataFrame, name: str = "name") -> DataFrame:
    """The description of the first hit of the first database that has one.

    ``parts`` has db and db_order, ``descriptions`` subject and description.
    """
    w = Window.partitionBy("query").orderBy("db_order", "match_rank", "subject")
    first = parts.withColumn("_r", F.row_number().over(w)).where("_r = 1").join(descriptions, "subject", "left")
    text = F.format_string("Similar to %s (%s:%s)", F.coalesce("description", F.lit("")), "db", "subject")
    return seqs.join(first.select(F.col("query").alias(name), text.alias("similar_to")), name, "left")


def introns(parts: DataFrame, least: int = 20) -> DataFrame:
    """Points of a transcript where neighbouring aligned parts leave a gap on the genome."""
    w = Window.partitionBy("query", "subject").orderBy("q_start", "q_end")
    rows = parts.withColumn("_s", F.lag("s_end").over(w)).withColumn("_q", F.lag("q_end").over(w))
    return rows.where(F.col("s_start") - F.col("_s") - 1 >= least).select("query", F.col("_q").alias("position"), (F.col("s_start") - F.col("_s") - 1).alias("intron_length"))


def clusters(pairs: DataFrame, a: str = "a", b: str = "b", checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """Transitive clusters of pairs: (node, cluster), the cluster named by its smallest node.

    Stars are contracted until every node points to a root: each round joins edges with
    the least neighbour of their ends, and its result is checkpointed.
    """
    e = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    alone = e.where("u = v").select("u")
    e = checkpoint(e.where("u <> v"))
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        e = star.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(e.union(low.select("u", F.col("m").alias("v"))).distinct())
        many = e.groupBy("u").count().where("count > 1").select("u")
        open_ = e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi")
        if not many.union(open_).limit(1).count():
            break
    out = e.select(F.col("u").alias("node"), F.col("v").alias("cluster")).union(e.select("v", "v").distinct())
    return out.union(alone.join(out.select(F.col("node").alias("u")), "u", "left_anti").select("u", F.col("u").alias("c")))


def longest_of_each(members: DataFrame, cluster: str = "cluster", name: str = "name", length: Column | str = "length") -> DataFrame:
    """The longest member of each cluster, the smaller name on a tie."""
    length = F.col(length) if isinstance(length, str) else length
    return members.groupBy(cluster).agg(F.min(F.struct((-length).alias("n"), F.col(name).alias("m"))).alias("t")).select(cluster, F.col("t.m").alias(name), (-F.col("t.n")).alias("length"))


def contaminants(seqs: DataFrame, parts: DataFrame, similarity: float = 96, share: float = 60, name: str = "name", reverse: bool = False) -> DataFrame:
    """Sequences (or, reversed, all others) with a hit on a contaminant: parts of at least ``similarity`` that together cover ``share`` percent of the subject.

    ``parts`` has s_len, the subject's length; parts that overlap on it count once.
    """
    from strandline.operators import intervals

    good = parts.where(F.col("similarity") >= similarity).select("query", "subject", "s_len", F.least("s_start", "s_end").alias("start"), F.greatest("s_start", "s_end").alias("end"))
    covered = intervals.covered_length(good, ["query", "subject", "s_len"])
    found = covered.where(F.col("covered") * 100 >= F.col("s_len") * share).select(F.col("query").alias(name)).distinct()
    return seqs.join(found, name, "left_anti" if reverse else "left_semi")
