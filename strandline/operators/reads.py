"""Read cleaning: trimming, masking, adaptors and filters on a table of reads.

A read is a row with a name, a sequence, and an optional quality array.  Trimming
operators add segments to the array columns ``quality_trim``, ``vector_trim`` and
``mask``; ``trim_and_mask`` applies them.  Segments are inclusive and 0-based.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import keep, let
from strandline.functions import sequence as S
from strandline.operators import intervals as I

SEGMENTS = "array<struct<start:int,end:int>>"


def _segment(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _nothing() -> Column:
    return F.array().cast(SEGMENTS)


def _add(df: DataFrame, column: str, segments: Column) -> DataFrame:
    old = F.coalesce(F.col(column), _nothing()) if column in df.columns else _nothing()
    return df.withColumn(column, F.concat(old, F.filter(segments, lambda s: s["end"] >= s["start"]).cast(SEGMENTS)))


def up_case(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.withColumn(seq, S.upper(F.col(seq)))


def trim_edges(df: DataFrame, left: int = 0, right: int = 0, seq: str = "seq", into: str = "quality_trim") -> DataFrame:
    """Marks so many bases at either end; the sides are independent."""
    n = F.length(seq)
    parts = F.array(_segment(F.lit(0), F.lit(left or 0) - 1), _segment(n - (right or 0), n - 1))
    return _add(df, into, parts)


def window_means(quality: Column, width: Column | int) -> Column:
    """Mean over the ``width`` neighbours on each side, cut at the ends."""
    width = F.lit(width) if isinstance(width, int) else width

    def means(q: Column, w: Column) -> Column:
        def at(i: Column) -> Column:
            lo = F.greatest(i - w, F.lit(0))
            part = F.slice(q, lo + 1, i + w + 1 - lo)
            return let(part, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v) / F.size(x))

        return F.when(F.size(q) == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(q) - 1), at))

    return let(quality, lambda q: let(width, lambda w: means(q, w)))


def good_extreme(good: Column, least: Column | int) -> Column:
    """Where the good part of a boolean array begins.

    Good positions are counted while a good stretch lasts, over all stretches; the one
    that opens a later stretch isn't counted but becomes the answer.  The fold stops
    when ``least`` are counted.  An array that is good from its beginning gives 0; one
    that ends in a bad stretch without any answer gives null.
    """
    bound = F.lit(least) if isinstance(least, int) else least
    return let(bound, lambda n: _good_extreme(good, n))


def _good_extreme(good: Column, least: Column) -> Column:
    zero = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).alias("n"), F.lit(True).alias("inside"), F.lit(0).alias("i"))

    def step(acc: Column, g: Column) -> Column:
        opened = g & ~acc["inside"]
        moved = F.struct(
            F.when(opened, acc["i"]).otherwise(acc["at"]).alias("at"), (acc["n"] + F.when(g & acc["inside"], 1).otherwise(0)).alias("n"),
            F.coalesce(g, F.lit(False)).alias("inside"), (acc["i"] + 1).alias("i"),
        )
        return F.when(acc["n"] >= least, acc).otherwise(moved)

    return F.aggregate(good, zero, step, lambda acc: F.when(acc["at"].isNull() & acc["inside"], 0).otherwise(acc["at"]))


def trim_quality(
    df: DataFrame, threshold: float, min_bases: int | None = None, min_length: int | None = None, window: int | None = None, only_3_end: bool = False, seq: str = "seq", quality: str = "qual", into: str = "quality_trim",
) -> DataFrame:
    """Marks the bad ends of reads; reads whose good part is too short are dropped.

    Unset parameters depend on a read's length, as in the table of defaults below.
    """
    q = F.col(quality)
    n = F.size(q)
    bases = F.lit(min_bases) if min_bases is not None else F.when(n < 45, 3).when(n < 70, 6).when(n < 300, 15).otherwise(25)
    width = F.lit(window) if window is not None else F.when(n < 70, 2).when(n < 300, 3).otherwise(4)
    least = F.lit(min_length) if min_length is not None else F.least(F.floor(n / 2), F.lit(100))
    good = F.transform(window_means(q, width), lambda x: x > threshold)

    def ends(g: Column) -> Column:
        start = F.lit(0) if only_3_end else good_extreme(g, bases)
        return F.struct(start.alias("start"), (n - 1 - good_extreme(F.reverse(g), bases)).alias("end"), least.cast("int").alias("least"))

    out = keep(df, let(good, ends), "_t", lambda t: t["start"].isNotNull() & t["end"].isNotNull() & (t["end"] - t["start"] >= t["least"]))
    parts = F.array(_segment(F.lit(0), F.col("_t.start") - 1), _segment(F.col("_t.end") + 1, F.length(seq) - 1))
    return _add(out, into, parts).drop("_t")


#: Letters of the pieces, and of the pieces of these, that a text is masked in.
CHUNKS = (16_384, 512)


def mask_text(seq: Column, segments: Column) -> Column:
    """Lower case inside any of the segments.

    A text is cut into pieces, and these at the ends of the joined segments that they meet, so that no letter is compared with all segments.
    """

    def lowered(text: Column) -> Column:
        # Letter by letter where one's lower case may depend on others.
        return let(text, lambda x: F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.array_join(F.transform(S.letters(x), lambda c: F.lower(c)), "")))

    def cut(part: Column, met: Column, n: int) -> Column:
        begin = lambda i: F.coalesce(F.get(met, i - 1)["end"] + 1, F.lit(0))
        piece = lambda s, i: let(begin(i), lambda b: F.concat(F.substring(part, b + 1, s["start"] - b), lowered(F.substring(part, s["start"] + 1, s["end"] - s["start"] + 1))))
        return F.concat(F.array_join(F.transform(met, piece), ""), F.substring(part, begin(F.size(met)) + 1, F.lit(n)))

    def masked(text: Column, spans: Column, n: int, *smaller: int) -> Column:
        def one(part: Column, j: Column) -> Column:
            at = j * n
            met = F.filter(spans, lambda s: (s["end"] >= at) & (s["start"] < at + n))
            moved = F.transform(met, lambda s: _segment(F.greatest(s["start"] - at, F.lit(0)), F.least(s["end"] - at, F.lit(n - 1))))
            return let(moved, lambda m: F.when(F.size(m) == 0, part).otherwise(masked(part, m, *smaller) if smaller else cut(part, m, n)))

        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{n}}}"), 0), one), "")

    return let(F.coalesce(I.merge_array(segments), _nothing()), lambda spans: masked(seq, spans, *CHUNKS))


def trim_and_mask(df: DataFrame, mask: bool = True, trim: bool = True, trim_as_mask: bool = False, keep_5: bool = False, seq: str = "seq", quality: str = "qual") -> DataFrame:
    """Applies the segments: masks in lower case, then keeps the longest free part (or the first).

    Reads without a free part, or with one that is the first base alone, are dropped;
    with ``trim_as_mask`` the rest of a read is masked instead of cut, and a read
    without a free part wholly.
    """
    have = set(df.columns)
    col = lambda c: F.coalesce(F.col(c), _nothing()) if c in have else _nothing()
    n = F.length(seq)
    out = df.withColumn("_cut", F.concat(col("vector_trim"), col("quality_trim")))
    if mask and "mask" in have:
        out = out.withColumn(seq, F.when(F.size(col("mask")) > 0, mask_text(F.col(seq), col("mask"))).otherwise(F.col(seq)))
    if trim:
        if keep_5:
            first = F.array_min(F.transform("_cut", lambda s: s["start"]))
            part = _segment(F.lit(0), F.greatest(first - 1, F.lit(0)))
        else:
            part = I.longest_array(I.free_array(I.merge_array(F.col("_cut")), n))
        whole = F.size("_cut") == 0
        found = F.struct(whole.alias("uncut"), F.when(~whole, part).alias("part"))
        dropped = lambda t: ~t["uncut"] & (t["part"].isNull() | ((t["part"]["start"] == 0) & (t["part"]["end"] == 0)))
        out = keep(out, found, "_t", None if trim_as_mask else lambda t: ~F.coalesce(dropped(t), F.lit(True)))
        uncut, p = F.col("_t.uncut"), F.col("_t.part")
        if trim_as_mask:
            rest = F.when(p.isNull(), F.array(_segment(F.lit(0), n))).otherwise(F.array(_segment(F.lit(0), p["start"] - 1), _segment(F.when(p["end"] == 0, 0).otherwise(p["end"] + 1), n)))
            out = out.withColumn(seq, F.when(uncut, F.col(seq)).otherwise(mask_text(F.col(seq), rest)))
        else:
            out = out.withColumn(seq, F.when(uncut, F.col(seq)).otherwise(F.substring(F.col(seq), p["start"] + 1, p["end"] - p["start"] + 1)))
            if quality in have:
                out = out.withColumn(quality, F.when(uncut | F.col(quality).isNull(), F.col(quality)).otherwise(F.slice(F.col(quality), p["start"] + 1, p["end"] - p["start"] + 1)))
            if "mask" in have:
                moved = F.transform(col("mask"), lambda s: _segment(F.greatest(s["start"] - p["start"], F.lit(0)), s["end"] - p["start"]))
                out = out.withColumn("mask", F.when(uncut, F.col("mask")).otherwise(moved))
        out = out.drop("_t")
    return out.drop("_cut", *({"vector_trim", "quality_trim"} & have if trim else ()))


def match_spans(seq: Column, pattern: str) -> Column:
    """Spans of all non-overlapping matches of a regular expression, found by position in the JVM.

    The text before each match is recovered by splitting at the matches, so that spans
    are running sums of lengths.
    """
    return match_spans_simple(seq, f"(?:{pattern})")


def mask_words(df: DataFrame, words: Iterable[str], at_start: bool = False, seq: str = "seq") -> DataFrame:
    """Marks words: literal prefixes, or matches of regular expressions anywhere."""
    for word in words:
        if at_start:
            spans = F.when(F.col(seq).startswith(word), F.array(_segment(F.lit(0), F.lit(len(word) - 1)))).otherwise(_nothing())
        else:
            spans = match_spans(F.col(seq), word)
        df = _add(df, "mask", spans)
    return df


def mask_homopolymers(df: DataFrame, bases: str = "AT", least: int = 10, seq: str = "seq") -> DataFrame:
    """Marks runs of at least so many equal bases (poly-A and poly-T tracks)."""
    for b in bases:
        df = _add(df, "mask", match_spans(F.col(seq), f"(?i:{b}{{{least},}})"))
    return df


def trim_n_ends(df: DataFrame, above_percent: float = 2.0, window: int = 50, least: int = 80, seq: str = "seq", into: str = "quality_trim") -> DataFrame:
    """Marks ends that are rich in N; short reads are dropped.

    An end is cut back to the first window whose share of N is at most the limit.
    """
    bad = F.transform(S.letters(F.upper(seq)), lambda c: F.when(c == "N", 100).otherwise(0))
    good = F.transform(window_means(bad, window // 2), lambda x: x <= above_percent)
    ends = let(good, lambda g: F.struct(F.array_position(g, True).cast("int").alias("a"), F.array_position(F.reverse(g), True).cast("int").alias("b")))
    out = keep(df.where(F.length(seq) >= least), ends, "_t", lambda t: t["a"] > 0)
    n = F.length(seq)
    return _add(out, into, F.array(_segment(F.lit(0), F.col("_t.a") - 2), _segment(n - F.col("_t.b") + 1, n - 1))).drop("_t")


def low_complexity(texts: list[str], window: int = 64, level: float = 20.0) -> list[list[tuple[int, int]]]:
    """Symmetric DUST: of each text the joined perfect intervals, as (first, last) places.

    The score of an interval of n triplets is 10 * (pairs of equal triplets) / (n - 1).  It is perfect if its
    score is above ``level`` and no part of it scores more; intervals have ``window`` letters at most.  Triplets with other letters than
    A, C, G and T (in either case) belong to no interval.
    """
    code = np.full(256, -1, np.int64)
    for k, pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
        code[[ord(c) for c in pair]] = k
    out = []
    for text in texts:
        letters = code[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
        n = len(letters) - 2
        if n < 2:
            out.append([])
            continue
        t = letters[:-2] * 16 + letters[1:-1] * 4 + letters[2:]
        known = (letters[:-2] >= 0) & (letters[1:-1] >= 0) & (letters[2:] >= 0)
        # By number of triplets: pairs of equal ones (those of the last two lengths), whether all are known, and the best score of a part.
        shorter, pairs = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
        sound, best = known.copy(), np.zeros(n)
        marks = np.zeros(len(text) + 1, np.int64)
        for k in range(2, min(window - 2, n) + 1):
            d = k - 1
            now = pairs[:-1] + pairs[1:] - shorter[1:-1] + (t[:-d] == t[d:])
            shorter, pairs = pairs, now
            sound = sound[:-1] & known[d:]
            score = np.where(sound, 10.0 * pairs / d, 0.0)
            inner = np.maximum(best[:-1], best[1:])
            perfect = np.flatnonzero((score > level) & (score >= inner))
            np.add.at(marks, perfect, 1)
            np.add.at(marks, perfect + k + 2, -1)
            best = np.maximum(score, inner)
        low = np.diff(np.concatenate(([0], (np.cumsum(marks) > 0).astype(np.int8), [0])))
        out.append(list(zip(np.flatnonzero(low == 1).tolist(), (np.flatnonzero(low == -1) - 1).tolist())))
    return out


def mask_low_complexity(df: DataFrame, window: int = 64, threshold: float = 20.0, seq: str = "seq") -> DataFrame:
    """Marks the parts of a sequence whose triplets repeat, by symmetric DUST (``low_complexity``)."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def dust(texts: pd.Series) -> pd.Series:
        found = low_complexity(texts.fillna("").tolist(), window, threshold)
        return pd.Series([[{"start": a, "end": b} for a, b in x] for x in found])

    return _add(df, "mask", dust(F.col(seq)))


def remove_short_adaptors(df: DataFrame, words: tuple[str, ...] | list[str], seq: str = "seq", quality: str = "qual") -> DataFrame:
    """Keeps the longest part without any of the words on either strand; reads without one are dropped."""
    spans = _nothing()
    n = F.length(seq)
    for word in words:
        fwd = match_spans(F.col(seq), f"(?i:{word})")
        rev = F.transform(match_spans(S.reverse_complement(F.col(seq)), f"(?i:{word})"), lambda s: _segment(n - s["end"] - 1, n - s["start"] - 1))
        spans = F.concat(spans, fwd, rev)
    if not words:
        return df
    return trim_and_mask(_add(df, "vector_trim", spans), mask=False, seq=seq, quality=quality)


def trim_errors(df: DataFrame, most_error: float = 0.025, window: int = 10, window_error: float = 0.08, least: int = 30, seq: str = "seq", quality: str = "qual") -> DataFrame:
    """Marks the ends around the part of a read with few expected errors; reads without such a part of ``least`` bases are dropped.

    A position is good where the mean error probability (10^(-q/10)) of the ``window``
    around it is at most ``window_error``; the longest good run is then kept, if its own mean
    is at most ``most_error``.  Reads without qualities pass unmarked.
    """
    q = F.col(quality)
    errors = F.transform(q, lambda x: F.pow(F.lit(10.0), -x / 10.0))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("from"), F.lit(0).alias("best"), F.lit(0).alias("n"))

    def step(acc: Column, good: Column) -> Column:
        size = acc["i"] - acc["from"] + 1
        better = good & (size > acc["n"])
        return F.struct((acc["i"] + 1).alias("i"), F.when(good, acc["from"]).otherwise(acc["i"] + 1).alias("from"), F.when(better, acc["from"]).otherwise(acc["best"]).alias("best"), F.when(better, size).otherwise(acc["n"]).alias("n"))

    def run(e: Column) -> Column:
        best = F.aggregate(F.transform(window_means_of(e, window // 2), lambda m: m <= window_error), zero, step)
        mean = lambda b: F.aggregate(F.slice(e, b["best"] + 1, b["n"]), F.lit(0.0), lambda a, x: a + x) / b["n"]
        return let(best, lambda b: F.when((b["n"] >= least) & (mean(b) <= most_error), F.struct(b["best"].alias("a"), (b["best"] + b["n"] - 1).alias("b"))))

    known = F.coalesce(F.size(q) > 0, F.lit(False))
    found = F.struct(known.alias("known"), F.when(known, let(errors, run)).alias("part"))
    out = keep(df, found, "_t", lambda t: ~t["known"] | t["part"].isNotNull())
    parts = F.when(F.col("_t.known"), F.array(_segment(F.lit(0), F.col("_t.part.a") - 1), _segment(F.col("_t.part.b") + 1, F.length(seq) - 1))).otherwise(_nothing())
    return _add(out, "quality_trim", parts).drop("_t")


def window_means_of(values: Column, half: int) -> Column:
    """Means of doubles over ``half`` neighbours on each side, cut at the ends."""

    def at(v: Column, i: Column) -> Column:
        lo = F.greatest(i - half, F.lit(0))
        return let(F.slice(v, lo + 1, i + half + 1 - lo), lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / F.size(x))

    return let(values, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: at(v, i)))


def double_encoded(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.withColumn(seq, S.double_encode(F.col(seq)))


def similar_only(df: DataFrame, hits: DataFrame | None, name: str = "name", similarity: float = 96, percent: float = 60, reverse: bool = False) -> DataFrame:
    """Reads that are similar to a subject (or, reversed, to none): parts of at least ``similarity`` that cover so many percent of the subject."""
    if hits is None:
        return df
    from strandline.operators import hits as H

    good = H.min_length(H.score_threshold(hits, "similarity", least=similarity), percent=percent, on_query=False)
    return H.with_hits(df, good, name, reverse)


def joined_reads(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Struct columns ``a`` and ``b`` (name, seq, qual) as one read: names joined by +, qualities where both have them."""
    return df.select("*", F.concat(F.col(f"{a}.name"), F.lit("+"), F.col(f"{b}.name")).alias("name"), F.concat(f"{a}.seq", f"{b}.seq").alias("seq"), F.concat(f"{a}.qual", f"{b}.qual").alias("qual")).drop(a, b)


def trim_by_hits(df: DataFrame, hits: DataFrame | None, name: str = "name", query: str = "query", start: str = "q_start", end: str = "q_end", extend: int = 5, subject_start: str = "s_start", subject_end: str = "s_end", subject_length: str = "s_len", seq: str = "seq") -> DataFrame:
    """Marks the parts of reads that hit a vector or adaptor, reaching up to ``extend`` bases to the subject's ends."""
    if hits is None:
        return df
    left = F.when(F.col(subject_start) < extend, F.col(subject_start)).otherwise(0)
    right = F.when(F.col(subject_length) - 1 - F.col(subject_end) < extend, F.col(subject_length) - 1 - F.col(subject_end)).otherwise(0)
    spans = hits.select(F.col(query).alias(name), _segment(F.greatest(F.col(start) - left, F.lit(0)), F.col(end) + right).alias("_s")).groupBy(name).agg(F.collect_list("_s").alias("_spans"))
    out = df.join(spans, name, "left")
    clipped = F.transform(F.coalesce("_spans", _nothing()), lambda s: _segment(s["start"], F.least(s["end"], F.length(seq) - 1)))
    return _add(out, "vector_trim", clipped).drop("_spans")


def split_masked(df: DataFrame, min_length: int, name: str = "name", seq: str = "seq") -> DataFrame:
    """Upper-case runs of at least ``min_length`` as reads of their own, numbered before short ones go.

    A read without a lower-case letter keeps its name; a fully masked read stays whole.
    """
    runs = F.regexp_extract_all(seq, F.lit("([A-Z]+)"))
    whole = (~F.col(seq).rlike("[a-z]")) | ~F.col(seq).rlike("[A-Z]")
    parts = F.when(whole, F.array(F.struct(F.col(name).alias("n"), F.col(seq).alias("s")))).otherwise(
        F.filter(F.transform(runs, lambda r, i: F.struct(F.concat(F.col(name), F.lit("_"), (i + 1).cast("string")).alias("n"), r.alias("s"))), lambda p: F.length(p["s"]) >= min_length)
    )
    rest = [c for c in df.columns if c not in (name, seq, "qual")]
    return df.select(*rest, F.explode(parts).alias("_p")).select(*rest, F.col("_p.n").alias(name), F.col("_p.s").alias(seq))


def reverse_complement(df: DataFrame, name: str = "name", seq: str = "seq", quality: str = "qual") -> DataFrame:
    out = df.withColumn(seq, S.reverse_complement(F.col(seq))).withColumn(name, F.concat(name, F.lit("_complemented")))
    return out.withColumn(quality, F.reverse(quality)) if quality in df.columns else out


def longer_than(df: DataFrame, length: int, count_masked: bool = True, seq: str = "seq") -> DataFrame:
    """Strictly longer reads; unmasked length counts upper-case A, C, G and T only."""
    n = F.length(seq) if count_masked else S.unmasked_length(F.col(seq))
    return df.where(n > length)


def solid_quality(df: DataFrame, length: int = 10, threshold: float = 15.0, quality: str = "qual") -> DataFrame:
    """Reads with fewer than two zero qualities whose first ``length + 1`` sum to ``threshold`` times ``length``."""
    zeros = F.size(F.filter(quality, lambda q: q == 0))
    total = F.aggregate(F.slice(quality, 1, length + 1), F.lit(0).cast("bigint"), lambda a, q: a + q)
    return df.where((zeros < 2) & (total / length >= threshold))


def check_lengths(df: DataFrame, least: int, most: int, seq: str = "seq") -> None:
    """Raises where any sequence is out of range."""
    r = df.agg(F.min(F.length(seq)), F.max(F.length(seq))).first()
    if r[0] is not None and (r[0] < least or r[1] > most):
        raise ValueError(f"lengths from {r[0]} to {r[1]}; {least} to {most} are allowed")


def with_default_quality(df: DataFrame, value: int = 25, seq: str = "seq", quality: str = "qual") -> DataFrame:
    filled = F.array_repeat(F.lit(value), F.length(seq))
    return df.withColumn(quality, F.coalesce(F.col(quality), filled) if quality in df.columns else filled)


def sample(df: DataFrame, n: int, seed: int = 0, key: str = "name") -> DataFrame:
    """Exactly n rows (all, if fewer), without replacement: those with the smallest digests of seed and ``key``, however the rows are partitioned."""
    return df.withColumn("_r", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))).orderBy("_r", key).limit(n).drop("_r")


def nucleotide_frequencies(df: DataFrame, positions: int = 30, seq: str = "seq") -> DataFrame:
    """Share of A, C, G and T at each of the first positions, among those four."""
    at = df.select(F.posexplode(S.letters(S.upper(F.substring(seq, 1, positions)))).alias("pos", "base")).where(F.col("base").isin("A", "C", "G", "T"))
    out = at.groupBy("pos").agg(*[F.sum((F.col("base") == b).cast("int")).alias(b) for b in "ACGT"])
    total = sum((F.col(b) for b in "ACGT"), F.lit(0))
    return out.select("pos", *[(F.col(b) / total).alias(f"freq_{b.lower()}") for b in "ACGT"])


def codon_usage(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Number and share of each whole codon in plain DNA of whole codons."""
    ok = df.where(S.is_dna(F.col(seq)) & (F.length(seq) >= 3))
    codons = F.transform(F.sequence(F.lit(0), F.floor(F.length(seq) / 3).cast("int") - 1), lambda i: F.upper(F.substring(F.col(seq), i * 3 + 1, F.lit(3))))
    out = ok.select(F.explode(codons).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))
    total = out.agg(F.sum("n").alias("total"))
    return out.join(F.broadcast(total)).select("codon", "n", S.translate(F.col("codon")).alias("amino_acid"), (1000 * F.col("n") / F.col("total")).alias("per_thousand"))


def microsatellites(df: DataFrame, name: str = "name", seq: str = "seq", min_unit: int = 2, max_unit: int = 4, min_length: int = 20) -> DataFrame:
    """Perfect tandem repeats of short units: start, end, unit; single-base repeats don't count."""
    pattern = f"(?i:([ACGT]{{{min_unit},{max_unit}}}?)\\1{{{max(1, min_length // max_unit - 1)},}})"
    spans = match_spans_simple(F.col(seq), pattern)
    out = df.select(name, seq, F.explode(spans).alias("s")).select(name, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.upper(F.substring(F.col(seq), F.col("s.start") + 1, F.col("s.end") - F.col("s.start") + 1)).alias("repeat"))
    out = out.withColumn("unit", F.regexp_extract("repeat", f"^([ACGT]{{{min_unit},{max_unit}}}?)\\1+$", 1)).withColumn("length", F.length("repeat"))
    return out.where((F.col("length") >= min_length) & (F.length("unit") > 0) & ~F.col("unit").rlike("^(.)\\1+$")).select(name, "start", "end", "unit", "length")


def match_spans_simple(seq: Column, pattern: str) -> Column:
    """Like ``match_spans`` for patterns with groups of their own."""
    found = F.regexp_extract_all(seq, F.lit(pattern), 0)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), _nothing().alias("out"))

    def spans(between: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            start = acc["at"] + F.length(F.get(between, acc["k"]))
            return F.struct((start + F.length(m)).alias("at"), (acc["k"] + 1).alias("k"), F.concat(acc["out"], F.array(_segment(start, start + F.length(m) - 1))).alias("out"))

        return F.aggregate(found, zero, step, lambda acc: acc["out"])

    return let(F.split(seq, pattern, -1), spans)


def longest_orf(df: DataFrame, name: str = "name", seq: str = "seq", least: int = 30) -> DataFrame:
    """The longest open reading frame of the six: strand, start, end (on that strand), dna, pep.

    A frame runs from a start codon to the next stop, or to the sequence's end.
    """
    strands = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.upper(seq).alias("s")), F.struct(F.lit("-").alias("strand"), F.upper(S.reverse_complement(F.col(seq))).alias("s")))).alias("_t")
    rows = df.select(name, strands).select(name, "_t.strand", "_t.s", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("frame"))
    rows = rows.withColumn("pep", S.translate(F.substring(F.col("s"), F.col("frame") + 1, F.length("s"))))
    spans = match_spans_simple(F.col("pep"), "M[^*]*")
    rows = rows.select(name, "strand", "s", "frame", "pep", F.explode(spans).alias("o"))
    start = F.col("frame") + 3 * F.col("o.start")
    end = F.col("frame") + 3 * F.col("o.end") + 2
    rows = rows.withColumn("start", start).withColumn("end", end).where(end - start + 1 >= least)
    rows = rows.withColumn("dna", F.substring(F.col("s"), start + 1, end - start + 1)).withColumn("pep", F.substring(F.col("pep"), F.col("o.start") + 1, F.col("o.end") - F.col("o.start") + 1))
    top = F.max(F.struct((F.col("end") - F.col("start")).alias("n"), F.col("strand"), (-F.col("start")).alias("s"), "end", "dna", "pep")).alias("t")
    return rows.groupBy(name).agg(top).select(name, "t.strand", (-F.col("t.s")).alias("start"), "t.end", "t.dna", "t.pep")
