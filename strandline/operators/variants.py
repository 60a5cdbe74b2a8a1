"""Variant analytics on long tables.

``counts`` has one row per variant, allele, kind and read group, with a number of reads
n; ``snvs`` one row per variant with ref, start and end.  Filters don't drop rows: each
adds a column that is true where the variant fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import scans

# The codes of allele and variant kinds.
KINDS = {"SNP": 0, "INSERTION": 1, "DELETION": 2, "INVARIANT": 3, "INDEL": 4, "COMPLEX": 5, "TRANSITION": 6, "TRANSVERSION": 7, "UNKNOWN": 8, "VARIANT": 9}


def _of_groups(counts: DataFrame, group: str | None, groups: list | None) -> Column:
    return F.col("n") if groups is None else F.when(F.col(group).isin(groups), F.col("n")).otherwise(0)


def allele_totals(counts: DataFrame, group: str | None = None, groups: list | None = None, snv: str = "snv_id") -> DataFrame:
    """Reads of each allele, in the given groups only; alleles without reads there stay with 0."""
    return counts.groupBy(snv, "allele").agg(F.sum(_of_groups(counts, group, groups)).alias("n"))


def measures(counts: DataFrame, group: str | None = None, groups: list | None = None, ploidy: int = 2, snv: str = "snv_id") -> DataFrame:
    """Major allele frequency, polymorphism content and heterozygosity, in one pass over allele totals.

    Frequencies are null without reads; the polymorphism content is 0 for one allele and
    null below four reads; heterozygosity is 0 for one allele, null without reads, and
    corrected for few individuals below 50.  The second sum of the content runs over
    pairs of alleles once, as sums and sums of squares give it.
    """
    t = allele_totals(counts, group, groups, snv)
    n = F.col("n").cast("double")
    pairs = n * (n - 1)
    s = t.groupBy(snv).agg(
        F.count("*").alias("alleles"), F.sum("n").alias("reads"), F.max("n").alias("major"), F.sum(n * n).alias("_sq"), F.sum(pairs).alias("_p"), F.sum(pairs * pairs).alias("_p2"),
    )
    r = F.col("reads").cast("double")
    maf = F.when(r > 0, F.col("major") / r)
    first = F.col("_p") / (r * (r - 1))
    second = (F.col("_p") * F.col("_p") - F.col("_p2")) / 2 / (r * (r - 1) * (r - 2) * (r - 3))
    pic = F.when(F.col("alleles") == 1, F.lit(0.0)).when(r >= 4, 1 - first - second)
    rest = 1 - F.col("_sq") / (r * r)
    few = F.when(2 * r > 1, 2 * r / (2 * r - 1) * rest)
    many = F.when(r > 1, r / (r - 1) * rest)
    het = F.when(F.col("alleles") == 1, F.lit(0.0)).when(r > 0, F.when(r / ploidy < 50, few).otherwise(many))
    return s.select(snv, "alleles", "reads", maf.alias("maf"), pic.alias("pic"), het.alias("heterozygosity"))


def kinds(alleles: DataFrame, detailed: bool = False, snv: str = "snv_id") -> DataFrame:
    """Kind of each variant from its alleles (allele, kind, ref_allele)."""
    other = F.col("kind") != "INVARIANT"
    g = alleles.groupBy(snv).agg(
        F.first("ref_allele").alias("ref"), F.sum(F.when(other, 1).otherwise(0)).alias("k"), F.max(F.when(other, F.length("allele"))).alias("hi"), F.min(F.when(other, F.length("allele"))).alias("lo"), F.max(F.when(other, F.col("allele"))).alias("alt"),
    )
    n = F.length("ref")
    purine = lambda c: F.upper(c).isin("A", "G")
    base = lambda c: F.upper(c).isin("A", "C", "G", "T")
    snp = F.lit("SNP")
    if detailed:
        snp = F.when((F.col("k") > 1) | ~base(F.col("alt")) | ~base(F.col("ref")), "UNKNOWN").when(purine(F.col("alt")) == purine(F.col("ref")), "TRANSITION").otherwise("TRANSVERSION")
    kind = F.when(F.col("k") == 0, "INVARIANT").when((n == 1) & (F.col("hi") == 1) & (F.col("lo") == 1), snp).when(F.col("k") > 1, "COMPLEX")
    kind = kind.when(n < F.col("hi"), "INSERTION").when(n > F.col("hi"), "DELETION").otherwise("COMPLEX")
    return g.select(snv, kind.alias("kind"))


def union_of_kinds(kinds_: Column) -> Column:
    """One kind for an array of kinds; INVARIANT is neutral, SNP with COMPLEX is COMPLEX, other mixtures are INDEL."""
    k = F.array_distinct(F.filter(kinds_, lambda x: x != "INVARIANT"))
    mixed = F.array_contains(k, "SNP") | F.array_contains(k, "COMPLEX")
    return F.when(F.size(k) == 0, "INVARIANT").when(F.size(k) == 1, F.get(k, F.lit(0))).when(mixed, "COMPLEX").otherwise("INDEL")


def allele_quality(qualities: Column) -> Column:
    """The best quality, and a quarter of each of the next two distinct ones.

    Where there are fewer distinct qualities, the second and third stand as they were given.
    """
    best = F.sort_array(F.array_distinct(qualities), asc=False)
    at = lambda k: F.coalesce(F.get(best, F.lit(k)), F.get(qualities, F.lit(k)), F.lit(0))
    return at(0) + (at(1) + at(2)) / 4.0


def major_allele(counts: DataFrame, snv: str = "snv_id") -> DataFrame:
    """The allele with most reads of each variant, the smaller name on a tie."""
    totals = allele_totals(counts, snv=snv)
    return totals.groupBy(snv).agg(F.min(F.struct((-F.col("n")).alias("k"), "allele"))["allele"].alias("major"))


def alleles_by_reads(counts: DataFrame, snv: str = "snv_id") -> DataFrame:
    """Alleles of each variant as an array, most reads first, then by name."""
    totals = allele_totals(counts, snv=snv)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "allele")))
    return totals.groupBy(snv).agg(F.transform(ordered, lambda x: x["allele"]).alias("alleles"))


def summarised(reads: DataFrame, snv: str = "snv_id") -> tuple[DataFrame, DataFrame]:
    """(reads of each allele and group, root mean squares of base and mapping qualities) from rows of one read's allele each."""
    counts = reads.groupBy(snv, "allele", "kind", "rg").agg(F.count("*").alias("n"))
    rms = lambda c: F.sqrt(F.avg(F.col(c).cast("double") * F.col(c)))
    return counts, reads.groupBy(snv).agg(rms("q").alias("quality"), rms("mapq").alias("mapping_quality"))


def genotype_counts(counts: DataFrame, order: DataFrame, group: str = "rg", snv: str = "snv_id") -> DataFrame:
    """Reads and groups of every allele by its number: 0 the reference, then the others as ``order`` (snv, allele, number) gives them."""
    got = counts.where("n > 0").join(order, [snv, "allele"], "right")
    return got.groupBy(snv, "number").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reads"), F.countDistinct(group).alias("groups"))


def info(counts: DataFrame, order: DataFrame, qualities: DataFrame | None = None, enzymes: DataFrame | None = None, group: str = "rg", snv: str = "snv_id") -> DataFrame:
    """The INFO text of each variant: reads (RC) and frequencies (AF) of other alleles, mapping and base quality (MQ, BQ), groups of each allele (GC), genotype polymorphism (GP), enzymes (EZ)."""
    g = genotype_counts(counts, order, group, snv)
    rows = F.array_sort(F.collect_list(F.struct("number", "reads", "groups")))
    out = g.groupBy(snv).agg(rows.alias("g"), F.sum("reads").alias("all"), F.sum("groups").alias("all_groups"))
    text = lambda rows, f: F.array_join(F.transform(rows, f), ",")
    other = F.filter("g", lambda x: x["number"] > 0)
    parts = [
        F.when(F.size(other) > 0, F.concat(F.lit("RC="), text(other, lambda x: x["reads"].cast("string")))),
        F.when((F.size(other) > 0) & (F.col("all") > 0), F.concat(F.lit("AF="), text(other, lambda x: F.format_string("%.1f", x["reads"] / F.col("all"))))),
    ]
    if qualities is not None:
        out = out.join(qualities, snv, "left")
        parts += [F.format_string("MQ=%.2f", F.col("mapping_quality")), F.format_string("BQ=%.2f", F.col("quality"))]
        parts[2:] = [F.when(F.col(c).isNotNull(), p) for c, p in zip(("mapping_quality", "quality"), parts[2:])]
    first = F.coalesce(F.get(F.filter("g", lambda x: x["number"] == 0), F.lit(0))["groups"], F.lit(0))
    parts.append(F.concat(F.lit("GC="), text(F.col("g"), lambda x: x["groups"].cast("string"))))
    parts.append(F.when(F.col("all_groups") > 0, F.format_string("GP=%.2f", 1 - first / F.col("all_groups"))))
    if enzymes is not None:
        out = out.join(enzymes, snv, "left")
        parts.append(F.when(F.size("enzymes") > 0, F.concat(F.lit("EZ="), F.array_join("enzymes", ","))))
    return out.select(snv, F.coalesce(F.nullif(F.concat_ws(";", *parts), F.lit("")), F.lit(".")).alias("info"))


def _group_variability(counts: DataFrame, group: str, groups: list, in_union: bool, reference_free: bool, maf: float | None, min_reads: int | None, min_reads_per_allele: int | None, snv: str) -> DataFrame:
    rows = counts.where(F.col(group).isin(groups))
    if min_reads_per_allele:
        rows = rows.where(F.col("n") >= min_reads_per_allele)
    unit = F.lit(None).cast("string") if in_union else F.col(group).cast("string")
    a = rows.withColumn("_g", unit).groupBy(snv, "_g", "allele", "kind").agg(F.sum("n").alias("n"))
    g = a.groupBy(snv, "_g").agg(F.count("*").alias("k"), F.max((F.col("kind") == "INVARIANT").cast("int")).alias("ref"), F.max("n").alias("top"), F.sum("n").alias("all"))
    one = (F.col("k") == 1) & (F.lit(reference_free) | (F.col("ref") == 1))
    bad = one
    if maf is not None:
        bad = bad | (F.col("top") / F.col("all") > maf)
    if min_reads is not None:
        bad = bad | (F.col("all") < min_reads)
    return g.select(snv, (~bad).alias("variable"))


def variable_in(snvs: DataFrame, counts: DataFrame, group: str, groups: list, in_union: bool = True, in_all: bool = True, reference_free: bool = True, maf: float | None = None, min_reads: int | None = None, min_reads_per_allele: int | None = None, snv: str = "snv_id", out: str = "variable") -> DataFrame:
    """Whether each variant varies in all (or any) of the groups; false without data there."""
    g = _group_variability(counts, group, groups, in_union, reference_free, maf, min_reads, min_reads_per_allele, snv)
    v = g.groupBy(snv).agg((F.bool_and if in_all else F.bool_or)("variable").alias(out))
    return snvs.join(v, snv, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def invariant_in(snvs: DataFrame, counts: DataFrame, group: str, groups: list, in_union: bool = True, in_all: bool = True, reference_free: bool = True, maf: float | None = None, min_reads: int | None = None, snv: str = "snv_id", out: str = "invariant") -> DataFrame:
    """Whether each variant doesn't vary in the groups; without data, only if the reference counts."""
    g = _group_variability(counts, group, groups, in_union, reference_free, maf, min_reads, None, snv)
    v = g.groupBy(snv).agg((F.bool_and if in_all else F.bool_or)(~F.col("variable")).alias(out))
    return snvs.join(v, snv, "left").withColumn(out, F.coalesce(out, F.lit(not reference_free)))


# Filters: each adds a column, true where the variant fails.


def ref_not_in_list(snvs: DataFrame, names: list, ref: str = "ref", invert: bool = False, out: str = "ref_not_in_list") -> DataFrame:
    found = F.col(ref).isin(names)
    return snvs.withColumn(out, ~found if invert else found)


def neighbours(snvs: DataFrame, distance: float, ref: str = "ref", start: str = "start", where: Column | None = None, out: str = "near") -> DataFrame:
    """Variants at other positions within ``distance``, inclusive; optionally only those that meet ``where``.

    Variants are counted by position first, so a position that many share is one row of
    the window.
    """
    one = F.lit(1) if where is None else where.cast("int")
    at = snvs.groupBy(ref, start).agg(F.sum(one).alias("_n"))
    w = Window.partitionBy(ref).orderBy(start).rangeBetween(-int(distance), int(distance))
    at = at.withColumn(out, (F.sum("_n").over(w) - F.col("_n")).cast("long")).drop("_n")
    return snvs.join(at, [ref, start])


def close_to_snv(snvs: DataFrame, distance: int, where: Column | None = None, ref: str = "ref", start: str = "start", out: str = "close_to_snv") -> DataFrame:
    return neighbours(snvs, distance, ref, start, where, "_near").withColumn(out, F.coalesce(F.col("_near") > 0, F.lit(False))).drop("_near")


def high_variable_region(snvs: DataFrame, most: float, window: int = 0, length: str = "ref_len", ref: str = "ref", start: str = "start", out: str = "high_variable") -> DataFrame:
    """Variants per base above ``most``, over the whole reference, or of the others in a window."""
    if window:
        return neighbours(snvs, window / 2, ref, start, None, "_near").withColumn(out, F.col("_near") / window > most).drop("_near")
    total = snvs.groupBy(ref).agg(F.count("*").alias("_n"))
    return snvs.join(total, ref).withColumn(out, F.col("_n") / F.col(length) > most).drop("_n")


def close_to_limit(snvs: DataFrame, distance: int, length: str = "ref_len", start: str = "start", out: str = "close_to_limit") -> DataFrame:
    return snvs.withColumn(out, (F.col(start) < distance) | (F.col(start) + distance > F.col(length)))


def close_to_intron(snvs: DataFrame, introns: DataFrame, distance: int, ref: str = "ref", start: str = "start", position: str = "position", out: str = "close_to_intron") -> DataFrame:
    """Any intron strictly nearer than ``distance``: a band join over bins of that width."""
    d = max(1, distance)
    b = introns.select(F.col(ref).alias("_ref"), F.col(position).alias("_p"), F.explode(F.sequence(F.floor(F.col(position) / d) - 1, F.floor(F.col(position) / d) + 1)).alias("_b"))
    at = snvs.select(ref, start).distinct()
    near = at.join(b, (F.col(ref) == F.col("_ref")) & (F.floor(F.col(start) / d) == F.col("_b"))).where(F.abs(F.col(start) - F.col("_p")) < distance).select(ref, start).distinct()
    return snvs.join(near.withColumn(out, F.lit(True)), [ref, start], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def max_maf(snvs: DataFrame, counts: DataFrame, frequency: float, group: str | None = None, groups: list | None = None, snv: str = "snv_id", out: str = "maf_filter") -> DataFrame:
    """Major allele frequency above the limit, or unknown."""
    m = measures(counts, group, groups, snv=snv).select(snv, "maf")
    return snvs.join(m, snv, "left").withColumn(out, F.coalesce(F.col("maf") > frequency, F.lit(True))).drop("maf")


def by_kind(snvs: DataFrame, alleles: DataFrame, kind: str, detailed: bool = False, snv: str = "snv_id", out: str = "by_kind") -> DataFrame:
    k = kinds(alleles, detailed, snv).withColumnRenamed("kind", "_k")
    return snvs.join(k, snv, "left").withColumn(out, F.coalesce(F.col("_k") != kind, F.lit(True))).drop("_k")


def min_groups(snvs: DataFrame, counts: DataFrame, least: int, group: str, snv: str = "snv_id", out: str = "min_groups") -> DataFrame:
    n = counts.groupBy(snv).agg(F.countDistinct(group).alias("_n"))
    return snvs.join(n, snv, "left").withColumn(out, F.coalesce("_n", F.lit(0)) < least).drop("_n")


def in_segment(snvs: DataFrame, segments: DataFrame, edge: int = 0, ref: str = "ref", start: str = "start", end: str = "end", seg_start: str = "seg_start", seg_end: str = "seg_end", width: int = 10_000, out: str = "in_segment") -> DataFrame:
    """Outside of all segments: a variant is inside one that begins at or before it and ends at least ``edge`` after it.

    A segment's beginning is shrunk by the edge for the variant's end only; segments of
    a reference are disjoint.
    """
    bins = F.explode(F.sequence(F.floor(F.col(seg_start) / width), F.floor(F.col(seg_end) / width))).alias("_b")
    s = segments.select(F.col(ref).alias("_ref"), F.col(seg_start).alias("_s"), F.col(seg_end).alias("_e"), bins)
    at = snvs.select(ref, start, end).distinct()
    last = segments.groupBy(F.col(ref).alias("_ref2")).agg(F.max(seg_end).alias("_last"))
    hit = at.join(s, (F.col(ref) == F.col("_ref")) & (F.floor(F.col(start) / width) == F.col("_b")))
    hit = hit.where((F.col(end) <= F.col("_e") - edge) & (F.col(start) >= F.col("_s")) & (F.col(end) >= F.col("_s") + edge)).select(ref, start, end).distinct()
    hit = hit.join(last, F.col(ref) == F.col("_ref2")).where(F.col(end) <= F.col("_last") - edge).select(ref, start, end)
    return snvs.join(hit.withColumn("_in", F.lit(True)), [ref, start, end], "left").withColumn(out, F.col("_in").isNull()).drop("_in")


def moving_profile(snvs: DataFrame, value: str, width: int, step: int, least: int = 3, ref: str = "ref", start: str = "start") -> DataFrame:
    """Means over windows of odd ``width`` centred every ``step``, where at least three values fall in."""
    half = width // 2
    first = F.greatest(F.ceil((F.col(start) - half) / step), F.lit(0))
    centres = F.sequence(first, F.greatest(F.floor((F.col(start) + half) / step), first))
    rows = snvs.select(ref, start, value, F.explode(centres).alias("_c")).where(F.abs(F.col("_c") * step - F.col(start)) <= half)
    out = rows.groupBy(ref, (F.col("_c") * step).alias("centre")).agg(F.count("*").alias("values"), F.avg(value).alias("mean"))
    return out.where(F.col("values") >= least)


def blocks(snvs: DataFrame, ref: str = "ref", start: str = "start", end: str = "end", width: int = scans.WIDTH) -> DataFrame:
    """Runs of overlapping variants, half open: block number, start, end and members; by two-level scans."""
    found = scans.islands(snvs.select(ref, start, end, F.lit(1).alias("members")), [ref], start, end, -1, F.sum("members").alias("members"), width=width)
    return scans.running(found, [ref], start, F.lit(1), out="block", width=width).select(ref, "block", start, end, "members")


def enzymes_that_tell(alleles: DataFrame, enzymes: DataFrame, snv: str = "snv_id", seq: str = "allele_seq") -> DataFrame:
    """Restriction enzymes (enzyme, pattern) that cut some but not all alleles of a variant.

    ``enzymes`` is a small literal table; it is broadcast, and only it multiplies rows.
    """
    cut = alleles.join(F.broadcast(enzymes), F.expr(f"{seq} RLIKE concat('(?i)', pattern)"))
    n = alleles.groupBy(snv).agg(F.countDistinct(seq).alias("_n"))
    some = cut.groupBy(snv, "enzyme").agg(F.countDistinct(seq).alias("_k")).join(n, snv).where("_k < _n")
    return some.groupBy(snv).agg(F.array_sort(F.collect_set("enzyme")).alias("enzymes"))


def not_unique(snvs: DataFrame, hits: DataFrame, introns: DataFrame | None = None, snv: str = "snv_id", similarity: float = 90, residues: int = 20, out: str = "uniq_contiguous") -> DataFrame:
    """Variants whose surroundings hit more than one subject, or one across an intron.

    ``hits`` has the aligned parts of each variant's window (query = variant); only parts of at least
    ``similarity`` in matches of ``residues`` bases count.  Without any hit a variant passes.
    """
    from strandline.operators import hits as H

    good = H.min_length(H.score_threshold(hits, "similarity", least=similarity), residues=residues)
    n = good.groupBy(F.col("query").alias(snv)).agg(F.countDistinct("subject").alias("_n"))
    found = snvs.join(n, snv, "left")
    bad = F.coalesce(F.col("_n") > 1, F.lit(False))
    if introns is not None:
        found = found.join(introns.select(F.col("query").alias(snv), F.lit(True).alias("_i")).distinct(), snv, "left")
        bad = bad | (F.col("_n").isNotNull() & F.coalesce("_i", F.lit(False)))
    return found.withColumn(out, bad).drop("_n", "_i")


def measure_distribution(snvs: DataFrame, measure: str, bins: int = 20) -> DataFrame:
    """Histogram of pic, heterozygosity or maf over all variants; unknown ones, and a maf of 0, are left out."""
    from strandline.operators import statistics

    rows = snvs.where(F.col(measure).isNotNull() & ((F.lit(measure) != "maf") | (F.col(measure) != 0)))
    return statistics.histogram(rows, measure, bins)
