"""Annotation: positions in reading frames, coordinate systems, statistics of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import sequence as S


def orf_location(features: DataFrame, orfs: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``location``: orf, utr5, utr3, or unknown without exactly one frame; a reverse frame flips the ends."""
    one = orfs.groupBy(name).agg(F.count("*").alias("_n"), F.first("start").alias("_s"), F.first("end").alias("_e"), F.first("strand").alias("_d"))
    out = features.join(one, name, "left")
    before, after = F.col("start") < F.col("_s"), F.col("start") > F.col("_e")
    back = F.col("_d") == "-"
    where = F.when(F.col("_n").isNull() | (F.col("_n") != 1), "unknown").when(before, F.when(back, "utr3").otherwise("utr5")).when(after, F.when(back, "utr5").otherwise("utr3")).otherwise("orf")
    return out.withColumn("location", where).drop("_n", "_s", "_e", "_d")


def codon_location(features: DataFrame, orfs: DataFrame, name: str = "name") -> DataFrame:
    """Codon number and place (1 to 3) of features in their forward frame; null outside."""
    o = orfs.select(name, F.col("start").alias("_s"), F.col("end").alias("_e"))
    out = features.join(o, name, "left")
    inside = F.col("start").between(F.col("_s"), F.col("_e"))
    offset = F.col("start") - F.col("_s")
    return out.withColumn("codon", F.when(inside, F.floor(offset / 3))).withColumn("frame", F.when(inside, F.pmod(offset, F.lit(3)) + 1)).drop("_s", "_e")


def protein_change(snvs: DataFrame, orfs: DataFrame, name: str = "name") -> DataFrame:
    """Effect of single-base alleles (name, start, allele) on the forward frame (name, start, end, dna).

    synonym, substitution, breakage (a stop), indel for alleles of another length, utr
    outside, null where bases are unknown.
    """
    o = orfs.select(name, F.col("start").alias("_s"), F.col("end").alias("_e"), "dna")
    out = snvs.join(o, name, "left")
    offset = F.col("start") - F.col("_s")
    first = F.floor(offset / 3).cast("int") * 3
    codon = F.substring(F.col("dna"), first + 1, F.lit(3))
    k = F.pmod(offset, F.lit(3)).cast("int")
    changed = F.concat(F.substring(codon, F.lit(1), k), F.col("allele"), F.substring(codon, k + 2, F.lit(3)))
    old, new = S.translate(codon), S.translate(changed)
    effect = F.when(F.col("_s").isNull(), None).when(~F.col("start").between(F.col("_s"), F.col("_e")), "utr").when((F.length("allele") != 1) | (F.col("allele") == "-"), "indel")
    effect = effect.when(old == new, "synonym").when((new == "*") | (old == "*"), "breakage").when((old == "X") | (new == "X"), None).otherwise("substitution")
    inside = (F.col("start").between(F.col("_s"), F.col("_e"))) & (F.length("allele") == 1)
    return out.withColumn("effect", effect).withColumn("ref_aa", F.when(inside, old)).withColumn("new_aa", F.when(inside, new)).drop("_s", "_e", "dna")


def feature_counts(features: DataFrame, name: str = "name", kind: str = "ftype") -> DataFrame:
    """Features of each kind, and sequences that have one."""
    return features.groupBy(kind).agg(F.count("*").alias("features"), F.countDistinct(name).alias("sequences"))


def cube_counts(features: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by two attributes with all their totals; totals are marked by level."""
    return features.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def go_terms(seqs: DataFrame, terms: DataFrame, name: str = "name") -> DataFrame:
    got = terms.groupBy(name).agg(F.array_sort(F.collect_set("go")).alias("gos"))
    return seqs.join(got, name, "left").withColumn("gos", F.coalesce("gos", F.array().cast("array<string>")))


def add_attribute(gff: DataFrame, lookup: DataFrame, key: str, value: str, attribute: str) -> DataFrame:
    """GFF features with values of a lookup table joined into an attribute (a map of string arrays), as a set union."""
    got = lookup.groupBy(F.col(key).alias("_k")).agg(F.collect_set(value).alias("_v"))
    out = gff.join(got, F.get(F.col("attributes")["ID"], F.lit(0)) == F.col("_k"), "left")
    old = F.coalesce(F.col("attributes")[attribute], F.array().cast("array<string>"))
    merged = F.map_concat(F.map_filter("attributes", lambda k, v: k != attribute), F.create_map(F.lit(attribute), F.array_sort(F.array_union(old, F.col("_v")))))
    return out.withColumn("attributes", F.when(F.col("_v").isNull(), F.col("attributes")).otherwise(merged)).drop("_k", "_v")


def transform_positions(points: DataFrame, fragments: DataFrame, source: str, target: str, width: int = 10_000) -> DataFrame:
    """Positions of one molecule on another: fragments (frag, molecule, start, end), end before start on the reverse strand.

    An interval lookup by bins of the source fragments.
    """
    lo, hi = F.least("start", "end"), F.greatest("start", "end")
    a = fragments.where(F.col("molecule") == source).select("frag", F.col("start").alias("a0"), F.col("end").alias("a1"), lo.alias("_lo"), hi.alias("_hi"))
    b = fragments.where(F.col("molecule") == target).select("frag", F.col("start").alias("b0"), F.col("end").alias("b1"))
    both = a.join(b, "frag").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    out = points.withColumn("_bin", F.floor(F.col("position") / width)).join(both, "_bin").where(F.col("position").between(F.col("_lo"), F.col("_hi")))
    same = (F.col("a1") >= F.col("a0")) == (F.col("b1") >= F.col("b0"))
    offset = F.abs(F.col("position") - F.col("a0"))
    place = F.when(F.col("b1") >= F.col("b0"), F.col("b0") + offset).otherwise(F.col("b0") - offset)
    return out.select(*points.columns, "frag", place.alias("target_position"), F.when(same, "+").otherwise("-").alias("strand"))


def aligned_segments(alignments: DataFrame, name: str = "name", a: str = "a", b: str = "b") -> DataFrame:
    """Gapless blocks of two aligned strings: starts and ends on either sequence."""
    pos = alignments.select(name, F.col(b).alias("_b"), F.posexplode(S.letters(F.col(a))).alias("i", "x"))
    pos = pos.withColumn("y", F.substring(F.col("_b"), F.col("i") + 1, F.lit(1))).drop("_b")
    w = Window.partitionBy(name).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    pos = pos.withColumn("pa", F.sum((F.col("x") != "-").cast("int")).over(w) - 1).withColumn("pb", F.sum((F.col("y") != "-").cast("int")).over(w) - 1)
    both = pos.where("x <> '-' and y <> '-'")
    island = F.col("i") - F.row_number().over(Window.partitionBy(name).orderBy("i"))
    out = both.withColumn("g", island).groupBy(name, "g").agg(F.min("pa").alias("a_start"), F.max("pa").alias("a_end"), F.min("pb").alias("b_start"), F.max("pb").alias("b_end"))
    return out.drop("g")


def without_annotations(seqs: DataFrame, features: DataFrame, kinds: list[str], kind: str = "ftype") -> tuple[DataFrame, DataFrame]:
    """Sequences and features without the named annotations: GOs, orthologs and description of the sequences, filters of variants, or features of a kind.

    Fixed names: GOs, orthologs, description, snv_filters; any other is a kind of features.
    """
    columns = {"GOs": "gos", "orthologs": "orthologs", "description": "description"}
    for k in kinds:
        if k in columns:
            c = columns[k]
            if c in seqs.columns:
                seqs = seqs.withColumn(c, F.lit(None).cast(dict(seqs.dtypes)[c]))
        elif k == "snv_filters":
            if "filters" in features.columns:
                features = features.withColumn("filters", F.lit(None).cast(dict(features.dtypes)["filters"]))
        else:
            features = features.where(F.col(kind) != k)
    return seqs, features


def features_of(gff: DataFrame, types: list[str]) -> DataFrame:
    """GFF rows without the features of other types; comments, directives and sequences stay."""
    return gff.where((F.col("kind") != "feature") | F.col("kind").isNull() | F.col("type").isin(types))


#: Kinds of microsatellites by the length of their unit, from 2 on.
SSR_KINDS = ("dinucleotide", "trinucleotide", "tetranucleotide", "pentanucleotide", "hexanucleotide")


def feature_statistics(features: DataFrame, type_: Column, name: str = "name", location: str = "location") -> DataFrame:
    """One row a type and location with their number, and totals: type, location, n, sequences, level (0 both, 1 type, 3 all).

    Features without a location count in the totals alone.  Sequences with a feature are counted exactly, by distinct (group, sequence) pairs.
    """
    rows = features.select(F.col(name).alias("_n"), type_.alias("type"), F.col(location).alias("location"))
    sets = rows.groupingSets([["type", "location"], ["type"], []], "type", "location").agg(F.count("*").alias("n"), F.countDistinct("_n").alias("sequences"), F.grouping_id().cast("long").alias("level"))
    return sets.where("level > 0 or location is not null")


def ssr_statistics(ssrs: DataFrame, name: str = "name", unit: str = "unit", location: str = "location") -> DataFrame:
    """``feature_statistics`` of microsatellites by the kind of their unit."""
    kind = F.get(F.array(*[F.lit(k) for k in SSR_KINDS]), F.length(unit) - 2)
    return feature_statistics(ssrs, kind, name, location)
