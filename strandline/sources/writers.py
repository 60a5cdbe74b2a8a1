"""Annotation files as tables of lines, and one call that writes several of them.

Every ``*_lines`` function gives a column ``line``, so that a file is a projection and
Spark's text sink writes its parts; headers are a property of the sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORTHOLOG_HEADER = "Spp\tseqname\torthologs"
SSR_HEADER = "Seqname\tstart\tend\tlength\tscore\tkind\tunit\tnum repeats"


def ortholog_lines(seqs: DataFrame, name: str = "name", orthologs: str = "orthologs") -> DataFrame:
    """A line for each sequence and species of the map ``orthologs`` (species to names)."""
    rows = seqs.select(name, F.explode(orthologs).alias("spp", "names"))
    return rows.select(F.concat_ws("\t", "spp", name, F.array_join("names", ",")).alias("line"))


def orf_lines(orfs: DataFrame, kind: str = "seq", name: str = "name") -> DataFrame:
    """FASTA records of reading frames (name, start, end, strand, dna, pep): ``seq`` or ``pep``; places count from 1."""
    head = F.format_string(f">%s_orf_{kind} start=%d end=%d strand=%s", F.col(name).cast("string"), F.col("start") + 1, F.col("end") + 1, "strand")
    return orfs.select(F.concat(head, F.lit("\n"), F.col("dna" if kind == "seq" else "pep")).alias("line"))


def ssr_lines(ssrs: DataFrame, name: str = "name") -> DataFrame:
    """Microsatellites (name, start, end, score, kind, unit) with their lengths and numbers of repeats."""
    length = F.col("end") - F.col("start") + 1
    repeats = F.floor(length / F.length("unit"))
    values = [F.col(name), F.col("start") + 1, F.col("end") + 1, length, F.col("score").cast("int"), F.col("kind"), F.col("unit"), repeats]
    return ssrs.select(F.concat_ws("\t", *[v.cast("string") for v in values]).alias("line"))


def illumina_lines(snvs: DataFrame, length: int = 60, short: bool = False) -> DataFrame:
    """Variants (name, seq, start, ref, alleles) for a genotyping order: name_place,SNP,left[A/B]right.

    Alleles and the reference's are given once each, in order.  A left flank that would
    begin before the sequence counts from its end, as a slice does, and so is mostly
    empty; with ``short`` it is cut instead.
    """
    n, at = F.length("seq"), F.col("start")
    left = F.when(at >= length, at - length).otherwise(F.lit(0) if short else F.greatest(n + at - length, F.lit(0)))
    before = F.when(at > left, F.substring(F.col("seq"), (left + 1).cast("int"), (at - left).cast("int"))).otherwise("")
    after = F.substring(F.col("seq"), (at + 2).cast("int"), F.lit(length))
    alleles = F.array_sort(F.array_distinct(F.concat("alleles", F.array("ref"))))
    return snvs.select(F.concat(F.col("name"), F.lit("_"), (at + 1).cast("string"), F.lit(",SNP,"), before, F.lit("["), F.array_join(alleles, "/"), F.lit("]"), after).alias("line"))


# Letters that stand for several bases.
IUPAC = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K", "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N"}


def sequenom_lines(seqs: DataFrame, snvs: DataFrame, chosen: DataFrame, length: int = 150, maf: float | None = None) -> DataFrame:
    """FASTA records around chosen SNPs: the chosen one as [A/B], the others within the flanks as letters.

    ``seqs`` (name, seq); ``snvs`` (name, start, end, kind, ref, alleles, major, maf), half open and apart from
    each other; ``chosen`` (name, start).  Of the others one with more than ``maf`` shows its most frequent allele; else
    a SNP shows its IUPAC letter, a deletion or mixture the reference's first letter and Ns, an insertion N.
    """
    table = F.create_map(*[F.lit(x) for pair in IUPAC.items() for x in pair])
    letters = F.array_join(F.array_sort(F.array_distinct(F.transform("alleles", F.upper))), "")
    plain = F.when(F.col("kind") == "SNP", F.coalesce(F.try_element_at(table, letters), F.lit("N")))
    plain = plain.when(F.col("kind").isin("DELETION", "COMPLEX", "INDEL"), F.concat(F.left("ref", F.lit(1)), F.repeat(F.lit("N"), F.length("ref") - 1))).otherwise("N")
    other = F.when(F.coalesce(F.col("maf") > F.lit(maf).cast("double"), F.lit(False)), F.col("major")).otherwise(plain)
    marked = F.concat(F.lit("["), F.array_join(F.array_sort("alleles"), "/"), F.lit("]"))
    c = chosen.select("name", F.col("start").alias("_at"))
    near = snvs.join(c, "name").where((F.col("start") >= F.col("_at") - length) & (F.col("end") <= F.col("_at") + length + 1))
    text = F.when(F.col("start") == F.col("_at"), marked).otherwise(other)
    near = near.groupBy("name", "_at").agg(F.array_sort(F.collect_list(F.struct("start", "end", text.alias("text")))).alias("_near"))
    rows = near.join(seqs, "name")
    lo, hi = F.greatest(F.col("_at") - length, F.lit(0)), F.least(F.col("_at") + length + 1, F.length("seq"))

    def cut(a: Column, b: Column) -> Column:
        return F.substring(F.col("seq"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    zero = F.struct(lo.cast("long").alias("at"), F.lit("").alias("out"))
    body = F.aggregate("_near", zero, lambda acc, s: F.struct(s["end"].cast("long").alias("at"), F.concat(acc["out"], cut(acc["at"], s["start"]), s["text"]).alias("out")), lambda acc: F.concat(acc["out"], cut(acc["at"], hi)))
    return rows.select(F.concat(F.lit(">"), F.col("name"), F.lit("_"), (F.col("_at") - lo + 1).cast("string"), F.lit("\n"), body).alias("line"))


def gff_features(seqs: DataFrame, features: DataFrame, default_type: str = "region", source: str = ".", own_source: str = "strandline") -> DataFrame:
    """GFF rows of sequences (name, seq, and perhaps so, description, gos, orthologs) and of their features (name, ftype, start, end, and perhaps score, unit, kind, strand).

    Microsatellites and variants are numbered over everything, other features within
    their sequence, in order of sequence and place; numbers come from counts by range, not from one window.
    """
    have = set(seqs.columns)
    some = lambda c: F.col(c) if c in have else F.lit(None)
    one = lambda k, v: F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), F.array(v.cast("string")).alias("value")))
    many = lambda k, v: F.when(F.size(v) > 0, F.struct(F.lit(k).alias("key"), v.cast("array<string>").alias("value")))
    flat = F.flatten(F.transform(F.map_entries("orthologs"), lambda e: F.transform(e["value"], lambda n: F.concat(e["key"], F.lit(":"), n)))) if "orthologs" in have else F.lit(None).cast("array<string>")
    gos = F.col("gos") if "gos" in have else F.lit(None).cast("array<string>")
    entries = lambda *e: F.map_from_entries(F.filter(F.array(*e), lambda x: x.isNotNull()))
    parents = seqs.select(
        F.lit("feature").alias("kind"), F.col("name").alias("seqid"), F.lit(source).alias("source"), F.coalesce(some("so").cast("string"), F.lit(default_type)).alias("type"), F.lit(1).cast("long").alias("start"), F.length("seq").cast("long").alias("end"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("strand"), F.lit(None).cast("string").alias("phase"),
        entries(one("name", F.col("name")), one("description", some("description")), many("Ontology_term", gos), many("orthologs", flat)).alias("attributes"),
    )
    have_f = set(features.columns)
    f = lambda c, kind: F.col(c).cast(kind) if c in have_f else F.lit(None).cast(kind)
    from pyspark.sql import Window

    # Numbers over everything: within a sequence by place, and before it by the sums of earlier sequences.
    counted = features.groupBy("ftype", "name").agg(F.count("*").alias("_n"))
    within = F.row_number().over(Window.partitionBy("ftype", "name").orderBy("start", "end"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("ftype").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = features.withColumn("_k", within).join(counted.select("ftype", "name", before.alias("_before")), ["ftype", "name"])
    number = (F.col("_before") + F.col("_k")).cast("string")
    label = F.when(F.col("ftype") == "microsatellite", F.concat(F.lit("ssr"), number)).when(F.col("ftype") == "snv", F.concat(F.lit("snv"), number)).when(F.col("ftype") == "orf", F.concat("name", F.lit(".orf")))
    label = label.otherwise(F.concat("name", F.lit("."), "ftype", F.col("_k").cast("string")))
    ssr = F.col("ftype") == "microsatellite"
    kind = F.when(F.col("ftype") == "orf", "ORF").when(F.col("ftype") == "snv", "SNV").otherwise(F.col("ftype"))
    strand = F.when(F.col("ftype") == "orf", F.when(f("strand", "string") == "forward", "+").otherwise("-"))
    children = rows.select(
        F.lit("feature").alias("kind"), F.col("name").alias("seqid"), F.lit(own_source).alias("source"), kind.alias("type"), (F.col("start") + 1).cast("long").alias("start"), (F.col("end") + 1).cast("long").alias("end"),
        F.when(ssr, f("score", "double")).alias("score"), strand.alias("strand"), F.lit(None).cast("string").alias("phase"),
        entries(one("name", label), one("score", F.when(ssr, f("score", "string"))), one("unit", F.when(ssr, f("unit", "string"))), one("ssr_type", F.when(ssr, f("kind", "string")))).alias("attributes"),
    )
    return parents.unionByName(children)


def browser_lines(features: DataFrame) -> DataFrame:
    """A feature's name and its place as seqid:start..end."""
    return features.select(F.concat(F.col("name").cast("string"), F.lit("\t"), F.col("seqid").cast("string"), F.lit(":"), F.col("start").cast("string"), F.lit(".."), F.col("end").cast("string")).alias("line"))


def distribution_lines(bins: DataFrame) -> DataFrame:
    """A histogram (bin, left_edge, right_edge, n) as two lines: its values, and its edges; bins are few, by their making."""
    rows = bins.agg(F.array_sort(F.collect_list(F.struct("bin", "left_edge", "right_edge", "n"))).alias("b"))
    values = F.array_join(F.transform("b", lambda x: x["n"].cast("string")), ",")
    edges = F.array_join(F.concat(F.transform("b", lambda x: x["left_edge"].cast("string")), F.array(F.element_at("b", -1)["right_edge"].cast("string"))), ",")
    lines = F.array(F.concat(F.lit("values: "), values), F.concat(F.lit("bin_edges: "), edges))
    return rows.where(F.size("b") > 0).select(F.explode(lines).alias("line"))


def summary_lines(stats: DataFrame, title: str) -> DataFrame:
    """A one-row table of figures as a text report: the title, then a line for each figure."""
    items = F.array(F.lit(title), F.lit("-" * len(title)), *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in stats.columns])
    return stats.select(F.explode(items).alias("line"))


def sam_lines(alignments: DataFrame, references: DataFrame | None = None, keep_unmapped: bool = True) -> DataFrame:
    """Header lines of the references (name, length), then alignments in the eleven columns with their ``tags`` (map)."""
    from strandline.functions import sequence as S
    from strandline.sources.features import SAM

    rows = alignments if keep_unmapped else alignments.where(F.col("flag").bitwiseAND(4) == 0)
    q = F.when(F.col("qual").isNull(), "*").otherwise(S.phred_text(F.col("qual")))
    cols = [q if c == "qual" else F.coalesce(F.col("pos") + 1, F.lit(0)).cast("string") if c == "pos" else F.col(c).cast("string") for c in SAM]
    if "tags" in rows.columns:
        number = lambda v: F.when(v.rlike("^[-+]?[0-9]+$"), "i").otherwise("Z")
        entries = F.array_sort(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>"))))
        cols.append(F.nullif(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), number(e["value"]), F.lit(":"), e["value"])), "\t"), F.lit("")))
    body = rows.select(F.concat_ws("\t", *cols).alias("line"))
    if references is None:
        return body
    # A union keeps the order of its parts' partitions: the header, one of them, stands first in what is written, and the body keeps its own.
    head = references.select(F.format_string("@SQ\tSN:%s\tLN:%d", "name", "length").alias("line")).coalesce(1)
    return head.unionByName(body)


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Text parts; a header stands at the beginning of each part, as with CSV files."""
    if header is None:
        lines.select("line").write.text(path)
    else:
        lines.select(F.col("line").alias(header)).write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)


def write_all(tables: dict[str, DataFrame], path: str, headers: dict[str, str] | None = None) -> None:
    """Several files of lines in one call, each in a folder of its name."""
    for name, lines in tables.items():
        write_lines(lines, f"{path}/{name}", (headers or {}).get(name))
