"""GFF, BED, VCF, SAM, search hits, cross references and wiggle tracks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import alignment as A
from strandline.functions import sequence as S


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """kind (feature, metadata, comment), raw, the nine columns, and attributes as a map of string arrays."""
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    kind = F.when(F.col("value").startswith("##"), "metadata").when(F.col("value").startswith("#"), "comment").otherwise("feature")
    c = F.split("value", "\t")
    get = lambda k: F.nullif(F.get(c, F.lit(k)), F.lit("."))
    pairs = F.filter(F.split(F.coalesce(get(8), F.lit("")), ";"), lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(pairs, lambda p: F.struct(A.gff_unescape(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.transform(F.split(F.regexp_replace(p, "^[^=]*=", ""), ","), A.gff_unescape).alias("v")))
    out = rows.withColumn("kind", kind)
    f = F.col("kind") == "feature"
    return out.select(
        "kind", F.col("value").alias("raw"), *[F.when(f, A.gff_unescape(get(k))).alias(n) for k, n in ((0, "seqid"), (1, "source"), (2, "type"))],
        F.when(f, get(3)).cast("long").alias("start"), F.when(f, get(4)).cast("long").alias("end"), F.when(f, get(5)).cast("double").alias("score"), F.when(f, get(6)).alias("strand"), F.when(f, get(7)).cast("int").alias("phase"),
        F.when(f, F.map_from_entries(entries)).alias("attributes"),
    )


def gff_line(attributes: Column) -> Column:
    """The nine columns as a line; attributes in the order of their names."""
    keys = F.array_sort(F.map_keys(attributes))
    text = F.array_join(F.transform(keys, lambda k: F.concat(A.gff_escape(k), F.lit("="), F.array_join(F.transform(attributes[k], A.gff_escape), ","))), ";")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return F.concat_ws("\t", *[dot(c) for c in ("seqid", "source", "type", "start", "end", "score", "strand", "phase")], F.coalesce(F.nullif(text, F.lit("")), F.lit(".")))


def write_gff(df: DataFrame, path: str) -> None:
    line = F.when(F.col("kind") == "feature", gff_line(F.col("attributes"))).otherwise(F.col("raw"))
    df.select(line).write.text(path)


def gff_to_bed(df: DataFrame, types: list[str]) -> DataFrame:
    return df.where(F.col("type").isin(types)).select("seqid", "start", "end").orderBy("seqid", "start")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="ref string, seg_start long, seg_end long").where("ref is not null")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt, qual, filters, info and samples (name to allele counts).

    The header line is found wherever it stands; samples are matched to its columns.
    """
    text = spark.read.text(path)
    head = text.where(F.col("value").startswith("#CHROM")).limit(1).collect()
    names = head[0][0].split("\t")[9:] if head else []
    c = F.split("value", "\t")
    g = lambda k: F.get(c, F.lit(k))
    rows = text.where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0))
    alt = F.filter(F.split(g(4), ","), lambda x: x != ".")
    info = F.transform(F.split(g(7), ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).alias("v")))

    def counts(sample: Column) -> Column:
        index, number = F.split(F.substring_index(sample, ":", 1), r"[|/]"), F.split(F.element_at(F.split(sample, ":"), -1), ",")
        alleles = F.concat(F.array(g(3)), alt)
        named = F.transform(index, lambda i: F.get(alleles, i.try_cast("int")))
        pairs = F.filter(F.arrays_zip(named.alias("k"), F.transform(number, lambda n: n.try_cast("int")).alias("v")), lambda p: p["k"].isNotNull())
        return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"])))

    samples = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), counts(g(9 + k)))]) if names else F.create_map().cast("map<string,map<string,int>>")
    return rows.select(g(0).alias("chrom"), g(1).cast("long").alias("pos"), F.nullif(g(2), F.lit(".")).alias("id"), g(3).alias("ref"), alt.alias("alt"), g(5).try_cast("double").alias("qual"), F.split(g(6), ";").alias("filters"), F.map_from_entries(info).alias("info"), samples.alias("samples"))


def vcf_rows(snvs: DataFrame, alleles: DataFrame, counts: DataFrame, filters: DataFrame, groups: list[str]) -> DataFrame:
    """VCF columns: snvs (snv_id, chrom, pos, ref, mapq), alleles (snv_id, allele, kind, quality), counts (snv_id, allele, group, n), filters (snv_id, filter, failed).

    Quality is that of a single variant allele, the sum of the first two, or the
    reference's; filters are ., PASS, or the short names of those that failed.
    """
    other = F.filter("a", lambda x: (x["kind"] != "INVARIANT") & ~F.contains(x["allele"], F.lit("-")))
    ref_q = F.filter("a", lambda x: x["kind"] == "INVARIANT")
    n = F.size("o")
    qual = F.when(n == 1, F.get("o", F.lit(0))["quality"]).when(n > 1, F.get("o", F.lit(0))["quality"] + F.get("o", F.lit(1))["quality"]).otherwise(F.get("r", F.lit(0))["quality"])
    total = counts.groupBy("snv_id", "allele").agg(F.sum("n").alias("n"))
    a = alleles.join(total, ["snv_id", "allele"], "left").groupBy("snv_id").agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("n", F.lit(0))).alias("k"), "allele", "kind", "quality"))).alias("a"), F.sum("n").alias("rc"))
    a = a.withColumn("o", other).withColumn("r", ref_q).withColumn("alt", F.when(F.size("o") > 0, F.array_join(F.transform("o", lambda x: x["allele"]), ",")).otherwise(".")).withColumn("qual", qual)
    f = filters.groupBy("snv_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("failed"), F.upper("filter")))), ";").alias("f"))
    order = F.transform(F.concat(F.filter("a", lambda x: x["kind"] == "INVARIANT"), F.col("o")), lambda x: x["allele"])
    a = a.withColumn("order", order)
    at = counts.groupBy("snv_id", "group", "allele").agg(F.sum("n").alias("n")).where("n > 0").join(a.select("snv_id", "order"), "snv_id").withColumn("i", F.array_position("order", F.col("allele")) - 1).where("i >= 0")
    gt = at.groupBy("snv_id", "group").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("g"))
    gt = gt.select("snv_id", "group", F.concat(F.array_join(F.transform("g", lambda x: x["i"].cast("string")), "|"), F.lit(":"), F.array_join(F.transform("g", lambda x: x["n"].cast("string")), ",")).alias("gt"))
    gt = gt.groupBy("snv_id").pivot("group", groups).agg(F.first("gt"))
    out = snvs.join(a.select("snv_id", "alt", "qual", "rc"), "snv_id", "left").join(f, "snv_id", "left").join(gt, "snv_id", "left")
    filt = F.when(F.col("f").isNull(), ".").when(F.col("f") == "", "PASS").otherwise(F.col("f"))
    return out.select("chrom", (F.col("pos") + 1).alias("pos"), F.lit(".").alias("id"), "ref", F.coalesce("alt", F.lit(".")).alias("alt"), "qual", filt.alias("filter"), F.format_string("RC=%d;MQ=%.1f", F.coalesce("rc", F.lit(0)).cast("long"), F.col("mapq").cast("double")).alias("info"), F.lit("GT:EC").alias("format"), *[F.coalesce(g, F.lit(".:.")).alias(g) for g in groups])


def write_vcf(rows: DataFrame, path: str, compress: bool = True) -> None:
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in rows.columns])
    head = "##fileformat=VCFv4.1\n#" + "\t".join([*(c.upper() for c in rows.columns[:9]), *rows.columns[9:]])
    out = rows.sparkSession.createDataFrame([(head, 0)], "value string, o int").unionByName(rows.orderBy("chrom", "pos").select(line.alias("value"), F.lit(1).alias("o")))
    out.select("value").write.option("compression", "gzip" if compress else "none").text(path)


SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven columns (0-based pos, quality arrays) and the tags as a map; rg and nm of their own."""
    c = F.split("value", "\t")
    g = lambda k: F.get(c, F.lit(k))
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    tags = F.map_from_entries(F.transform(F.slice(c, 12, F.greatest(F.size(c) - 11, F.lit(0))), lambda t: F.struct(F.left(t, F.lit(2)).alias("k"), F.regexp_replace(t, "^[^:]*:[^:]*:", "").alias("v"))))
    out = rows.select(g(0).alias("qname"), g(1).cast("int").alias("flag"), g(2).alias("rname"), (g(3).cast("long") - 1).alias("pos"), g(4).cast("int").alias("mapq"), g(5).alias("cigar"), g(6).alias("rnext"), g(7).cast("long").alias("pnext"), g(8).cast("long").alias("tlen"), g(9).alias("seq"), F.when(g(10) != "*", S.phred(g(10))).alias("qual"), tags.alias("tags"))
    return out.withColumn("rg", F.col("tags")["RG"]).withColumn("nm", F.col("tags")["NM"].cast("int"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """rg, pl, lb, sm of the header."""
    rows = spark.read.text(path).where(F.col("value").startswith("@RG"))
    m = F.str_to_map(F.regexp_replace("value", "^@RG\t", ""), F.lit("\t"), F.lit(":"))
    return rows.select(m.alias("m")).select(*[F.col("m")[k.upper()].alias(a) for k, a in (("id", "rg"), ("pl", "pl"), ("lb", "lb"), ("sm", "sm"))])


def write_sam(df: DataFrame, path: str) -> None:
    q = F.when(F.col("qual").isNull(), "*").otherwise(S.phred_text(F.col("qual")))
    cols = [F.col(c).cast("string") if c not in ("pos", "qual") else (F.coalesce(F.col("pos") + 1, F.lit(0)).cast("string") if c == "pos" else q) for c in SAM]
    df.select(F.concat_ws("\t", *cols)).write.text(path)


def read_blast_tab(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a tabular report of 12 columns, or 14 with the lengths: 0-based, matches ranked in file order within each query and parts within each match."""
    names = ["query", "subject", "identity", "length", "mismatches", "gaps", "q_start", "q_end", "s_start", "s_end", "expect", "score", "q_len", "s_len"]
    kinds = ["string"] * 2 + ["double"] + ["long"] * 7 + ["double"] * 2 + ["long"] * 2
    df = spark.read.csv(path, sep="\t", comment="#", schema=", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    back = F.col("s_start") > F.col("s_end")
    df = df.withColumn("s_strand", F.when(back, -1).otherwise(1)).withColumn("_a", F.least("s_start", "s_end") - 1).withColumn("s_end", F.greatest("s_start", "s_end") - 1).withColumn("s_start", F.col("_a")).drop("_a")
    df = df.withColumn("q_start", F.col("q_start") - 1).withColumn("q_end", F.col("q_end") - 1).withColumn("similarity", F.col("identity")).withColumn("ord", F.monotonically_increasing_id())
    match = Window.partitionBy("query", "subject")
    df = df.withColumn("part_rank", F.row_number().over(match.orderBy("ord"))).withColumn("_first", F.min("ord").over(match))
    return df.withColumn("match_rank", F.dense_rank().over(Window.partitionBy("query").orderBy("_first"))).drop("_first")


_HIT = "query string, q_len long, subject string, s_len long, match_rank int, part_rank int, q_start long, q_end long, q_strand int, s_start long, s_end long, s_strand int, expect double, score double, similarity double"


def _blast_section(text: str) -> list[tuple]:
    """Aligned parts of one query's section of a text report."""
    lines = [x.strip() for x in text.splitlines()]
    query = lines[0].split()[0] if lines and lines[0].split() else ""
    q_len = s_len = subject = part = None
    out, match, number = [], 0, 0

    def close():
        if part and "s_start" in part:
            lo, hi = sorted((part["s_start"], part["s_end"]))
            a, b = sorted((part["q_start"], part["q_end"]))
            out.append((query, q_len, subject, s_len, match, number, a, b, part["strands"][0], lo, hi, part["strands"][1], part["expect"], part["score"], part.get("similarity")))

    for line in lines[1:]:
        if line.startswith(">") or line.startswith("Subject="):
            close()
            name = line.lstrip(">").split("=")[-1].split()
            part, subject, s_len, match, number = None, name[0] if name else "", None, match + 1, 0
        elif line.startswith("Length="):
            n = int(line.split("=")[-1].replace(",", ""))
            q_len, s_len = (n, s_len) if subject is None else (q_len, n)
        elif subject is not None and line.startswith("Score"):
            close()
            number += 1
            score = re.search(r"Score\s*=\s*([-+.\de]+)", line)
            expect = re.search(r"Expect(?:\(\d+\))?\s*=\s*([-+.\de]+)", line)
            value = expect.group(1).rstrip(",") if expect else "nan"
            part = {"score": float(score.group(1)) if score else None, "expect": float("1" + value if value.startswith("e") else value), "strands": (1, 1)}
        elif part is not None and line.startswith("Identities"):
            part["similarity"] = float(re.search(r"\((\d+)%\)", line).group(1))
        elif part is not None and line.startswith("Strand"):
            part["strands"] = tuple(1 if x.strip() == "Plus" else -1 for x in line.split("=")[-1].split("/"))
        elif part is not None and re.match(r"(Query|Sbjct)\s+\d+\s", line):
            which, first, *_, last = line.split()
            key = "q" if which == "Query" else "s"
            part.setdefault(f"{key}_start", int(first) - 1)
            part[f"{key}_end"] = int(last) - 1
    close()
    return out


def read_blast_text(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a text report, 0-based; the report is cut at its queries, so that a file is read by many tasks."""
    sections = spark.read.option("lineSep", "\nQuery=").text(path)

    def parse(batches):
        for part in batches:
            rows = [r for text in part["value"] for r in _blast_section(text.removeprefix("Query=").lstrip())]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _HIT.split(", ")])

    return sections.mapInPandas(parse, _HIT)


def read_blast_xml(spark: SparkSession, path: str) -> DataFrame:
    """Hits of an XML report, with 0-based coordinates."""
    hsp = "struct<`Hsp_num`:int,`Hsp_bit-score`:double,`Hsp_evalue`:double,`Hsp_query-from`:long,`Hsp_query-to`:long,`Hsp_hit-from`:long,`Hsp_hit-to`:long,`Hsp_identity`:long,`Hsp_positive`:long,`Hsp_align-len`:long>"
    schema = f"`Iteration_query-def` string, `Iteration_query-len` long, `Iteration_hits` struct<Hit:array<struct<`Hit_num`:int,`Hit_id`:string,`Hit_def`:string,`Hit_accession`:string,`Hit_len`:long,`Hit_hsps`:struct<Hsp:array<{hsp}>>>>>"
    df = spark.read.format("xml").option("rowTag", "Iteration").schema(schema).load(path)
    df = df.select(F.col("Iteration_query-def").alias("query"), F.col("Iteration_query-len").alias("q_len"), F.explode("Iteration_hits.Hit").alias("h"))
    df = df.select("query", "q_len", F.col("h.Hit_num").alias("match_rank"), F.col("h.Hit_accession").alias("subject"), F.col("h.Hit_def").alias("subject_description"), F.col("h.Hit_len").alias("s_len"), F.explode("h.Hit_hsps.Hsp").alias("p"))
    p = lambda c: F.col("p").getField(c)
    lo, hi = F.least(p("Hsp_hit-from"), p("Hsp_hit-to")), F.greatest(p("Hsp_hit-from"), p("Hsp_hit-to"))
    return df.select(
        F.regexp_extract("query", r"^(\S+)", 1).alias("query"), "q_len", "subject", "subject_description", "s_len", "match_rank", p("Hsp_num").alias("part_rank"),
        (p("Hsp_query-from") - 1).alias("q_start"), (p("Hsp_query-to") - 1).alias("q_end"), (lo - 1).alias("s_start"), (hi - 1).alias("s_end"), F.when(p("Hsp_hit-from") <= p("Hsp_hit-to"), 1).otherwise(-1).alias("s_strand"),
        p("Hsp_evalue").alias("expect"), p("Hsp_bit-score").alias("score"), (100.0 * p("Hsp_identity") / p("Hsp_align-len")).alias("identity"), (100.0 * p("Hsp_positive") / p("Hsp_align-len")).alias("similarity"),
    )


def read_exonerate(spark: SparkSession, path: str) -> DataFrame:
    """``cigar_like:`` lines; ends are between symbols, so one is taken off."""
    c = F.split(F.trim(F.regexp_replace("value", "^cigar_like:", "")), r"\s+")
    g = lambda k: F.get(c, F.lit(k))
    rows = spark.read.text(path).where(F.col("value").startswith("cigar_like:"))
    n = lambda k: g(k).cast("long")
    return rows.select(g(0).alias("query"), F.least(n(1), n(2)).alias("q_start"), (F.greatest(n(1), n(2)) - 1).alias("q_end"), g(3).alias("q_strand"), g(4).alias("subject"), F.least(n(5), n(6)).alias("s_start"), (F.greatest(n(5), n(6)) - 1).alias("s_end"), g(7).alias("s_strand"), g(8).cast("double").alias("score"))


def read_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line parted stanzas of ``key: value`` lines, as maps."""
    rows = spark.read.option("lineSep", "\n\n").text(path)
    lines = F.filter(F.split("value", "\n"), lambda x: F.contains(x, F.lit(":")) & ~x.startswith("!"))
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    return rows.select(F.map_from_entries(F.transform(F.map_keys(F.map_from_arrays(F.array_distinct(F.transform(entries, lambda e: e["k"])), F.array_distinct(F.transform(entries, lambda e: e["k"])))), lambda k: F.struct(k.alias("k"), F.get(F.filter(entries, lambda e: e["k"] == k), F.lit(0))["v"].alias("v")))).alias("stanza")).where(F.size("stanza") > 0)


def xref_url(stanzas: DataFrame, database: str, key: str) -> DataFrame:
    """Address of a key by its database's template."""
    return stanzas.where(F.col("stanza")["abbreviation"] == database).select(F.replace(F.col("stanza")["url_syntax"], F.lit("[example_id]"), F.lit(key)).alias("url"))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, sep="\t", comment="#", nullValue=".", schema="name string, alias string, type string, sofa string, sequence string, pub string")
    return df.withColumn("alias", F.array_distinct(F.split("alias", ",")))


def write_markers(df: DataFrame, path: str) -> None:
    dot = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("."))
    cols = [F.array_join("alias", ",") if c == "alias" else F.col(c) for c in ("name", "alias", "type", "sofa", "sequence", "pub")]
    df.select(F.concat_ws("\t", *[dot(c) for c in cols])).write.text(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """name, go, of a two-column list."""
    return spark.read.csv(path, sep="\t", schema="name string, go string, note string").select("name", "go")


def wig_lines(profile: DataFrame, ref: str = "ref", at: str = "centre", value: str = "mean") -> DataFrame:
    """variableStep lines, 1-based, a header for each reference."""
    body = profile.select(F.col(ref).cast("string").alias("r"), F.col(at).alias("p"), F.format_string("%d %.4f", (F.col(at) + 1).cast("long"), F.col(value).cast("double")).alias("line"))
    head = body.select("r").distinct().select("r", F.lit(-1).cast("long").alias("p"), F.concat(F.lit("variableStep chrom="), "r").alias("line"))
    return head.unionByName(body).orderBy("r", "p").select("line")
