"""Physical maps of fingerprinted clones: stanzas of clones, markers and contigs in three sections of a file.

A file is read by byte ranges, a stanza at a time.  Which section a stanza belongs to is told by
the places of the two section lines of its file, so no range needs what stood before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Section lines, in their order.
_SECTIONS = ("Markerdata", "Contigdata")


def _stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(section, lines): 0 for clones, 1 for markers, 2 for contigs; the file's header, a stanza of // lines, is left out."""
    rows = spark.read.option("lineSep", "\n\n").text(path)
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k")).alias("at"), lines.alias("lines"))
    mark = lambda n: F.min(F.when(F.exists("lines", lambda x: x.startswith(_SECTIONS[n])), F.col("at"))).alias(f"m{n}")
    marks = rows.groupBy("file").agg(mark(0), mark(1))
    after = lambda n: F.coalesce(F.col("at") > F.col(f"m{n}"), F.lit(False)).cast("int")
    # A section line may share its stanza with what follows it.
    own = F.coalesce((F.col("at") == F.col("m0")) | (F.col("at") == F.col("m1")), F.lit(False))
    out = rows.join(marks, "file").withColumn("section", after(0) + after(1) + own.cast("int"))
    kept = F.filter("lines", lambda x: ~x.startswith(_SECTIONS[0]) & ~x.startswith(_SECTIONS[1]) & ~x.startswith("//"))
    return out.select("file", "section", kept.alias("lines")).where(F.size("lines") > 0)


def _values(pattern: str, group: int = 1) -> Column:
    found = F.transform("lines", lambda x: F.regexp_extract(x, pattern, group))
    return F.filter(found, lambda x: x != "")


def _first(pattern: str, kind: str = "string") -> Column:
    return F.get(_values(pattern), F.lit(0)).try_cast(kind)


def _remarks(word: str) -> Column:
    return F.nullif(F.array_join(_values(rf'^{word}\s+"?([^"]*)"?'), "\n"), F.lit(""))


def read_fpc(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """clones, markers and contigs of physical maps.

    A contig reaches from the least to the greatest end of its clones, as numbers; a clone without a contig has none of its own.
    """
    rows = _stanzas(spark, path)
    head = F.get("lines", F.lit(0))
    kind, name = F.trim(F.regexp_extract(head, r"^([^:]*):", 1)), F.regexp_extract(head, r':\s*"?([^"]*)"?', 1)
    hits = F.transform(F.filter("lines", lambda x: x.rlike(r"^[a-zA-Z]+_match_to_\w+\s+")), lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([a-zA-Z]+)_match", 1)).alias("kind"), F.regexp_extract(x, r'"(.+)"', 1).alias("clone")))
    marks = F.transform(F.filter("lines", lambda x: x.rlike(r"^Positive_\w+\s+")), lambda x: F.struct(F.regexp_extract(x, r"^Positive_(\w+)", 1).alias("type"), F.regexp_extract(x, r'"(.+)"', 1).alias("name")))
    clones = rows.where((F.col("section") == 0) & head.contains(":")).select(
        "file", name.alias("name"), kind.alias("type"), _first(r'^Map "ctg(\d+)" Ends Left').alias("contig"), _first(r'^Map "ctg\d+" Ends Left (-?\d+)', "int").alias("start"), _first(r'^Map "ctg\d+" Ends Right (-?\d+)', "int").alias("end"),
        hits.alias("matches"), marks.alias("markers"), _first(r"^Gel_number\s+(\S+)").alias("gel"), _first(r"^Fp_number\s+(\S+)").alias("fp_number"), _first(r"^Shotgun\s+(\S+)").alias("sequence_type"), F.get(_values(r"^Shotgun\s+\S+\s+(\S+)"), F.lit(0)).alias("sequence_status"),
        _remarks("Remark").alias("remark"), _remarks("fpc_remark").alias("fpc_remark"),
    )
    group = _first(r'^Anchor_bin\s+"?([^"\s]*)')
    own = rows.where((F.col("section") == 1) & head.contains(":")).select(
        "file", name.alias("name"), F.regexp_replace(kind, "^[^_]*_", "").alias("type"), F.coalesce(F.regexp_extract(group, r"^(\d+|\w)", 1), F.lit("0")).alias("group"), F.regexp_extract(group, r"^(?:\d+|\w)(.*)$", 1).alias("subgroup"),
        F.exists("lines", lambda x: x.rlike("^(Anchor_pos|anchor)")).cast("int").alias("anchor"), _first(r"^Anchor_pos\s+([\d.]+)", "double").alias("position"), F.coalesce((_first(r"^Anchor_pos\s+[\d.]+\s+([FP])") == "F").cast("int"), F.lit(0)).alias("framework"), _remarks("Remark").alias("remark"),
    )
    met = clones.select("file", F.col("name").alias("clone"), "contig", F.explode("markers").alias("m")).groupBy("file", F.col("m.name").alias("name")).agg(
        F.min("m.type").alias("_type"), F.array_sort(F.collect_set("contig")).alias("contigs"), F.array_sort(F.collect_set("clone")).alias("clones")
    )
    markers = own.join(met, ["file", "name"], "full").withColumn("type", F.coalesce("type", "_type")).drop("_type")
    reach = clones.where("contig is not null").groupBy("file", "contig").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("name")).alias("clones"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("markers", lambda m: m["name"]))))).alias("markers")
    )
    # Contig stanzas may stand without blank lines between them.
    each = rows.where(F.col("section") == 2).select("file", F.posexplode("lines").alias("k", "x"), F.monotonically_increasing_id().alias("s"), "lines")
    starts = F.array_max(F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(r"^Ctg\d+") & (i <= F.col("k")), i)), lambda x: x.isNotNull()))
    each = each.withColumn("c", F.regexp_extract(F.get("lines", starts), r"^Ctg(\d+)", 1)).where("c is not null and c <> ''")
    line = lambda p, g=1: F.max(F.nullif(F.regexp_extract("x", p, g), F.lit("")))
    notes = each.groupBy("file", F.col("c").alias("contig")).agg(
        line(r'^Chr_remark\s+"(?:-|\+|Chr\d+)\s+(.+)"$').alias("chr_remark"), line(r'^Chr_remark\s+"(-|\+|Chr\d+)\s').alias("_chr"), line(r'^User_remark\s+"?([^"\s]*)').alias("user_remark"), line(r'^Trace_remark\s+"?([^"\s]*)').alias("trace_remark")
    )
    contigs = notes.join(reach, ["file", "contig"], "full")
    group = F.when(F.col("_chr").isNull(), "0").otherwise(F.coalesce(F.nullif(F.regexp_extract("_chr", r"Chr(\d+)", 1), F.lit("")), F.lit("?")))
    return {"clones": clones, "markers": markers, "contigs": contigs.withColumn("group", group).withColumn("anchor", F.col("_chr").isNotNull().cast("int")).drop("_chr")}
