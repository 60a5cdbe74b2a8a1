"""Genetic and physical maps, markers and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import scans

# Spellings of marker types and their standard names.
MARKER_TYPES = {
    "aflp": "aflp", "est-ssr": "microsatellite", "ssr": "microsatellite", "ima": "issr", "indel": "indel", "snp-indel": "indel",
    "marker": "sequence_feature", "morhological": "morphological", "morphological": "morphological", "trait": "morphological",
    "rapd": "rapd", "rapds": "rapd", "rflp": "RFLP_fragment", "snp": "SNP", "snp-caps": "SNP", "snp-snapshot-caps": "SNP",
    "snp-scar": "SNP", "scar": "SNP", "snp-sequencing": "SNP", "snp-snapshot": "SNP", "spelling error": "spelling error",
    "unknown": "sequence_feature", "isozyme": "isozyme",
}
# Ontology terms of standard names.
MARKER_TERMS = {"microsatellite": "SO:0000289", "indel": "SO:1000032", "sequence_feature": "SO:0000110", "SNP": "SO:0000694"}


def upsert_markers(markers: DataFrame, more: DataFrame, fields: list[str]) -> DataFrame:
    """One row per name: all aliases, and of each field the first that isn't null, older rows first."""
    both = markers.withColumn("_o", F.lit(0)).unionByName(more.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    first = [F.min(F.when(F.col(f).isNotNull(), F.struct("_o", F.col(f).alias("v"))))["v"].alias(f) for f in fields]
    return both.groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("alias", F.array().cast("array<string>")))))).alias("alias"), *first)


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def standard_types(markers: DataFrame, column: str = "type", term: str = "sofa") -> DataFrame:
    """Standard names of marker types, and their ontology terms (null where there is none); unknown types stay as they are."""
    kind = F.coalesce(_looked_up(MARKER_TYPES, F.lower(column)), F.col(column))
    return markers.withColumn(column, kind).withColumn(term, _looked_up(MARKER_TERMS, F.col(column)))


def correlate(names: DataFrame, markers: DataFrame) -> DataFrame:
    """Markers that are meant by a name or an alias."""
    keys = markers.select(F.col("name").alias("marker"), F.explode(F.array_union(F.array("name"), F.coalesce("alias", F.array().cast("array<string>")))).alias("name"))
    return names.join(keys.distinct(), "name")


def carry_group(rows: DataFrame, order: str = "ord", header: str = "group") -> DataFrame:
    """Fills each row's group from the last header row before it, within ``file``."""
    w = Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(header, F.last(header, ignorenulls=True).over(w))


def map_bounds(locations: DataFrame) -> DataFrame:
    return locations.groupBy("map_set", "map").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("features"))


def correspondences(locations: DataFrame, key: str = "marker", id_: str = "location_id") -> DataFrame:
    """Pairs of locations of one marker, each once."""
    a = locations.select(F.col(key), F.col(id_).alias("a"))
    b = locations.select(F.col(key), F.col(id_).alias("b"))
    return a.join(b, key).where("a < b")


def _next_letters(letters: Column) -> Column:
    """The next of AZ -> BA -> ... -> ZZ -> AAA."""
    head = F.regexp_replace(letters, "Z*$", "")
    tail = F.length(letters) - F.length(head)
    stepped = F.concat(F.left(head, F.length(head) - 1), F.char(F.ascii(F.right(head, F.lit(1))) + 1), F.repeat(F.lit("A"), tail))
    return F.when(head == "", F.repeat(F.lit("A"), F.length(letters) + 1)).otherwise(stepped)


def next_code(code: Column) -> Column:
    """The code after ``code``: its letters, then its digits.

    Digits count up; where all are 9 the letters step and zeros fill the length (A and
    zeros without letters).  Letters alone step; Z alone become zeros, one more.
    """
    letters, digits = F.regexp_replace(code, "[0-9]", ""), F.regexp_replace(code, "[^0-9]", "")
    full = F.when(letters == "", F.rpad(F.lit("A"), F.length(code), F.lit("0"))).otherwise(F.rpad(_next_letters(letters), F.length(code), F.lit("0")))
    alone = F.when(letters.rlike("^Z+$"), F.repeat(F.lit("0"), F.length(code) + 1)).otherwise(_next_letters(letters))
    counted = F.concat(letters, F.lpad((digits.try_cast("decimal(38,0)") + 1).cast("string"), F.length(digits), F.lit("0")))
    return F.when(digits == "", alone).when(digits.rlike("^9+$"), full).otherwise(counted)


def allocate_names(items: DataFrame, known: DataFrame, prefix: str, key: str = "name") -> DataFrame:
    """Known names by join; new ones numbered after the largest, in order of their keys.

    New keys are range partitioned and counted by partition, so no prefix of a name
    makes one task.
    """
    new = items.select(key).distinct().join(known, key, "left_anti")
    last = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("last"))
    numbered = ranked(new, key, "_r").join(F.broadcast(last)).select(key, (F.col("last") + F.col("_r")).alias("number"))
    every = known.select(key, "number").unionByName(numbered)
    return items.join(every, key).withColumn("new_name", F.concat(F.lit(prefix), F.lpad(F.col("number").cast("string"), 8, "0")))


def ranked(rows: DataFrame, key: str, out: str) -> DataFrame:
    """Distinct ``key`` values numbered from 1 in their order, by range buckets.

    A value's bucket is its place among 1,000 sampled cut points, so buckets are about a
    thousandth of the rows, and only their counts meet in one task.
    """
    cuts = [r[0] for r in rows.select(key).orderBy(F.xxhash64(key), key).limit(1000).collect()]
    points = F.array(*[F.lit(c) for c in sorted(cuts)]) if cuts else F.array().cast(f"array<{dict(rows.dtypes)[key]}>")
    spread = rows.withColumn("_b", F.size(F.filter(points, lambda c: c <= F.col(key))))
    counts = spread.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_b", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return spread.withColumn("_k", rank).join(F.broadcast(counts), "_b").withColumn(out, F.col("_k") + F.col("_before")).drop("_b", "_k", "_before")


def libraries_of(reads: DataFrame, sources: DataFrame, rules: list[tuple[str, str]], name: str = "name") -> DataFrame:
    """Library of each read: a listed one first, else that of the first rule (pattern at the name's beginning)."""
    out = reads.join(sources.select(name, F.col("library").alias("_l")), name, "left")
    rule = F.lit(None).cast("string")
    for pattern, library in reversed(rules):
        rule = F.when(F.col(name).rlike(f"^(?:{pattern})"), library).otherwise(rule)
    return out.withColumn("library", F.coalesce("_l", rule)).drop("_l")


def between_references(markers: DataFrame, positions: DataFrame, map_: str = "map", place: str = "place", name: str = "marker", kind: str = "kind") -> DataFrame:
    """Bins of a map, each between the reference markers that flank it: map, marker, kind, start_marker, end_marker, start, end.

    ``markers`` stand in the order of ``place`` in their map, of kind ref, bin or binint; others are passed over.  A bin before the first reference
    begins at 0; one after the last ends at it.  ``positions`` (map, marker, position) tells where references lie; bins with an unknown one have nulls.
    Flanking markers are found by two-level scans in both directions.
    """
    reference = F.when(F.col(kind) == "ref", F.struct(F.col(place).alias("p"), F.col(name).alias("m")))
    rows = scans.running(markers, [map_], place, reference, "max", "_left")
    back = F.when(F.col(kind) == "ref", F.struct(F.col("_p").alias("p"), F.col(name).alias("m")))
    rows = scans.running(rows.withColumn("_p", -F.col(place)), [map_], "_p", back, "max", "_right")
    bins = rows.where(F.col(kind).isin("bin", "binint")).select(map_, name, kind, F.col("_left.m").alias("start_marker"), F.coalesce("_right.m", "_left.m").alias("end_marker"))
    at = lambda c: positions.select(F.col(map_).alias("_m"), F.col(name).alias("_n"), F.col("position").alias(c))
    out = bins.join(at("start"), (F.col(map_) == F.col("_m")) & (F.col("start_marker") == F.col("_n")), "left").drop("_m", "_n")
    out = out.join(at("end"), (F.col(map_) == F.col("_m")) & (F.col("end_marker") == F.col("_n")), "left").drop("_m", "_n")
    return out.withColumn("start", F.when(F.col("start_marker").isNull(), F.lit(0).cast(dict(out.dtypes)["start"])).otherwise(F.col("start")))


def trait_places(traits: DataFrame, positions: DataFrame, trait: str = "trait", name: str = "marker") -> DataFrame:
    """Traits between two markers (``trait``, start_marker, end_marker) with their map, start and end.

    The map is that of the first marker that is known; a marker of another map counts as unknown.
    """
    at = lambda c: positions.groupBy(F.col(name).alias(f"{c}_marker")).agg(F.min(F.struct("map", "position")).alias(f"_{c}"))
    out = traits.join(at("start"), "start_marker", "left").join(at("end"), "end_marker", "left")
    on = F.coalesce("_start.map", "_end.map")
    return out.select(trait, "start_marker", "end_marker", on.alias("map"), F.col("_start.position").alias("start"), F.when(F.col("_end.map") == on, F.col("_end.position")).alias("end"))


def stacked_maps(rows: DataFrame, columns: dict[str, str], group: str, name: str, unit: float = 0.1) -> DataFrame:
    """One column of positions a map set, as (map_set, map, marker, position): names and maps in lower case, decimal commas, positions in ``unit``."""
    entries = F.array(*[F.struct(F.lit(s).alias("map_set"), F.regexp_replace(F.col(c).cast("string"), ",", ".").try_cast("double").alias("position")) for c, s in columns.items()])
    some = rows.where(F.length(F.trim(group)) > 0).select(F.lower(group).alias("map"), F.lower(F.trim(name)).alias("marker"), F.explode(entries).alias("e"))
    return some.where(F.col("e.position").isNotNull()).select("e.map_set", "map", "marker", (F.col("e.position") / unit).alias("position"))
