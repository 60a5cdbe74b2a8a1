"""Nested documents by items: XML cut at an item's end tag by byte ranges, in pieces with the document's head and tail.

Spark parts a file at the end tag, so one large document is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What an InterPro protein holds, as attributes (with _) and elements.
INTERPRO = (
    "_id string, _length int, interpro array<struct<_id: string, _name: string, _type: string, classification: array<struct<_id: string, _class_type: string, category: string, description: string>>, "
    "match: array<struct<_id: string, _name: string, _dbname: string, location: array<struct<_start: int, _end: int, _score: string, _status: string, _evidence: string>>>>>>"
)


def _parts(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(file, block, at, before, item): every part of a document up to an end tag; ``item`` is empty after the last one."""
    rows = spark.read.option("lineSep", f"</{tag}>").text(path)
    opened = rf"(?s)<{tag}(?=[\s/>]).*$"
    item = F.regexp_extract("value", opened, 0)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value", item.alias("item"))
    before = F.left("value", F.length("value") - F.length("item"))
    return rows.select("file", "block", "at", before.alias("before"), F.when(F.col("item") != "", F.concat("item", F.lit(f"</{tag}>"))).otherwise("").alias("item"))


def items(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(file, item): every element ``tag``, which doesn't hold itself, with its tags."""
    return _parts(spark, path, tag).where("item <> ''").select("file", "item")


def itemized(spark: SparkSession, path: str, tag: str, n: int = 1) -> DataFrame:
    """(file, items, text): whole documents of ``n`` items at most, each with the head before the first and the tail behind the last item of its file.

    Items are counted within a byte range, so its last piece may hold fewer.
    """
    parts = _parts(spark, path, tag)
    has = F.col("item") != ""
    ends = parts.groupBy("file").agg(F.min_by("before", F.when(has, F.struct("block", "at"))).alias("head"), F.max(F.when(has, F.struct("block", "at"))).alias("last"))
    tail = parts.where(~has).join(ends.select("file", "last"), "file").where(F.struct("block", "at") > F.col("last"))
    tail = tail.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "before"))), lambda x: x["before"]), "").alias("tail"))
    w = Window.partitionBy("file", "block").orderBy("at")
    some = parts.where(has).withColumn("piece", F.floor((F.row_number().over(w) - 1) / n))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]), "")
    some = some.groupBy("file", "block", "piece").agg(F.count("*").alias("items"), body.alias("body"))
    out = some.join(ends.select("file", "head"), "file").join(tail, "file", "left")
    return out.select("file", "items", F.concat("head", "body", F.coalesce("tail", F.lit(""))).alias("text"))


def read_interpro(spark: SparkSession, path: str) -> DataFrame:
    """A row for each match of each protein: protein, length, interpro, interpro_name, interpro_type, gos, match, match_name, db, start, end, score, status, evidence.

    Of a match's several locations the last one is given.  Proteins without a match, and entries without one, have a row of nulls there.
    """
    p = items(spark, path, "protein").select(F.from_xml("item", INTERPRO).alias("p"))
    rows = p.select(F.col("p._id").alias("protein"), F.col("p._length").alias("length"), F.explode_outer("p.interpro").alias("i"))
    gos = F.transform(F.coalesce("i.classification", F.array().cast("array<struct<_id: string, _class_type: string, category: string, description: string>>")), lambda c: c["_id"])
    rows = rows.select("protein", "length", F.col("i._id").alias("interpro"), F.col("i._name").alias("interpro_name"), F.col("i._type").alias("interpro_type"), F.when(F.col("i").isNotNull(), gos).alias("gos"), F.explode_outer("i.match").alias("m"))
    last = F.try_element_at("m.location", F.lit(-1))
    return rows.select("protein", "length", "interpro", "interpro_name", "interpro_type", "gos", F.col("m._id").alias("match"), F.col("m._name").alias("match_name"), F.col("m._dbname").alias("db"), *[last[f"_{c}"].alias(c) for c in ("start", "end", "score", "status", "evidence")])
