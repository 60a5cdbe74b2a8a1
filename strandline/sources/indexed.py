"""Variant files in order, in compressed blocks, with an index of each block's first and last place.

A lookup reads the index, which is one row a block, and opens only the blocks that may
hold its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines in a block, about.
BLOCK = 50_000


def _place(line: Column) -> tuple[Column, Column]:
    parts = F.split(line, "\t", 3)
    return F.get(parts, F.lit(0)).alias("chrom"), F.get(parts, F.lit(1)).cast("long").alias("pos")


def write_indexed(lines: DataFrame, path: str, header: list[str] | None = None, line: str = "line", block: int = BLOCK, rows: int | None = None) -> None:
    """Lines (chromosome, position and more, tab between) as gzip blocks in order of place, and their index.

    ``rows``, if known, saves counting them.  Lines of one place stay in one block; places are dealt by sampled cut points.
    """
    spark = lines.sparkSession
    chrom, pos = _place(F.col(line))
    placed = lines.select(chrom, pos, F.col(line).alias("value"))
    n = lines.count() if rows is None else rows
    ordered = placed.repartitionByRange(max(1, -(-n // block)), "chrom", "pos").sortWithinPartitions("chrom", "pos", "value")
    ordered.select("value").write.option("compression", "gzip").text(f"{path}/blocks")
    if header:
        spark.createDataFrame([(k, h) for k, h in enumerate(header)], "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{path}/header")
    chrom, pos = _place(F.col("value"))
    place = F.struct(chrom, pos)
    found = spark.read.text(f"{path}/blocks").groupBy(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).alias("file")).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("lines"))
    found.select("file", F.col("first.chrom").alias("chrom0"), F.col("first.pos").alias("pos0"), F.col("last.chrom").alias("chrom1"), F.col("last.pos").alias("pos1"), "lines").coalesce(1).write.parquet(f"{path}/index")


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    shape = "chrom string, pos long, line string"
    if not files:
        return spark.createDataFrame([], shape)
    chrom, pos = _place(F.col("value"))
    return spark.read.text([f"{path}/blocks/{f}" for f in files]).select(chrom, pos, F.col("value").alias("line"))


def between(spark: SparkSession, path: str, chrom: str, start: int, end: int) -> DataFrame:
    """chrom, pos, line of places from ``start`` to ``end``, both included; only blocks that meet them are opened."""
    first, last = F.struct(F.col("chrom0").alias("c"), F.col("pos0").alias("p")), F.struct(F.col("chrom1").alias("c"), F.col("pos1").alias("p"))
    low, high = (F.struct(F.lit(chrom).alias("c"), F.lit(x).cast("long").alias("p")) for x in (start, end))
    files = spark.read.parquet(f"{path}/index").where((first <= high) & (last >= low)).select("file").collect()
    return _read(spark, path, sorted(r[0] for r in files)).where((F.col("chrom") == chrom) & F.col("pos").between(start, end))


def at(spark: SparkSession, path: str, chrom: str, pos: int) -> DataFrame:
    """The lines of one place."""
    return between(spark, path, chrom, pos, pos)


def header(spark: SparkSession, path: str) -> list[str]:
    return [r[0] for r in spark.read.text(f"{path}/header").collect()]
