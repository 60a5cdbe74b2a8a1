"""FASTA, qualities, FASTQ, colour space and JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import alignment as A
from strandline.functions import sequence as S


def _records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """Records that begin with ``mark`` at a line's beginning, without it."""
    rows = spark.read.option("lineSep", f"\n{mark}").text(path).where(F.length(F.trim("value")) > 0)
    first = F.when(F.col("value").startswith(mark), F.expr(f"substring(value, {len(mark) + 1})")).otherwise(F.col("value"))
    return rows.select(F.col("_metadata.file_path").alias("file"), first.alias("value"))


def _named(rows: DataFrame, sep: str) -> DataFrame:
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: (F.length(F.trim(x)) > 0) & ~x.startswith("#"))
    rows = rows.withColumn("_l", lines).where(F.size("_l") > 0)
    head = F.trim(F.get("_l", F.lit(0)))
    return rows.select(
        "file", F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.nullif(F.trim(F.regexp_replace(head, r"^\S+", "")), F.lit("")).alias("description"),
        F.array_join(F.transform(F.slice("_l", 2, F.size("_l")), lambda x: F.trim(x)), sep).alias("body"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description, seq, file."""
    return _named(_records(spark, path, ">"), "").select("name", "description", F.col("body").alias("seq"), "file")


def read_qual(spark: SparkSession, path: str) -> DataFrame:
    """name, qual."""
    numbers = F.transform(F.filter(F.split("body", r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
    return _named(_records(spark, path, ">"), " ").select("name", numbers.alias("qual"))


def read_fasta_with_qual(spark: SparkSession, fasta: str, qual: str) -> DataFrame:
    """Sequences with their qualities, paired by name."""
    return read_fasta(spark, fasta).join(read_qual(spark, qual), "name")


def read_fastq(spark: SparkSession, path: str, offset: int = 33, solexa: bool = False) -> DataFrame:
    """name, description, seq, qual of four-line records.

    Lines are numbered within their file by position; a record is four of them, so the
    quality line may begin with any character.
    """
    rows = spark.read.option("lineSep", "\n@").text(path)
    # A quality line that begins with @ parts a record: rows are glued until the lengths agree.
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = rows.withColumn("raw", F.regexp_replace("value", r"\r", "")).withColumn("v", F.regexp_replace("raw", "^@", "")).withColumn("l", F.split("v", "\n"))
    w = Window.partitionBy("file").orderBy("at")
    nxt = F.lead("raw").over(w)
    whole = (F.size("l") >= 4) & (F.length(F.get("l", F.lit(1))) == F.length(F.get("l", F.lit(3))))
    glued = F.when(whole, F.col("v")).otherwise(F.concat("v", F.lit("\n@"), nxt))
    start = F.get("l", F.lit(2)).startswith("+")
    rows = rows.withColumn("g", F.split(glued, "\n")).where(start & (F.length(F.get("g", F.lit(1))) == F.length(F.get("g", F.lit(3)))))
    q = S.phred(F.get("g", F.lit(3)), offset)
    if solexa:
        q = S.solexa_to_phred(F.transform(S.letters(F.get("g", F.lit(3))), lambda c: F.ascii(c) - 64))
    head = F.get("g", F.lit(0))
    return rows.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.nullif(F.trim(F.regexp_replace(head, r"^\S+", "")), F.lit("")).alias("description"), F.get("g", F.lit(1)).alias("seq"), q.alias("qual"))


def read_csfasta(spark: SparkSession, fasta: str, qual: str | None = None) -> DataFrame:
    """Colour-space reads, double encoded without the first base and colour; negative qualities are 0."""
    seqs = read_fasta(spark, fasta).withColumn("seq", S.double_encode(F.expr("substring(seq, 3)")))
    if qual is None:
        return seqs
    q = F.transform(F.expr("slice(qual, 2, greatest(size(qual) - 1, 0))"), lambda x: F.greatest(x, F.lit(0)))
    return seqs.join(read_qual(spark, qual).withColumn("qual", q), "name")


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents parted by blank lines."""
    rows = spark.read.option("lineSep", "\n\n").text(path).where(F.length(F.trim("value")) > 0)
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def guess_format(spark: SparkSession, path: str) -> str:
    """Format by the first characters; qualities and FASTA part by what follows the first name."""
    head = [r[0] for r in spark.read.text(path).limit(2).collect()]
    first = head[0] if head else ""
    if first.startswith("{"):
        return "json"
    if first.startswith(">"):
        return "qual" if len(head) > 1 and head[1].strip()[:1].isdigit() else "fasta"
    if first.startswith("@"):
        lines = spark.read.text(path).limit(4000)
        low = lines.where(~F.col("value").rlike("^[@+]")).agg(F.min(F.array_min(F.transform(S.letters(F.col("value")), lambda c: F.ascii(c))))).first()[0]
        return "sfastq" if low is not None and low < 59 else "ifastq"
    if first.startswith("LOCUS"):
        return "genbank"
    raise ValueError(f"unknown format: {first[:40]!r}")


def read_sequences(spark: SparkSession, path: str, fmt: str | None = None, qual: str | None = None) -> DataFrame:
    fmt = fmt or guess_format(spark, path)
    if fmt == "fasta":
        return read_fasta_with_qual(spark, path, qual) if qual else read_fasta(spark, path)
    readers = {"sfastq": lambda: read_fastq(spark, path), "fastq": lambda: read_fastq(spark, path), "ifastq": lambda: read_fastq(spark, path, 64), "fastq-solexa": lambda: read_fastq(spark, path, solexa=True), "qual": lambda: read_qual(spark, path), "csfasta": lambda: read_csfasta(spark, path, qual), "parquet": lambda: spark.read.parquet(path)}
    if fmt not in readers:
        raise ValueError(f"no reader for {fmt}")
    return readers[fmt]()


def read_length_class(df: DataFrame, limit: int = 100, seq: str = "seq") -> str:
    longest = df.limit(3).agg(F.max(F.length(seq))).first()[0]
    return "short_seqs" if longest is not None and longest < limit else "long_seqs"


def count_matches(spark: SparkSession, path: str, pattern: str) -> int:
    return spark.read.text(path).agg(F.coalesce(F.sum(F.regexp_count("value", F.lit(pattern))), F.lit(0))).first()[0]


def fasta_text(name: Column, seq: Column, description: Column | None = None) -> Column:
    head = name if description is None else F.concat_ws(" ", name, description)
    return F.concat(F.lit(">"), head, F.lit("\n"), seq)


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(fasta_text(F.col("name"), F.col("seq"), F.col("description") if "description" in df.columns else None)).write.text(path)


def write_fastq(df: DataFrame, path: str, default_quality: int = 25) -> None:
    q = F.coalesce("qual", F.array_repeat(F.lit(default_quality), F.length("seq"))) if "qual" in df.columns else F.array_repeat(F.lit(default_quality), F.length("seq"))
    df.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), S.phred_text(q))).write.text(path)


def write_qual(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), "name", F.lit("\n"), F.array_join(F.transform("qual", lambda q: q.cast("string")), " "))).write.text(path)


def split_by_tag(df: DataFrame, tag: str, path: str) -> None:
    """One folder for each value of a ``key:value`` token of the description."""
    df.withColumn(tag, A.tag_value(F.col("description"), tag)).write.partitionBy(tag).parquet(path)
