"""Records of several lines, read by byte ranges: one large file is many tasks.

Spark deals a text file by ranges of bytes.  In each range the records are found by their
first lines; what lies before a range's first record and after the last one that is
surely whole is left over.  Leftovers, a few lines a range, are put together by file, so a record on a
cut, or over several, is read once.  Files may lie in any store that Spark reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import sequence as S

_SHAPE = "file string, block long, kind int, lines array<string>"
_HEAD, _RECORD, _TAIL = range(3)
#: Records in a batch that a task hands on.
_ROWS = 2_000


class FourLines:
    """FASTQ: a header that begins with @, a sequence, a line that begins with +, and a quality of any characters.

    A quality may begin with @ or +; but two lines below it stands a sequence, which doesn't begin with +.
    """

    def first(self, lines: list[str]) -> int | None:
        """The place of the first record's first line; None if the lines don't show one."""
        return next((k for k in range(len(lines) - 2) if self._begins(lines, k)), None)

    @staticmethod
    def _begins(lines: list[str], k: int) -> bool:
        return lines[k].startswith("@") and lines[k + 2].startswith("+")

    def cut(self, lines: list[str], last: bool) -> tuple[list[list[str]], list[str]]:
        """Whole records at the beginning of ``lines``, and the lines after them; what is no record goes up to the next one."""
        out, k = [], 0
        while k + 4 <= len(lines):
            if self._begins(lines, k):
                n = 4
            else:
                n = next((j - k for j in range(k + 1, len(lines) - 2) if self._begins(lines, j)), None)
                if n is None:
                    break
            out.append(lines[k : k + n])
            k += n
        rest = lines[k:]
        return (out + [rest], []) if last and rest else (out, rest)


class Marked:
    """Records that begin with a line of a mark, as FASTA's >."""

    def __init__(self, mark: str):
        self.mark = mark

    def first(self, lines: list[str]) -> int | None:
        return next((k for k, x in enumerate(lines) if x.startswith(self.mark)), None)

    def cut(self, lines: list[str], last: bool) -> tuple[list[list[str]], list[str]]:
        starts = [k for k, x in enumerate(lines) if x.startswith(self.mark)]
        ends = [*starts[1:], len(lines)]
        records = [lines[a:b] for a, b in zip(starts, ends)]
        return (records, []) if last or not records else (records[:-1], records[-1])


class Ended:
    """Records that end with a line of a mark, as the // of flat files."""

    def __init__(self, mark: str):
        self.mark = mark

    def first(self, lines: list[str]) -> int | None:
        return next((k + 1 for k, x in enumerate(lines) if x.rstrip() == self.mark), None)

    def cut(self, lines: list[str], last: bool) -> tuple[list[list[str]], list[str]]:
        ends = [k + 1 for k, x in enumerate(lines) if x.rstrip() == self.mark]
        records = [lines[a:b] for a, b in zip([0, *ends], ends)]
        rest = lines[ends[-1] :] if ends else lines
        return (records + [rest], []) if last and any(x.strip() for x in rest) else (records, rest)


#: Lines that a range gathers before it looks for records among them.
_GATHER = 4_000


def records(spark: SparkSession, path: str, layout: FourLines | Marked | Ended, keep: Callable[[str], bool] | None = None) -> DataFrame:
    """(file, lines) of every record under ``path``; lines that ``keep`` refuses are passed over."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, held, synced, enough = None, [], False, _GATHER

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())]
            got = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["file", "block", "kind", "lines"])
            out.clear()
            return got

        def settle() -> None:
            """Part what is held; before the range's first record nothing is parted."""
            nonlocal held, synced
            if not synced:
                k = layout.first(held)
                if k is None:
                    return
                out.append((*at, _HEAD, held[:k]))
                held, synced = held[k:], True
            found, held = layout.cut(held, False)
            out.extend((*at, _RECORD, x) for x in found)

        def finish() -> None:
            nonlocal held, synced
            if at is not None:
                settle()
                out.append((*at, _TAIL if synced else _HEAD, held))
            held, synced = [], False

        for b in batches:
            for file, block, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value"))):
                if (file, block) != at:
                    finish()
                    at = (file, block)
                value = value.rstrip("\r")
                if keep is None or keep(value):
                    held.append(value)
                if len(held) >= enough:
                    settle()
                    enough = max(_GATHER, 2 * len(held))
                if len(out) >= _ROWS:
                    yield batch()
        finish()
        if out:
            yield batch()

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        """A tail and the heads of the ranges after it, in order."""
        part = part.sort_values(["block", "kind"], kind="stable")
        held = [x for some in part["lines"] for x in some]
        return pd.DataFrame({"file": part["file"].iloc[0], "lines": pd.Series(layout.cut(held, True)[0], dtype=object)})

    every = lines.mapInArrow(parted, _SHAPE)
    tails = F.sum((F.col("kind") == _TAIL).cast("int")).over(Window.partitionBy("file").orderBy("block", "kind"))
    rest = every.where(F.col("kind") != _RECORD).withColumn("stretch", tails).groupBy("file", "stretch").applyInPandas(joined, "file string, lines array<string>")
    return every.where(F.col("kind") == _RECORD).select("file", "lines").unionByName(rest)


def read_fastq(spark: SparkSession, path: str, offset: int = 33, solexa: bool = False) -> tuple[DataFrame, DataFrame]:
    """(name, description, seq, qual, file) of sound records, and (file, lines, reason) of the others.

    A record is four lines; a blank line outside of a record, at a file's end for example, is passed over with it.
    """
    rows = records(spark, path, FourLines())
    line = lambda k: F.get("lines", F.lit(k))
    blank = F.forall("lines", lambda x: F.length(F.trim(x)) == 0)
    reason = F.when(F.size("lines") < 4, "cut short").when(~line(0).startswith("@"), "no header").when(~line(2).startswith("+"), "no second header").when(F.length(line(1)) != F.length(line(3)), "lengths differ")
    rows = rows.where(~blank).withColumn("reason", reason)
    q = S.solexa_to_phred(F.transform(S.letters(line(3)), lambda c: F.ascii(c) - 64)) if solexa else S.phred(line(3), offset)
    head = F.expr("substring(lines[0], 2)")
    sound = rows.where(F.col("reason").isNull()).select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.nullif(F.trim(F.regexp_replace(head, r"^\S+", "")), F.lit("")).alias("description"), line(1).alias("seq"), q.alias("qual"), "file")
    return sound, rows.where(F.col("reason").isNotNull()).select("file", "lines", "reason")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description, seq, file; lines before a file's first record, and those that begin with #, are passed over."""
    rows = records(spark, path, Marked(">"), lambda x: not x.startswith("#")).where(F.get("lines", F.lit(0)).startswith(">"))
    head = F.trim(F.expr("substring(lines[0], 2)"))
    seq = F.array_join(F.transform(F.slice("lines", 2, F.size("lines")), lambda x: F.trim(x)), "")
    return rows.where(F.length(head) > 0).select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.nullif(F.trim(F.regexp_replace(head, r"^\S+", "")), F.lit("")).alias("description"), seq.alias("seq"), "file")


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """name, accession, description, seq, features (kind, location), file of GenBank and EMBL records."""
    rows = records(spark, path, Ended("//"))
    text = lambda x: F.array_join(x, " ")
    values = lambda tag, width: F.transform(F.filter("lines", lambda x: x.startswith(tag)), lambda x: F.trim(F.substring(x, F.lit(width), F.length(x))))
    embl = F.exists("lines", lambda x: x.rlike(r"^ID\s"))
    lines = F.col("lines")
    # GenBank: a definition goes on over indented lines up to the next keyword.
    begin = F.array_position(F.transform(lines, lambda x: x.startswith("DEFINITION")), True).cast("int")
    after = F.slice(lines, F.greatest(begin + 1, F.lit(1)), F.size(lines))
    more = F.array_position(F.transform(after, lambda x: ~x.rlike(r"^\s")), True).cast("int")
    definition = F.when(begin > 0, text(F.concat(values("DEFINITION", 11), F.transform(F.slice(after, 1, F.greatest(more - 1, F.lit(0))), lambda x: F.trim(x)))))
    mark = F.array_position(F.transform(lines, lambda x: x.rlike("^(ORIGIN|SQ )")), True).cast("int")
    letters = F.when(mark > 0, F.regexp_replace(F.array_join(F.slice(lines, F.greatest(mark + 1, F.lit(1)), F.size(lines)), ""), r"[^A-Za-z*-]", "")).otherwise("")
    feature = r"^(?:FT)? {3,5}(\S+)\s+(\S.*)$"
    table = F.when(mark > 0, F.slice(lines, 1, F.greatest(mark - 1, F.lit(0)))).otherwise(lines)
    features = F.transform(F.filter(table, lambda x: x.rlike(r"^(     |FT   )\S+\s+\S")), lambda x: F.struct(F.regexp_extract(x, feature, 1).alias("kind"), F.regexp_extract(x, feature, 2).alias("location")))
    name = F.when(embl, F.regexp_extract(F.get(values("ID", 3), F.lit(0)), r"^([^\s;]+)", 1)).otherwise(F.regexp_extract(F.get(values("LOCUS", 6), F.lit(0)), r"^(\S+)", 1))
    accession = F.when(embl, F.regexp_extract(F.get(values("AC", 3), F.lit(0)), r"^([^\s;]+)", 1)).otherwise(F.regexp_extract(F.get(values("ACCESSION", 10), F.lit(0)), r"^(\S+)", 1))
    out = rows.select(name.alias("name"), F.nullif(accession, F.lit("")).alias("accession"), F.when(embl, text(values("DE", 3))).otherwise(definition).alias("description"), F.upper(letters).alias("seq"), features.alias("features"), "file")
    return out.where(F.length("name") > 0)


def read_assembly(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, qual (text), file of the contigs of an assembly file (lines CO, CS and CQ), without gap columns.

    A column that is a gap (*) in the sequence goes from the qualities as well; contigs whose lengths differ, or without one of the lines, are left out.
    """
    rows = records(spark, path, Marked("CO"), lambda x: x[:2] in ("CO", "CS", "CQ"))
    value = lambda tag: F.get(F.transform(F.filter("lines", lambda x: x.rlike(rf"^{tag}\s")), lambda x: F.regexp_replace(x, r"^\S+\s+", "")), F.lit(0))
    rows = rows.select(F.rtrim(value("CO")).alias("name"), F.rtrim(value("CS")).alias("s"), F.rtrim(value("CQ")).alias("q"), "file").where("length(s) = length(q)")
    kept = F.filter(F.arrays_zip(S.letters(F.col("s")).alias("s"), S.letters(F.col("q")).alias("q")), lambda x: x["s"] != "*")
    text = lambda c: F.array_join(F.transform("_k", lambda x: x[c]), "")
    return rows.withColumn("_k", kept).select("name", text("s").alias("seq"), text("q").alias("qual"), "file")


def count_records(spark: SparkSession, path: str, fmt: str) -> int:
    """Records of a file: FASTA, FASTQ (bad records too), GenBank, EMBL."""
    layout = {"fasta": Marked(">"), "fastq": FourLines(), "genbank": Ended("//"), "embl": Ended("//")}
    if fmt not in layout:
        raise ValueError(f"records of {fmt} aren't counted")
    rows = records(spark, path, layout[fmt])
    return rows.where(F.exists("lines", lambda x: F.length(F.trim(x)) > 0) & ((F.lit(fmt) != "fasta") | F.get("lines", F.lit(0)).startswith(">"))).count()
