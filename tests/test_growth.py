"""What queries send, sort and go through on larger tables, on small ones that show it."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import alignments, genotyping, mappings, reads


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_alleles_without_shuffle(spark):
    """A read's alleles, those that substitute and insert too, are told from the read alone."""
    reads = spark.range(1).select(F.lit("a").alias("qname"), F.lit(0).alias("flag"), F.lit("1").alias("rname"), F.lit(0).alias("pos"), F.lit("3M1I2M").alias("cigar"), F.lit("ACTGTA").alias("seq"), F.array_repeat(F.lit(40), 6).alias("qual"), F.lit(30).alias("mapq"))
    reference = F.broadcast(spark.range(1).select(F.lit("1").alias("name"), F.lit("ACGTA").alias("seq")))
    got = mappings.read_alleles(reads, reference)
    assert "Exchange hashpartitioning" not in plan(got)
    assert sorted((r["pos"], r["allele"], r["kind"]) for r in got.collect()) == [(0, "A", "INVARIANT"), (1, "C", "INVARIANT"), (2, "G", "COMPLEX"), (3, "T", "INVARIANT"), (4, "A", "INVARIANT")]


def test_bases_counted_before_they_are_sent(spark, tmp_path):
    """Qualities of alleles by the order of reads where two are left or some are missing; the bases themselves aren't sorted for the others."""
    rows = []
    for ref, qualities in (("two", (50, 40, 50, 40)), ("one", (50, 50, 50)), ("pair", (50, 40)), ("gap", (50, None, 50)), ("many", (60, 50, 40, 30))):
        rows += [(f"{ref}{k}", 0, ref, 0, "1M", "T", [q], 30) for k, q in enumerate(qualities)]
    reads = spark.createDataFrame(rows, "qname string, flag int, rname string, pos int, cigar string, seq string, qual array<int>, mapq int")
    reference = spark.createDataFrame([(r, "A") for r in ("two", "one", "pair", "gap", "many")], "name string, seq string")
    want = {"two": 50 + (40 + 50) / 4, "one": 50 + 100 / 4, "pair": 50 + 40 / 4, "gap": 50 + (0 + 50) / 4, "many": 60 + 90 / 4}
    kept = lambda df: df.checkpoint()
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    for how in (None, kept):
        assert {r["rname"]: r["quality"] for r in mappings.call_variants(reads, reference, min_quality=1, checkpoint=how).collect()} == pytest.approx(want)
    got = mappings.call_variants(reads.where("rname in ('one', 'many')"), reference, min_quality=1, checkpoint=kept)
    assert got.count() == 2 and "read_pos" not in plan(got)


class Frames:
    """Stands in for a table: runs what is mapped over one frame."""

    def __init__(self, a, b):
        self.part, self.dtypes = pd.DataFrame({"a": a, "b": b}), [("a", "string"), ("b", "string")]

    def mapInPandas(self, run, schema):
        return pd.concat(run([self.part]))


def test_alignment_groups(monkeypatch):
    """Grouping goes through the pairs once, and pairs of which one text holds the other aren't aligned cell by cell."""
    calls = [0]

    def counted(x):
        calls[0] += 1
        return len(x)

    monkeypatch.setattr(alignments, "len", counted, raising=False)
    n = 1_000
    got = alignments.local_alignments(Frames(["ACT"] * n, ["AGT"] * n), "a", "b")
    assert got["score"].tolist() == [3.0] * n and calls[0] < 100 * n
    rng = random.Random(3)
    text = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    pairs = [(text(rng.randint(1, 8)), text(rng.randint(1, 8))) for _ in range(2_000)]
    held = [(p, q) for p, q in pairs if p in q or q in p]
    want = [alignments.align([p], [q])[0] for p, q in held]
    assert len(held) > 100 and [alignments.contained(p, q) for p, q in held] == want
    monkeypatch.setattr(alignments, "align", lambda *a: pytest.fail("aligned"))
    got = alignments.local_alignments(Frames(*map(list, zip(*held))), "a", "b")
    assert got[["score", "a_start", "b_start", "aligned_a", "aligned_b"]].values.tolist() == [list(w) for w in want]


def test_masked_in_pieces(spark):
    """No letter is compared with all segments, and pieces fit together."""
    rng = random.Random(4)
    rows = [(None, [(0, 2)]), ("ACG", None)]
    for n in (0, 1, 511, 512, 513, 16_383, 16_384, 16_385, 40_000):
        spans = [(a, a + rng.choice([-1, 0, 3, 600])) for a in (rng.randint(-3, n + 3) for _ in range(40))]
        rows.append(("".join(rng.choice("ACGT\nΣé") for _ in range(n)), spans))
    df = spark.createDataFrame(rows, "seq string, spans array<struct<start:int,end:int>>")
    got = df.withColumn("got", reads.mask_text(F.col("seq"), F.col("spans")))
    assert "exists(" not in plan(got)
    for seq, spans, text in got.collect():
        inside = {k for a, b in spans or [] for k in range(a, b + 1)}
        assert text == (None if seq is None else "".join(c.lower() if k in inside else c for k, c in enumerate(seq)))


def test_called_reads_are_kept_narrow(spark):
    """Bases of called alleles are sent and kept without what blocks don't use."""
    reads_ = spark.range(3).select(F.col("id").cast("string").alias("qname"), F.lit(0).alias("flag"), F.lit("1").alias("rname"), F.lit(0).alias("pos"), F.lit("3M").alias("cigar"), F.lit("ATG").alias("seq"), F.array_repeat(F.lit(40), 3).alias("qual"), F.lit(30).alias("mapq"))
    kept = []
    genotyping.genotyped_blocks(reads_, spark.range(1).select(F.lit("1").alias("name"), F.lit("ACG").alias("seq")), checkpoint=lambda df: kept.append(df.columns) or df)
    assert {"rname", "pos", "allele", "kind", "q", "qname", "read_pos"} in map(set, kept) and not any("mapq" in c for c in kept)
