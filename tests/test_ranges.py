"""Records of several lines by byte ranges, local alignments and symmetric DUST, against plain Python."""

import random

import numpy as np
import pytest

from strandline.operators import alignments, reads
from strandline.sources import ranges


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng, d = random.Random(3), tmp_path_factory.mktemp("records")
    rows = []
    for k in range(40):
        n = rng.randint(1, 60)
        rows.append((f"r{k}", "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("@+IJ!#", k=n))))
    text = "".join(f"@{n} d {n}\n{s}\n+{n * (k % 2)}\n{q}\n" for k, (n, s, q) in enumerate(rows))
    (d / "a.fq").write_text(text + "@bad\nACGT\n+\nII\n\n")
    (d / "b.fq").write_text(text.replace("@r", "@x") + "@short\nAC\n")
    (d / "a.fa").write_text("junk\n" + "".join(f">{n} some text\n{s[:20]}\n{s[20:]}\n" for n, s, _ in rows))
    flat = [f'LOCUS       g{k}   60 bp\nDEFINITION  a thing\n            of two lines\nACCESSION   AC{k}\nFEATURES             Location/Qualifiers\n     source          1..60\n                     /organism="x"\n     CDS             join(1..5,\n                     7..9)\nORIGIN\n        1 acgtacgtac {r[1].lower()}\n//\n' for k, r in enumerate(rows)]
    (d / "a.gb").write_text("".join(flat))
    (d / "a.embl").write_text("".join(f"ID   e{k}; SV 1; linear\nAC   X{k};\nDE   one\nDE   two\nFT   CDS             1..9\nSQ   Sequence 60 BP;\n     {r[1].lower()}        60\n//\n" for k, r in enumerate(rows)))
    return d, rows


@pytest.mark.parametrize("size", ["128m", "700b", "60b"])
def test_records_by_ranges(spark, files, size):
    d, rows = files
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        sound, odd = ranges.read_fastq(spark, f"{d}/*.fq")
        want = [(n, s, [ord(c) - 33 for c in q]) for n, s, q in rows]
        assert sorted((r["name"], r["seq"], r["qual"]) for r in sound.collect()) == sorted(want + [("x" + n[1:], s, q) for n, s, q in want])
        assert sorted((r["lines"][0], r["reason"]) for r in odd.collect()) == [("@bad", "lengths differ"), ("@short", "cut short")]
        assert sorted((r["name"], r["description"], r["seq"]) for r in ranges.read_fasta(spark, f"{d}/a.fa").collect()) == sorted((n, "some text", s) for n, s, _ in rows)
        got = {r["name"]: (r["accession"], r["description"], r["seq"], [tuple(f) for f in r["features"]]) for r in ranges.read_flat(spark, f"{d}/a.gb").collect()}
        assert got == {f"g{k}": (f"AC{k}", "a thing of two lines", "ACGTACGTAC" + r[1], [("source", "1..60"), ("CDS", "join(1..5,")]) for k, r in enumerate(rows)}
        got = {r["name"]: (r["accession"], r["description"], r["seq"], [tuple(f) for f in r["features"]]) for r in ranges.read_flat(spark, f"{d}/a.embl").collect()}
        assert got == {f"e{k}": (f"X{k}", "one two", r[1], [("CDS", "1..9")]) for k, r in enumerate(rows)}
        if size == "60b":
            assert ranges.records(spark, f"{d}/a.fq", ranges.FourLines()).rdd.getNumPartitions() > 20
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def best_score(a, b):
    """The recursion as it is defined, in tenths."""
    n, m, low = len(a), len(b), -(10**9)
    h, e, f = (np.full((n + 1, m + 1), v, np.int64) for v in (0, low, low))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i, j] = max(h[i, j - 1] - 10, e[i, j - 1] - 1)
            f[i, j] = max(h[i - 1, j] - 10, f[i - 1, j] - 1)
            h[i, j] = max(0, h[i - 1, j - 1] + (20 if a[i - 1] == b[j - 1] else -10), e[i, j], f[i, j])
    return h.max() / 10


def test_local_alignment_is_the_best(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choices("ACGT", k=rng.randint(0, 25))), "".join(rng.choices("ACGT", k=rng.randint(0, 25)))) for _ in range(120)]
    pairs += [(s, s[:9] + "TTT" + s[12:]) for s, _ in pairs[:20]] + [(None, "ACGT"), ("", ""), ("ACGTTTACG", "ACGACG")]
    rows = alignments.local_alignments(spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").repartition(3), "a", "b").collect()
    for r in rows:
        a, b = r["a"] or "", r["b"] or ""
        assert r["score"] == best_score(a, b)
        s, t = r["aligned_a"], r["aligned_b"]
        assert len(s) == len(t)
        if s:
            assert s.replace("-", "") == a[r["a_start"] : r["a_end"] + 1] and t.replace("-", "") == b[r["b_start"] : r["b_end"] + 1]
            tenths, gap = 0, None
            for x, y in zip(s, t):
                own = "a" if x == "-" else "b" if y == "-" else None
                tenths += (20 if x == y else -10) if own is None else (-1 if own == gap else -10)
                gap = own
            assert tenths / 10 == r["score"]
            assert all(a[x["a_start"] : x["a_end"] + 1] and x["a_end"] - x["a_start"] == x["b_end"] - x["b_start"] for x in r["blocks"])


def test_place_in_frame(spark):
    frame = "ATGGCTTGCAAATTTGGGTAA"
    seq = "CCCCC" + frame[:9] + frame[12:] + "CCCCCC"
    rows = spark.createDataFrame([(k, seq, frame, k) for k in range(len(seq))], "id int, seq string, dna string, position int")
    got = {r["id"]: (r["location"], r["codon_start"], r["frame_position"]) for r in alignments.place_in_frame(rows).collect()}
    assert got[0] == ("utr5", None, None) and got[5] == ("orf", 0, 0) and got[12] == ("orf", 6, 7) and got[16] == ("orf", 12, 14) and got[len(seq) - 1] == ("in utr3", None, None)


def dust(text, window, level):
    def score(i, j):
        t = [text[k : k + 3] for k in range(i, j - 1)]
        return 10 * sum(t.count(x) * (t.count(x) - 1) / 2 for x in set(t)) / (len(t) - 1) if len(t) > 1 else 0

    low = set()
    for i in range(len(text)):
        for j in range(i + 3, min(len(text), i + window)):
            if "N" not in text[i : j + 1] and score(i, j) > level and all(score(a, b) <= score(i, j) for a in range(i, j) for b in range(a + 3, j + 1)):
                low |= set(range(i, j + 1))
    return low


def test_symmetric_dust(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ACGT" if k % 2 else "AC", k=rng.randint(0, 24))) for k in range(24)] + ["A" * 14 + "N" + "CA" * 6, "ACGT", "ac" * 8]
    for text, found in zip(texts, reads.low_complexity(texts, 12, 10.0)):
        assert {p for a, b in found for p in range(a, b + 1)} == dust(text.upper(), 12, 10.0)
        assert all(x[1] + 1 < y[0] for x, y in zip(found, found[1:]))
    df = spark.createDataFrame([("x", "ACGTTGCA" + "A" * 40), ("y", None)], "name string, seq string")
    got = {r["name"]: r["mask"] for r in reads.mask_low_complexity(df).collect()}
    assert got["y"] == [] and len(got["x"]) == 1 and got["x"][0]["end"] == 47


def test_assembly_and_counts(spark, files, tmp_path):
    (tmp_path / "a.maf").write_text("CO\tc1\nNR\t4\nCS\tAC*G*\nCQ\tIJ!K!\n\\\\\nRS\tAAA\nCO\tc2\nCS\tACG\nCQ\tII\nCO\tc3\nCS\tA\n")
    assert [tuple(r)[:3] for r in ranges.read_assembly(spark, str(tmp_path / "a.maf")).collect()] == [("c1", "ACG", "IJK")]
    d, rows = files
    assert [ranges.count_records(spark, f"{d}/{f}", k) for f, k in (("a.fq", "fastq"), ("a.fa", "fasta"), ("a.gb", "genbank"), ("a.embl", "embl"))] == [len(rows) + 1, len(rows), len(rows), len(rows)]


def test_annotations_go(spark):
    from strandline.operators import annotation

    seqs = spark.createDataFrame([("a", ["GO:1"], ["x"], "text")], "name string, gos array<string>, orthologs array<string>, description string")
    features = spark.createDataFrame([("a", "snv", "PASS"), ("a", "orf", None)], "name string, ftype string, filters string")
    s, f = annotation.without_annotations(seqs, features, ["GOs", "description", "snv_filters", "orf"])
    assert tuple(s.first()) == ("a", None, ["x"], None) and [tuple(r) for r in f.collect()] == [("a", "snv", None)]
    gff = spark.createDataFrame([("feature", "gene"), ("feature", "mRNA"), ("comment", None), (None, "x")], "kind string, type string")
    assert annotation.features_of(gff, ["gene"]).count() == 3
