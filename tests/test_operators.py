"""The operators on small literals with known results."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import alignment as A
from strandline.functions import sequence as S
from strandline.operators import hits, intervals, maps, mappings, reads, selection, statistics, variants
from strandline.plans import pipelines, registry
from strandline.sources import features, sequences, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def read(spark, seq, qual=None, **segments):
    df = spark.createDataFrame([("r", seq, qual)], "name string, seq string, qual array<int>")
    for name, spans in segments.items():
        df = df.withColumn(name, F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in spans]))
    return df


def seqs(df):
    return [r["seq"] for r in df.collect()]


def test_quality_trimming(spark):
    def trimmed(qual, *a, seq=None, **k):
        df = read(spark, seq or "a" * len(qual), qual)
        return reads.trim_and_mask(reads.trim_quality(df, *a, **k)).collect()

    q = [20, 20, 20, 60, 60, 60, 60, 60, 20, 20, 20, 20]
    assert trimmed(q, 40, min_bases=3, min_length=2, window=1, seq="ataataataata")[0]["seq"] == "ataat"
    assert trimmed([0] * 12, 40) == []
    got = trimmed([1] * 5 + [40] * 15 + [1] * 10, 20, window=1, min_length=2, only_3_end=True)
    assert len(got[0]["seq"]) == len(got[0]["qual"]) < 30 and got[0]["qual"][0] == 1


def test_trim_and_mask(spark):
    s = "GGGTCTCATCATCAGGG"
    assert seqs(reads.trim_and_mask(read(spark, s, vector_trim=[(0, 3), (8, 12)]))) == ["CTCA"]
    assert seqs(reads.trim_and_mask(read(spark, s, vector_trim=[(0, 0), (8, 12)], mask=[(0, 3), (5, 6)]))) == ["ggtCtcA"]
    assert seqs(reads.trim_and_mask(read(spark, s, vector_trim=[(3, 5)]), keep_5=True)) == ["GGG"]
    assert seqs(reads.trim_and_mask(read(spark, s, vector_trim=[(0, 16)]))) == []
    assert seqs(reads.trim_and_mask(read(spark, "ATGTGATGATGATA", mask=[(0, 5), (9, 14)]))) == ["atgtgaTGAtgata"]
    for left, right, want in ((3, 3, "tctcatcatca"), (1, 2, "ggtctcatcatcag"), (10, 0, "atcaggg")):
        assert seqs(reads.trim_and_mask(reads.trim_edges(read(spark, s.lower()), left, right))) == [want]
    assert seqs(reads.trim_and_mask(reads.mask_words(read(spark, "ATCATCATCATCA"), ["CA"]))) == ["ATcaTcaTcaTca"]
    assert sorted(seqs(reads.split_masked(read(spark, "AATTaatAATTAATtctcTTCtctctctctctcGCGCGCGCGCCC"), 5))) == ["AATTAAT", "GCGCGCGCGCCC"]


def test_pipeline_steps(spark):
    df = read(spark, "acgt" * 20, [40] * 80)
    assert seqs(pipelines.clean(df, "solexa")) == ["ACGT" * 20]
    with pytest.raises(ValueError):
        pipelines.run(df, pipelines.PIPELINES["solexa"], {"nothing": {}})


def test_scalars(spark):
    assert one(spark, S.reverse_complement(F.lit("AACm"))) == "kGTT"
    assert one(spark, S.to_colour_space(F.lit("AACGN"))) == "A013."
    assert one(spark, S.iupac_code(F.array(F.lit("t"), F.lit("A")))) == "W"
    assert one(spark, S.translate(F.lit("ATGTAAx"))) == "M*"
    assert one(spark, S.phred(F.lit("!I"))) == [0, 40]
    assert one(spark, A.cigar_sum(F.lit("8M2I4M1D3M"), "MIS")) == 17
    got = one(spark, A.cigar_segments(F.lit(6), F.lit("8M2I4M1D3M")))
    assert [r["ref_start"] for r in got] == [6, None, 14, 18, 19] and [r["read_start"] for r in got] == [0, 8, 10, None, 14]
    assert one(spark, A.gff_unescape(A.gff_escape(F.lit("a;b=c %")))) == "a;b=c %"


def test_intervals(spark):
    df = spark.createDataFrame([("k", 0, 10), ("k", 15, 20), ("k", 21, 22)], "k string, start long, end long")
    m = intervals.merge(df, "k")
    n = spark.createDataFrame([("k", 30), ("z", 5)], "k string, length long")
    got = sorted((r["k"], r["start"], r["end"], r["covered"]) for r in intervals.partition(m, n, "k").collect())
    assert got == [("k", 0, 10, True), ("k", 11, 14, False), ("k", 15, 22, True), ("k", 23, 29, False), ("z", 0, 4, False)]
    assert {(r["k"], r["start"], r["end"]) for r in intervals.longest_free(m, n, "k").collect()} == {("k", 23, 29), ("z", 0, 4)}


def test_hits(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (6, 7), (1, 6)], "a long, b long")
    got = {r["node"]: r["cluster"] for r in hits.clusters(pairs, checkpoint=pipelines.checkpointed).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 1, 7: 1, 4: 4, 5: 4}
    s = spark.createDataFrame([(1, "s1", 2), (1, "s2", 4), (2, "s3", 4), (2, "s4", 1)], "cluster int, name string, length int")
    assert {r["name"] for r in hits.longest_of_each(s).collect()} == {"s2", "s3"}


def test_variants(spark):
    c = spark.createDataFrame([(1, "A", "SNP", "rg1", 1), (1, "A", "SNP", "rg2", 1), (1, "A", "SNP", "rg4", 2), (1, "T", "INVARIANT", "rg1", 1), (1, "T", "INVARIANT", "rg3", 2), (2, "A", "SNP", "x", 1), (2, "T", "SNP", "x", 2), (3, "A", "SNP", "x", 250), (3, "T", "SNP", "x", 150)], "snv_id int, allele string, kind string, rg string, n int")
    got = {r["snv_id"]: r for r in variants.measures(c).collect()}
    assert round(got[1]["pic"], 2) == 0.49 and round(got[1]["heterozygosity"], 2) == 0.53
    assert got[2]["pic"] is None and round(got[3]["heterozygosity"], 2) == 0.47
    v = spark.createDataFrame([(k, "r", p, p + 1, 6) for k, p in enumerate((1, 4, 6))], "snv_id int, ref string, start int, end int, ref_len int")
    assert [r["h"] for r in variants.high_variable_region(v, 0.25, 6, out="h").orderBy("snv_id").collect()] == [False, True, False]
    assert [r["h"] for r in variants.high_variable_region(v, 0.4, out="h").orderBy("snv_id").collect()] == [True] * 3
    assert [r["c"] for r in variants.close_to_limit(v, 2, out="c").orderBy("snv_id").collect()] == [True, False, True]


def test_statistics(spark):
    x = spark.createDataFrame([(v,) for v in (3, 5, 7, 7)], "x int")
    assert statistics.quartiles(x, "x").first()["median"] == 6
    h = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 4, 4, 5, 6, 7, 8, 9, 10)], "x int")
    assert [r["n"] for r in statistics.histogram(h, "x", 5, integers=True).orderBy("bin").collect()] == [2, 2, 4, 2, 3]


def test_formats(spark, tmp_path):
    d = str(tmp_path)
    df = spark.createDataFrame([("a", "first one", "ACGT", [40, 31, 2, 0]), ("b", None, "GG", [31, 31])], "name string, description string, seq string, qual array<int>").coalesce(1)
    sequences.write_fasta(df, f"{d}/fa")
    sequences.write_fastq(df, f"{d}/fq")
    sequences.write_qual(df, f"{d}/q")
    assert sorted((r["name"], r["description"], r["seq"]) for r in sequences.read_fasta(spark, f"{d}/fa").collect()) == [("a", "first one", "ACGT"), ("b", None, "GG")]
    assert sorted((r["name"], r["seq"], r["qual"]) for r in sequences.read_fastq(spark, f"{d}/fq").collect()) == [("a", "ACGT", [40, 31, 2, 0]), ("b", "GG", [31, 31])]
    assert {r["name"]: r["qual"] for r in sequences.read_fasta_with_qual(spark, f"{d}/fa", f"{d}/q").collect()} == {"a": [40, 31, 2, 0], "b": [31, 31]}
    assert sequences.guess_format(spark, f"{d}/fa") == "fasta" and sequences.guess_format(spark, f"{d}/q") == "qual"
    g = spark.createDataFrame([("##gff-version 3",), ("c1\tx\tgene\t1\t9\t.\t+\t.\tID=g1;Note=a%2Cb,c",)], "value string")
    g.coalesce(1).write.text(f"{d}/gff")
    got = features.read_gff(spark, f"{d}/gff")
    features.write_gff(got.coalesce(1), f"{d}/gff2")
    row = [r for r in features.read_gff(spark, f"{d}/gff2").collect() if r["kind"] == "feature"][0]
    assert row["attributes"] == {"ID": ["g1"], "Note": ["a,b", "c"]} and (row["start"], row["end"]) == (1, 9)
    sam = "@RG\tID:r1\tPL:454\tLB:l\tSM:s\nq1\t0\tref\t1\t60\t4M\t*\t0\t0\tACGT\tIIII\tRG:Z:r1\tNM:i:0\nq2\t0\tref\t1\t60\t4M\t*\t0\t0\tAAGT\tIIII\tRG:Z:r1\nq3\t0\tref\t1\t60\t4M\t*\t0\t0\tAAGT\tIIII\nq4\t4\t*\t0\t0\t*\t*\t0\t0\tAA\tII"
    (tmp_path / "x.sam").write_text(sam)
    reads_ = features.read_sam(spark, f"{d}/x.sam")
    assert features.read_groups(spark, f"{d}/x.sam").first()["pl"] == "454"
    assert mappings.flag_statistics(reads_).first()["mapped"] == 3
    ref = spark.createDataFrame([("ref", "ACGT")], "name string, seq string")
    called = {(r["pos"], r["allele"], r["kind"], r["reads"]) for r in mappings.call_variants(reads_, ref, min_quality=45, min_reads=1).collect()}
    assert called == {(1, "A", "SNP", 2)}  # the reference's allele is below the quality
    called = {(r["pos"], r["allele"], r["kind"], r["reads"]) for r in mappings.call_variants(reads_, ref, min_quality=40, min_reads=1).collect()}
    assert called == {(1, "A", "SNP", 2), (1, "C", "INVARIANT", 1)}


def test_tabular_hits(spark, tmp_path):
    rows = ["q1\ts1\t98.0\t50\t1\t0\t1\t50\t11\t60\t1e-20\t90", "q1\ts2\t90.0\t40\t4\t0\t1\t40\t40\t1\t1e-10\t60", "q1\ts1\t91.0\t20\t2\t0\t61\t80\t101\t120\t1e-5\t30"]
    (tmp_path / "b.tab").write_text("# made by hand\n" + "\n".join(rows) + "\n")
    got = features.read_blast_tab(spark, str(tmp_path / "b.tab"))
    assert sorted((r["match_rank"], r["part_rank"], r["subject"], r["q_start"], r["s_start"], r["s_end"], r["s_strand"]) for r in got.collect()) == [(1, 1, "s1", 0, 10, 59, 1), (1, 2, "s1", 60, 100, 119, 1), (2, 1, "s2", 0, 0, 39, -1)]
    m = {r["subject"]: (r["start"], r["end"], r["expect"], r["parts"]) for r in hits.matches(got).collect()}
    assert m == {"s1": (0, 79, 1e-20, 2), "s2": (0, 39, 1e-10, 1)}
    (tmp_path / "c.tab").write_text(rows[0] + "\t70\t200\n")
    assert [(r["q_len"], r["s_len"]) for r in features.read_blast_tab(spark, str(tmp_path / "c.tab")).collect()] == [(70, 200)]


BLAST = """BLASTN 2.2

Query= q1 first read

Length=120

> s1 a subject
Length=300

 Score = 90.5 bits (48), Expect = 2e-20
 Identities = 49/50 (98%), Gaps = 0/50 (0%)
 Strand=Plus/Minus

Query  11   ACGTACGTAC  20
            ||||||||||
Sbjct  110  ACGTACGTAC  101

Query  21   ACGT  24
            ||||
Sbjct  100  ACGT  97

 Score = 30.0 bits (16), Expect = e-05
 Identities = 18/20 (90%), Gaps = 0/20 (0%)
 Strand=Plus/Plus

Query  61  ACGT  64
Sbjct  5   ACGT  8

Query= q2
Length=40

***** No hits found *****
"""


def test_text_hits(spark, tmp_path):
    (tmp_path / "b.txt").write_text(BLAST)
    got = [tuple(r) for r in features.read_blast_text(spark, str(tmp_path / "b.txt")).orderBy("part_rank").collect()]
    assert got == [("q1", 120, "s1", 300, 1, 1, 10, 23, 1, 96, 109, -1, 2e-20, 90.5, 98.0), ("q1", 120, "s1", 300, 1, 2, 60, 63, 1, 4, 7, 1, 1e-5, 30.0, 90.0)]


def test_names(spark):
    codes = {"999": "A00", "A999": "B000", "OZZZZ9": "PAAAA0", "AB09": "AB10", "A9": "B0", "ZZ": "000", "99": "A0", "AZ": "BA", "Z9": "AA"}
    df = spark.createDataFrame([(c,) for c in codes], "code string").withColumn("next", maps.next_code(F.col("code")))
    assert {r["code"]: r["next"] for r in df.collect()} == codes
    m = spark.createDataFrame([("ssr",), ("RAPD",), ("scar",), ("trait",), ("mine",)], "type string")
    got = [(r["type"], r["sofa"]) for r in maps.standard_types(m).collect()]
    assert got == [("microsatellite", "SO:0000289"), ("rapd", None), ("SNP", "SO:0000694"), ("morphological", None), ("mine", None)]
    v = spark.createDataFrame([(f"k{k % 700:04d}",) for k in range(3000)], "name string")
    known = spark.createDataFrame([("k0003", 5)], "name string, number long")
    got = {r["name"]: r["number"] for r in maps.allocate_names(v.distinct(), known, "N").collect()}
    assert got == {"k0003": 5} | {n: 6 + i for i, n in enumerate(f"k{k:04d}" for k in range(700) if k != 3)}


def test_allele_quality(spark):
    q = lambda *v: one(spark, variants.allele_quality(F.array(*[F.lit(x) for x in v])))
    assert q(40, 40, 40, 39) == 59.75 and q(40, 40) == 50 and q(30) == 30 and q(10, 20, 30) == 37.5


def aligned(spark, *rows):
    return spark.createDataFrame([(f"q{k}", 0, "r", pos, 60, cigar, seq, [q] * len(seq), pl) for k, (pos, cigar, seq, q, pl) in enumerate(rows)], "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual array<int>, pl string")


def test_variant_caller(spark):
    ref = spark.createDataFrame([("r", "ATCTGTAG")], "name string, seq string")
    reads_ = aligned(spark, (0, "8M", "ATCCGTAG", 60, "454"), (0, "6M1I2M", "ATCTGTCAG", 60, "454"), (0, "2M1D5M", "ATTGTAG", 60, "454"), (0, "4M1I4M", "ATCCAGTAG", 60, "454"))
    got = {(r["pos"], r["allele"], r["kind"]) for r in mappings.call_variants(reads_, ref, min_reads=1).collect() if r["kind"] != "INVARIANT"}
    assert got == {(3, "C", "SNP"), (5, "C", "INSERTION"), (2, "-", "DELETION"), (3, "A", "COMPLEX")}
    near = {(r["pos"], r["allele"]) for r in mappings.call_variants(reads_, ref, min_reads=1, edges={"454": (3, 3)}).collect() if r["kind"] != "INVARIANT"}
    assert near == {(3, "C"), (3, "A"), (5, "C")}
    assert mappings.call_variants(reads_, ref, min_reads=1, max_maf=0.7).where("pos <> 3").count() == 0
    assert mappings.call_variants(reads_, ref, min_reads=2).count() == 0
    long = spark.createDataFrame([("r", "A" * 1500 + "C" + "A" * 500)], "name string, seq string")
    got = mappings.call_variants(aligned(spark, (1499, "3M", "AGA", 60, None), (1499, "3M", "AGA", 60, None)), long, min_reads=1).collect()
    assert [(r["pos"], r["r"], r["allele"]) for r in got] == [(1500, "C", "G")]
    seg = A.cigar_segments(F.lit(6), F.lit("8M2I4M1D3M"))
    at = [one(spark, mappings.segment_at(seg, F.lit(p))) for p in (5, 6, 8, 13, 18)]
    assert at[0] is None and [(x["op"], x["place"], x["read_pos"]) for x in at[1:]] == [("M", "FIRST", 0), ("M", "MIDDLE", 2), ("M", "LAST", 7), ("D", "FIRST_AND_LAST", None)]
    assert one(spark, mappings.gapped_cigar(F.lit("AC-GT"), F.lit("ACTG-"))) == "2M 1I 1M 1D"
    v = spark.createDataFrame([("r", 2, "DELETION"), ("r", 5, "INSERTION")], "rname string, pos int, kind string")
    a = spark.createDataFrame([("r", 2, "--", "DELETION"), ("r", 5, "C", "INSERTION")], "rname string, pos int, allele string, kind string")
    assert {(r["pos"], r["start"], r["end"]) for r in mappings.vcf_position(v, a).collect()} == {(2, 1, 4), (5, 5, 6)}


def test_read_groups(spark):
    df = spark.createDataFrame([("q", "/x/lb_lib1.sm_s1.pl_454.sam"), ("p", "/x/lb_lib2.other.sam")], "qname string, file string")
    rows, groups = mappings.named_read_group(df, F.col("file"))
    assert {r["qname"]: r["rg"] for r in rows.collect()} == {"q": "lib1_s1_454", "p": "lib2"}
    assert {tuple(r) for r in groups.collect()} == {("lib1_s1_454", "454", "lib1", "s1"), ("lib2", None, "lib2", "lib2")}
    d = spark.createDataFrame([("a", 4, "acgu", None, "sanger", 3), ("b", 0, "ACGT", None, "454", 3)], "qname string, flag int, seq string, qual array<int>, pl string, mapq int")
    got = {r["qname"]: r for r in mappings.standardise(d, 25).collect()}
    assert got["a"]["qual"] == [25] * 4 and got["b"]["qual"] is None and got["a"]["seq"] == "ACGN" and got["a"]["mapq"] == 0


def test_filter_names(spark):
    f = selection.standard
    named = selection.filter_names([f("close_to_snv", (60,)), f("maf", (0.8,)), f("maf", (0.7, ("a", "b"), "libraries")), f("is_variable", ("libraries", ("l1",), True)), f("by_kind", ("SNP",)), f("high_variable_reg", (0.07,)), f("close_to_limit", (12,)), f("min_groups", (2, "libraries")), f("in_segment_bed", (3,)), f("uniq_contiguous")])
    assert [n for n, _ in named] == ["cs60", "maf1", "maf2", "vlb1", "vks", "HVR7", "cl12", "ml2", "is3", "UCR"]
    assert named[2][1] == "The most frequent allele in libraries: a,b. frequency greater than 0.70"
    v = spark.createDataFrame([(k, "r", p, p + 1, 200) for k, p in enumerate((1, 4, 100))], "snv_id long, ref string, start int, end int, ref_len int")
    out = selection.filter_snvs(v, [f("close_to_snv", (5,), distance=5), f("close_to_limit", (2,), distance=2)])
    assert {r["snv_id"]: r["filters"] for r in out.collect()} == {0: "CS 5;CL 2", 1: "CS 5", 2: "PASS"}
    hits_ = spark.createDataFrame([(0, "a", 0, 30, 95.0), (0, "b", 0, 30, 95.0), (1, "a", 0, 30, 95.0), (2, "a", 0, 30, 80.0)], "query long, subject string, q_start long, q_end long, similarity double")
    assert {r["snv_id"]: r["uniq_contiguous"] for r in variants.not_unique(v, hits_).collect()} == {0: True, 1: False, 2: False}


def lines(df):
    return sorted(r["line"] for r in df.collect())


def test_writers(spark, tmp_path):
    seqs = spark.createDataFrame([("s1", {"melon": ["m1", "m2"]})], "name string, orthologs map<string,array<string>>")
    assert lines(writers.ortholog_lines(seqs)) == ["melon\ts1\tm1,m2"]
    orf = spark.createDataFrame([("s1", 0, 5, "forward", "ATGTAA", "M")], "name string, start int, end int, strand string, dna string, pep string")
    assert lines(writers.orf_lines(orf)) == [">s1_orf_seq start=1 end=6 strand=forward\nATGTAA"]
    ssr = spark.createDataFrame([("s1", 9, 20, 12.0, "di", "AT")], "name string, start int, end int, score double, kind string, unit string")
    assert lines(writers.ssr_lines(ssr)) == ["s1\t10\t21\t12\t12\tdi\tAT\t6"]
    snv = spark.createDataFrame([("s", "ACGTACGT", 3, "T", ["A"])], "name string, seq string, start int, ref string, alleles array<string>")
    assert lines(writers.illumina_lines(snv, 2)) == ["s_4,SNP,CG[A/T]AC"]
    full = spark.createDataFrame([("s", 3, 4, "SNP", "T", ["A", "T"], "T", 0.5), ("s", 5, 6, "SNP", "C", ["C", "G"], "C", 0.5), ("s", 0, 1, "SNP", "A", ["A", "C"], "A", 0.9)], "name string, start int, end int, kind string, ref string, alleles array<string>, major string, maf double")
    text = spark.createDataFrame([("s", "ACGTACGT")], "name string, seq string")
    chosen = spark.createDataFrame([("s", 3)], "name string, start int")
    assert lines(writers.sequenom_lines(text, full, chosen, 4, maf=0.8)) == [">s_4\nACG[A/T]ASGT"]
    f = spark.createDataFrame([("s", "snv", 4, 4), ("s", "intron", 2, 2), ("s", "orf", 0, 5)], "name string, ftype string, start int, end int")
    g = {r["type"]: (r["start"], r["attributes"]["name"][0]) for r in writers.gff_features(text, f).collect()}
    assert g == {"region": (1, "s"), "SNV": (5, "snv1"), "intron": (3, "s.intron1"), "ORF": (1, "s.orf")}
    writers.write_all({"ssr": writers.ssr_lines(ssr).coalesce(1), "orf": writers.orf_lines(orf).coalesce(1)}, str(tmp_path / "out"), {"ssr": writers.SSR_HEADER})
    found = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "ssr")).collect()]
    assert found == [writers.SSR_HEADER, "s1\t10\t21\t12\t12\tdi\tAT\t6"]
    bins = spark.createDataFrame([(0, 0.0, 1.0, 3), (1, 1.0, 2.0, 4)], "bin long, left_edge double, right_edge double, n long")
    assert [r["line"] for r in writers.distribution_lines(bins).collect()] == ["values: 3,4", "bin_edges: 0.0,1.0,2.0"]


def test_info(spark):
    c = spark.createDataFrame([(1, "A", "r1", 3), (1, "T", "r1", 1), (1, "T", "r2", 4), (1, "C", "r3", 2)], "snv_id int, allele string, rg string, n int")
    o = spark.createDataFrame([(1, "A", 0), (1, "T", 1), (1, "C", 2)], "snv_id int, allele string, number int")
    q = spark.createDataFrame([(1, 40.0, 50.5)], "snv_id int, quality double, mapping_quality double")
    e = spark.createDataFrame([(1, ["EcoRI"])], "snv_id int, enzymes array<string>")
    assert variants.info(c, o, q, e).first()["info"] == "RC=5,2;AF=0.5,0.2;MQ=50.50;BQ=40.00;GC=1,2,1;GP=0.75;EZ=EcoRI"


def test_trim_errors(spark):
    good = [40] * 40
    out = reads.trim_and_mask(reads.trim_errors(read(spark, "A" * 20 + "C" * 40 + "G" * 20, [2] * 20 + good + [2] * 20)))
    seq = out.first()["seq"]
    assert seq == "C" * 32  # the outer four of the good bases have more than one bad one around them
    assert reads.trim_errors(read(spark, "A" * 50, [2] * 50)).count() == 0
    assert reads.trim_errors(read(spark, "A" * 50)).count() == 1


def test_quantiles(spark):
    import random

    rng = random.Random(2)
    v = [rng.randrange(60) for _ in range(500)]
    df = spark.createDataFrame([(x, x % 2) for x in v], "x int, g int")
    want = {p: df.selectExpr(f"percentile(x, {p / 100})").first()[0] for p in (0, 10, 50, 99, 100)}
    got = {r["percent"]: r["value"] for r in statistics.percentiles(df, "x", list(want)).collect()}
    assert got == pytest.approx(want)
    for r in statistics.boxplot(df, "g", "x").collect():
        assert [r["q1"], r["median"], r["q3"]] == pytest.approx(df.where(F.col("g") == r["g"]).selectExpr("percentile(x, array(0.25, 0.5, 0.75))").first()[0])


def test_allocate_all_names(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, f"Customer#{k * 7 % 20:03d}") for k in range(1, 20)]
    path = str(tmp_path / "customer.parquet")
    spark.createDataFrame(rows, "c_custkey long, c_name string").write.parquet(path)
    got = sorted(tuple(r) for r in registry.QUERIES["allocate_all_names"](spark, str(tmp_path)).collect())
    assert [name for name, _ in got] == sorted(name for _, name in rows)
    sql = registry.ORACLE["allocate_all_names"]
    assert got == sorted(duckdb.sql(f"WITH customer AS (FROM read_parquet('{path}/*.parquet')) {sql}").fetchall())
