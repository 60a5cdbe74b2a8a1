"""Restriction sites, nested XML by items, physical maps, bins between references, filter names and SAM lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.operators import maps, restriction, selection
from strandline.sources import nested, physical, writers


def test_automaton_finds_every_site():
    rng = random.Random(1)
    enzymes = {"a": "GANTC", "b": "GGYRCC", "c": "AGCT", "d": "GAC"}  # the last one has another form on the other strand
    automaton = restriction.Automaton(enzymes)
    for _ in range(200):
        text = "".join(rng.choices("ACGTN" if _ % 3 else "AGTC", k=60))
        want = {}
        for e, forms in {"a": ["GA[ACGT]TC"], "b": ["GG[CT][AG]CC"], "c": ["AGCT"], "d": ["GAC", "GTC"]}.items():
            at = [(m.start(), m.start() + len(m.group(1)) - 1) for f in forms for m in re.finditer(f"(?=({f}))", text)]
            if at:
                want[e] = (min(b for _, b in at), max(a for a, _ in at), len(at))
        assert automaton.find(text) == want


@pytest.mark.parametrize("piece", [7, 10_000])
def test_cap_enzymes(spark, monkeypatch, piece):
    monkeypatch.setattr(restriction, "PIECE", piece)
    cases = [
        (1, "Actgacttactgtca", 7, 7, ["C", "T"], "HinfI", True), (2, "ATGATGATGgaaattcATGATGATGTGGGAT", 10, 11, ["A", "AA"], "EcoRI", True), (3, "ATGATGATGgaattcATGATGATGTGGGAT", 10, 11, ["AA", "A"], "EcoRI", True),
        (4, "ATGATGATGgaattcATGATGATGTGGGAT", 11, 11, ["AA", "A"], "EcoRI", True), (5, "Actgacttactgtca", 7, 7, ["C"], "HinfI", False), (6, "GAATTCAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAGACTTC", 43, 43, ["A", "T"], "EcoRI", False),
    ]
    snvs = spark.createDataFrame([(k, str(k), a, b) for k, _, a, b, *_ in cases], "snv_id int, name string, start int, end int")
    alleles = spark.createDataFrame([(c[0], x) for c in cases for x in c[4]], "snv_id int, allele string")
    reference = spark.createDataFrame([(str(c[0]), c[1]) for c in cases], "name string, seq string")
    got = {r["snv_id"]: r["enzymes"] for r in restriction.cap_enzymes(snvs, alleles, reference).collect()}
    for k, seq, a, b, own, enzyme, there in cases:
        assert (enzyme in got[k]) is there
        cut = [set(restriction.Automaton(restriction.COMMON).find(seq[:a] + x + seq[b + 1 :])) for x in own]
        assert got[k] == sorted(set.union(*cut) - set.intersection(*cut))
    f = selection.standard("cap_enzymes", (False,), alleles=alleles, reference=reference)
    out = {r["snv_id"]: r["filters"] for r in selection.filter_snvs(snvs, [f]).collect()}
    assert out[5] == "CEF" and out[1] == "PASS"


def test_filter_names():
    name = lambda kind, *p: selection.filter_names([selection.Filter(kind, None, {}, p)])[0]
    assert name("in_segment_bed") == ("is0", "The snv is outside the given segments reduced in 0 bases from each edge")
    assert name("is_variable", "libraries", ["l1", "l2"], True, True, True, 0.7, 3)[1] == "It is not variable, or no data, in the libraries : l1,l2. All together: True. maf:0.700000. min_num_reads:3"
    assert name("is_not_variable", "samples", ["s"], False, True, 0.5, 2)[1].endswith("All together: False. maf:0.500000. min_num_reads:2")
    assert name("is_variable", "read_groups", ["r"], True)[0] == "vrg1"


XML = """<?xml version="1.0"?>
<results><header>x</header>
{}</results>
"""
PROTEIN = """<protein id="P{0}" length="{1}"><interpro id="IPR{0}" name="n" type="Domain"><classification id="GO:1" class_type="GO"><category>c</category></classification><classification id="GO:{0}" class_type="GO"/>
<match id="M1" name="m" dbname="D"><location start="1" end="9" score="0.1" status="T" evidence="e"/><location start="11" end="19" score="0.2" status="T" evidence="e"/></match><match id="M2" name="k" dbname="D"><location start="3" end="4" score="0.3" status="?" evidence="f"/></match></interpro></protein>
"""


@pytest.mark.parametrize("size", ["128m", "300b"])
def test_nested(spark, tmp_path, size):
    (tmp_path / "a.xml").write_text(XML.format("".join(PROTEIN.format(k, 100 + k) for k in range(7)) + '<protein id="none" length="5"></protein>'))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        rows = [tuple(r) for r in nested.read_interpro(spark, str(tmp_path / "a.xml")).collect()]
        want = [(f"P{k}", 100 + k, f"IPR{k}", "n", "Domain", ["GO:1", f"GO:{k}"], *m) for k in range(7) for m in (("M1", "m", "D", 11, 19, "0.2", "T", "e"), ("M2", "k", "D", 3, 4, "0.3", "?", "f"))]
        assert sorted(rows, key=str) == sorted([*want, ("none", 5, *[None] * 12)], key=str)
        for n in (1, 3, 100):
            pieces = nested.itemized(spark, str(tmp_path / "a.xml"), "protein", n).collect()
            assert sum(p["items"] for p in pieces) == 8 and all(p["items"] <= n for p in pieces)
            (tmp_path / f"pieces{n}{size}").mkdir()
            for k, p in enumerate(pieces):
                assert p["text"].startswith('<?xml version="1.0"?>\n<results><header>x</header>') and p["text"].endswith("</results>\n")
                (tmp_path / f"pieces{n}{size}" / f"{k}.xml").write_text(p["text"])
            again = [tuple(r) for r in nested.read_interpro(spark, str(tmp_path / f"pieces{n}{size}")).collect()]
            assert sorted(again, key=str) == sorted(rows, key=str)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


FPC = """// fpc project melon
// 8.5.1  Date: 10:00

BAC : "a1"
Map "ctg1" Ends Left 5.000
Map "ctg1" Ends Right 40.000
Exact_match_to_cosmid "b1"
Positive_SNP "m1"
Gel_number 7
Remark "one"
Remark "two"
Shotgun full done

BAC : "b1"
Map "ctg1" Ends Left 30
Map "ctg1" Ends Right 120
Positive_SNP "m1"
Positive_EST "m2"

BAC : "c1"
fpc_remark "alone"

Markerdata 2

Marker_SSR : "m1"
Anchor_bin "3b"
Anchor_pos 12.5 F

Marker_SSR : "m3"
Remark "unseen"

Contigdata 2

Ctg1 #x
Chr_remark "Chr7 [2 markers]"
User_remark "good"
Ctg2
Chr_remark "- nothing"
"""


def test_physical_map(spark, tmp_path):
    (tmp_path / "m.fpc").write_text(FPC)
    for size in ("128m", "60b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = physical.read_fpc(spark, str(tmp_path / "m.fpc"))
        clones, markers, contigs = ({r["contig" if k == "contigs" else "name"]: r for r in got[k].collect()} for k in ("clones", "markers", "contigs"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        a = clones["a1"]
        assert (a["type"], a["contig"], a["start"], a["end"], a["gel"], a["sequence_type"], a["sequence_status"], a["remark"]) == ("BAC", "1", 5, 40, "7", "full", "done", "one\ntwo")
        assert [tuple(x) for x in a["matches"]] == [("exact", "b1")] and [tuple(x) for x in a["markers"]] == [("SNP", "m1")]
        assert clones.keys() == {"a1", "b1", "c1"} and clones["c1"]["contig"] is None and clones["c1"]["fpc_remark"] == "alone"
        assert (contigs["1"]["start"], contigs["1"]["end"], contigs["1"]["clones"], contigs["1"]["markers"], contigs["1"]["group"], contigs["1"]["user_remark"]) == (5, 120, ["a1", "b1"], ["m1", "m2"], "7", "good")
        assert (contigs["2"]["group"], contigs["2"]["chr_remark"], contigs["2"]["anchor"]) == ("?", "nothing", 1)
        m = markers["m1"]
        assert (m["type"], m["group"], m["subgroup"], m["anchor"], m["position"], m["framework"], m["contigs"], m["clones"]) == ("SSR", "3", "b", 1, 12.5, 1, ["1"], ["a1", "b1"])
        assert markers["m2"]["type"] == "EST" and markers["m3"]["remark"] == "unseen" and markers["m3"]["clones"] is None


def test_bins_and_traits(spark):
    rows = [("g1", 1, "b0", "bin"), ("g1", 2, "r1", "ref"), ("g1", 3, "b1", "bin"), ("g1", 4, "b2", "binint"), ("g1", 5, "x", "other"), ("g1", 6, "r2", "ref"), ("g1", 7, "b3", "bin"), ("g2", 1, "b4", "bin")]
    markers = spark.createDataFrame(rows, "map string, place int, marker string, kind string")
    positions = spark.createDataFrame([("g1", "r1", 10.0), ("g1", "r2", 30.0), ("g2", "r9", 5.0)], "map string, marker string, position double")
    got = {r["marker"]: tuple(r)[3:] for r in maps.between_references(markers, positions).collect()}
    assert got == {"b0": (None, "r1", 0.0, 10.0), "b1": ("r1", "r2", 10.0, 30.0), "b2": ("r1", "r2", 10.0, 30.0), "b3": ("r2", "r2", 30.0, 30.0), "b4": (None, None, 0.0, None)}
    traits = spark.createDataFrame([("q1", "r1", "r2"), ("q2", "no", "r9"), ("q3", "r1", "r9"), ("q4", None, None)], "trait string, start_marker string, end_marker string")
    assert {tuple(r) for r in maps.trait_places(traits, positions).collect()} == {("q1", "r1", "r2", "g1", 10.0, 30.0), ("q2", "no", "r9", "g2", None, 5.0), ("q3", "r1", "r9", "g1", 10.0, None), ("q4", None, None, None, None, None)}
    sheet = spark.createDataFrame([("I", " M1 ", "1,5", ""), ("", "M2", "3", "4"), ("II", "m3", "x", "2")], "gl string, name string, a string, b string")
    assert {tuple(r) for r in maps.stacked_maps(sheet, {"a": "one", "b": "two"}, "gl", "name").collect()} == {("one", "i", "m1", 15.0), ("two", "ii", "m3", 20.0)}


def test_sam_lines_keep_their_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{k}", 0, "c", k, 30, "4M", "*", 0, 0, "ACGT", None) for k in range(40)], "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual array<int>").repartition(5)
    lines = writers.sam_lines(rows, spark.createDataFrame([("c", 100)], "name string, length int"))
    writers.write_lines(lines, str(tmp_path / "s"))
    files = sorted((tmp_path / "s").glob("part-*"))
    assert len(files) == 6 and files[0].read_text() == "@SQ\tSN:c\tLN:100\n"
    assert sum(len(f.read_text().splitlines()) for f in files) == 41
