"""Unique names with two writers at a time, and lookups in indexed variant files."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from strandline.sources import indexed
from strandline.sources.registry import NamingRegistry, code_of


def test_codes(spark):
    n = [0, 1, 999_999, 1_000_000, 1_099_999, 1_100_000, 3_599_999, 3_600_000, 3_610_000, 10_359_999, 10_360_000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").select(code_of(F.col("n"))).collect()]
    assert got == ["000000", "000001", "999999", "A00000", "A99999", "B00000", "Z99999", "AA0000", "AB0000", "ZZ9999", "AAA000"]


def test_names(spark, tmp_path):
    registry = NamingRegistry(spark, f"file://{tmp_path}/names")
    registry.add_project("my_project", "my", "a test project")
    with pytest.raises(ValueError):
        registry.add_project("my_project", "my")
    items = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    ask = lambda kind, *x: {r[0]: r[1] for r in registry.allocate(items(*x), "my_project", kind).collect()}
    assert ask("EST", "b", "a", "b") == {"a": "myES000001", "b": "myES000002"}
    assert ask("transcribed_cluster", "a") == {"a": "myTC000001"}
    # Kept between registries; known names stay.
    registry = NamingRegistry(spark, f"file://{tmp_path}/names")
    assert ask("EST", "a", "c") == {"a": "myES000001", "c": "myES000003"}
    assert [(x["name"], x["feature_type"], x["project_code"]) for x in registry.commits("my_project")] == [("myES000002", "EST", "my"), ("myTC000001", "transcribed_cluster", "my"), ("myES000003", "EST", "my")]
    registry.revert("my_project", "EST")
    assert ask("EST", "d") == {"d": "myES000003"} and {r["name"] for r in registry.names("my_project", "EST").collect()} == {"a", "b", "d"}
    registry.revert("my_project", "EST")
    registry.revert("my_project", "EST")
    with pytest.raises(ValueError):
        registry.revert("my_project", "EST")
    assert ask("EST", "z") == {"z": "myES000001"}
    with pytest.raises(ValueError):
        registry.allocate(items("a"), "other", "EST")


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/names"
    NamingRegistry(spark, path).add_project("p", "pp")
    got, met = {}, threading.Barrier(2)

    def write(k):
        registry = NamingRegistry(spark, path)
        met.wait()
        for part in range(2):
            rows = spark.createDataFrame([(f"w{k}_{part}_{j}",) for j in range(20)], "name string")
            got[k, part] = {r[0]: r[1] for r in registry.allocate(rows, "p", "EST").collect()}

    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    names = [v for g in got.values() for v in g.values()]
    assert len(got) == 4 and sorted(names) == [f"ppES{k:06d}" for k in range(1, 81)]


def test_conflict(spark, tmp_path):
    registry = NamingRegistry(spark, f"file://{tmp_path}/names")
    registry._append(1, action="project", project="p", code="pp")
    from strandline.sources.registry import Conflict

    with pytest.raises(Conflict):
        registry._append(1, action="project", project="q", code="qq")
    assert registry.projects() == {"p": "pp"}


def test_indexed_lookup(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted({(f"chr{rng.randint(1, 3)}", rng.randint(1, 5000)) for _ in range(1500)})
    lines = [f"{c}\t{p}\t.\tA\tT\t{k}" for k, (c, p) in enumerate(rows)] + [f"{rows[7][0]}\t{rows[7][1]}\t.\tA\tC\tagain"]
    path = f"{tmp_path}/v"
    indexed.write_indexed(spark.createDataFrame([(x,) for x in lines], "line string").repartition(5), path, ["##fileformat=VCFv4.0", "#CHROM"], block=100)
    assert indexed.header(spark, path) == ["##fileformat=VCFv4.0", "#CHROM"]
    assert sorted(r["line"] for r in indexed._read(spark, path, [r["file"] for r in spark.read.parquet(f"{path}/index").collect()]).collect()) == sorted(lines)
    for c, p in (rows[7], rows[0], rows[-1], rows[500]):
        got = indexed.at(spark, path, c, p)
        assert len(got.inputFiles()) == 1
        assert sorted(r["line"] for r in got.collect()) == sorted(x for x in lines if x.startswith(f"{c}\t{p}\t"))
    assert indexed.at(spark, path, "chr9", 5).count() == 0
    got = indexed.between(spark, path, "chr2", 1000, 1400)
    assert sorted(r["line"] for r in got.collect()) == sorted(x for x in lines if x.split("\t")[0] == "chr2" and 1000 <= int(x.split("\t")[1]) <= 1400)
    assert len(got.inputFiles()) < spark.read.parquet(f"{path}/index").count() / 2
