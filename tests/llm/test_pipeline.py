"""The pipeline's stages, each on its own input, and the registered queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(0)
    words = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    passage = " ".join(rng.choices(words, k=60))
    for k in range(400):
        w = rng.choices(words, k=80)
        if k % 8 == 0:
            w[3::20] = ["idiot", "moron", "scum", "loser"]
        t = " ".join(w)
        if k % 10 == 1:
            t += " " + passage
        if k % 25 == 7:
            t = rows[-1][1] + " end"
        rows.append((k, t, "en", f"s{k % 3}", len(t)))
        labels.append((k, int(k % 8 == 0 and k % 25 != 7)))
    rows += [(400, None, None, None, None), (401, "", "en", "s0", 0)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn("score", F.lit("extra"))
    one = P.reject_toxic(spark, docs, tables)
    ids = {r[0] for r in one.select("doc_id").collect()}
    toxic = {k for k in range(400) if k % 8 == 0 and k % 25 != 7}
    assert one.columns == [*COLUMNS, "score"] and not toxic & ids and {400, 401} <= ids
    assert len(ids) >= 402 - len(toxic) - 20
    two = P.keep_one_of_each_group(spark, docs, tables)
    left = {r[0] for r in two.select("doc_id").collect()}
    assert left == set(range(402)) - {k for k in range(400) if k % 25 == 7}
    three = P.remove_repeated_passages(spark, docs, tables)
    texts = {r["doc_id"]: r["text"] for r in three.collect()}
    assert three.columns == docs.columns
    assert texts[1].endswith(" ".join(texts[1].split()[-60:])) and len(texts[1].split()) == 140
    assert all(len(texts[k].split()) == 80 for k in range(11, 400, 10) if k % 25 != 7)
    assert texts[400] is None and texts[401] == ""
    four = P.mix_to_targets(spark, docs, tables)
    assert four.columns == docs.columns and 0 < four.count() <= 2 * 402
    five = P.pack_sequences(spark, four, tables)
    assert five.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_stages_on_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_repeated_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 20")
    twice = docs.union(docs)
    assert P.keep_one_of_each_group(spark, twice, tables).count() == P.keep_one_of_each_group(spark, docs, tables).count()
    out = P.mix_to_targets(spark, twice, tables).count()
    assert 0 < out <= 80


def test_different_texts_of_one_id_and_clashing_columns(spark, tables):
    rng = random.Random(9)
    a, b = (" ".join(f"v{rng.randrange(900)}" for _ in range(60)) for _ in range(2))
    rows = [(1, a, "en", "s", 1, 7, 8, "x"), (1, b, "en", "s", 1, 7, 8, "x"), (2, a + " end", "en", "s", 1, 7, 8, "x"), (None, a, "en", "s", 1, 7, 8, "x"), (None, a, "en", "s", 1, 7, 8, "x"), (3, None, None, None, None, 7, 8, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, d int, n_words int, _key string")
    two = P.keep_one_of_each_group(spark, d, tables)
    assert two.columns == d.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in two.collect()) == sorted([(1, a), (1, b), (0, a), (0, a), (3, "")])
    for stage in (P.reject_toxic, P.remove_repeated_passages, P.mix_to_targets):
        out = stage(spark, d, tables)
        assert out.columns == d.columns and {(r["d"], r["n_words"], r["_key"]) for r in out.collect()} <= {(7, 8, "x")}


def test_run(spark, tables):
    out = P.run(spark, tables)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 100


def test_registered():
    import __spark_entry__ as e

    q = e.queries()
    names = [k for k in q if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in q
    assert set(e.oracle_sql()) <= set(q)
    assert np.all([callable(f) for f in q.values()])
