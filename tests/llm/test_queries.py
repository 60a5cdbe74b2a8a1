"""Every registered query, through queries(), on tables with odd rows, against brute force; and the pipeline's stages on their own input."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import SHAPE, components, corpus, lloyd_by_force, ranked_by_force, removed, split

import __spark_entry__
from strandline.llm import tokens, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402

QUERIES = __spark_entry__.queries()


def rows_():
    rows = corpus(11, 90)
    rng = random.Random(1)
    for k in range(0, 90, 6):
        rows[k] = (k, f"{rows[k][1]} idiot moron {rng.choice(['scum', 'loser'])} idiot", *rows[k][2:])
    return rows + [(2000, None, None, None, None, None, None, None), (2001, "𝔘𝔫𝔦 " * 30 + "end", "xx", "z", 1, 0.1, "k", 3)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows_(), SHAPE).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 == 0), 1) for k in range(90)] + [(None, 1, 0), (5, None, None)], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.3, (140, 64))
    v[7] = v[3]
    vectors = [(k, [float(np.float32(x)) for x in r]) for k, r in enumerate(v)] + [(500, None), (501, [0.0] * 64), (502, [1.0] * 63 + [None]), (503, [1.0] * 63 + [float("nan")]), (504, [0.1, 0.2])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).write.parquet(f"{d}/embeddings.parquet")
    pages = [(k, f"http://x/{k}", h) for k, h in enumerate(["<p>a</p>", "", None, "<p>a</p>", "é" * 5000, "", "last"])] + [(None, None, "<p>a</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    items = [(k, " ".join(random.Random(k).choices([f"w{j}" for j in range(400)], k=12))) for k in range(5)] + [(5, None), (6, "")]
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {"vectors": vectors, "pages": pages, "items": items}


def held_out(k):
    return zlib.crc32(str(k).encode()) % 4 == 2


def test_op1(spark, tables, tmp_path):
    d, _ = tables
    got = {r["doc_id"]: r for r in QUERIES["op1_toxicity"](spark, d).collect()}
    assert got.keys() == {r[0] for r in rows_()}
    for k, r in got.items():
        assert r["held_out"] == held_out(k) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    # Labels of rows that are held out change nothing.
    for t in ("documents",):
        spark.read.parquet(f"{d}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    again = {r["doc_id"]: r["score"] for r in QUERIES["op1_toxicity"](spark, str(tmp_path)).collect()}
    assert again == {k: r["score"] for k, r in got.items()}
    assert np.mean([got[k]["predicted"] == (k % 6 == 0) for k in range(90)]) > 0.9


def test_label_model_is_the_enumerated_posterior():
    """With few voters that depend on nothing but the class, the posterior is that of all rows' likelihoods."""
    rng = np.random.default_rng(4)
    y = (rng.random(4000) < 0.3).astype(int)
    on, off = np.array([0.9, 0.8, 0.7]), np.array([0.05, 0.1, 0.2])
    votes = (rng.random((4000, 3)) < np.where(y[:, None] == 1, on, off)).astype(float)
    q, _ = toxicity.label_model(votes, on, off, 0.3)
    for pattern in itertools.product((0.0, 1.0), repeat=3):
        p = np.array(pattern)
        like = [np.prod(np.where(p == 1, r, 1 - r)) for r in (off, on)]
        want = 0.3 * like[1] / (0.3 * like[1] + 0.7 * like[0])
        at = (votes == p).all(1)
        if at.sum() > 30:
            assert abs(q[at].mean() - want) < 0.08 and np.ptp(q[at]) < 1e-9


def ids_of(name, end):
    encoder = tokens.Encoder(public_tokenizers.path(name))
    return {r[0]: np.append(encoder.encode([r[1] or ""])[0], end).astype("<u4") for r in rows_()}


def test_op2(spark, tables):
    want, at = ids_of("byte_bpe_50k.json", 0), 0
    got = {r["doc_id"]: r for r in QUERIES["op2_token_ids"](spark, tables[0]).collect()}
    for k in sorted(want):
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(want[k]), zlib.crc32(want[k].tobytes()))
        at += len(want[k])


def test_op3(spark, tables):
    data = {r[0]: r[1] or "" for r in rows_()}
    order = sorted(data, reverse=True)
    got = {r["doc_id"]: r for r in QUERIES["op3_fingerprints"](spark, tables[0]).collect()}
    by_text = defaultdict(set)
    for i, k in enumerate(order):
        t, nxt = data[k], data[order[(i + 1) % len(order)]]
        m = len(t) // 3
        r = got[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and (t != nxt or r["near_next"] == 1)
        assert (r["fingerprint"] == r["edited_fingerprint"]) <= (r["near_edited"] == 1)
        by_text[t].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_op4(spark, tables):
    data = {r[0]: r[1] for r in rows_()}
    got = QUERIES["op4_sharding"](spark, tables[0]).collect()
    slots = defaultdict(list)
    for r in got:
        body = (data[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 8, zlib.crc32(body), "rows", None)
        slots[r["shard"]].append(r["slot"])
    n = [len(slots[k]) for k in range(24)]
    assert sum(n) == len(data) and max(n) - min(n) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op5(spark, tables):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op5_ngram_jaccard"](spark, tables[0]).collect()}
    assert got == components(rows_(), 3, 90, 100)


def test_op6(spark, tables):
    sound = {k: np.array(v, float) for k, v in tables[1]["vectors"] if k < 500}
    got = defaultdict(list)
    for r in QUERIES["op6_neighbours"](spark, tables[0]).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == {k for k in sound if k % 20 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {k for _, k, _ in found}
        assert all(abs(s - sound[q] @ sound[k]) < 1e-12 for _, k, s in found)
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
        hits += len({k for _, k, _ in found} & set(sorted((k for k in sound if k != q), key=lambda k: (-(sound[q] @ sound[k]), k))[:20]))
    assert hits / (20 * len(got)) > 0.97


@pytest.mark.parametrize("name,file,capacity", [("op7_packing", "word_bpe_49k.json", 4096), ("op13_harmonic", "byte_bpe_50k.json", 2048)])
def test_packings(spark, tables, name, file, capacity):
    want = ids_of(file, 1)
    got, bins = defaultdict(list), defaultdict(list)
    for r in QUERIES[name](spark, tables[0]).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        if name == "op7_packing":
            assert r["start"] == r["piece"] * capacity and (r["length"] == capacity or r["start"] + r["length"] == len(want[r["doc_id"]]))
        else:
            assert r["doc_tokens"] == len(want[r["doc_id"]])
    assert got.keys() == want.keys()
    for k, parts in got.items():
        at = 0
        for s, n, crc in sorted(parts):
            assert s == at and zlib.crc32(want[k][s : s + n].tobytes()) == crc
            at += n
        assert at == len(want[k])
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity


def test_op8(spark, tables):
    body = {k: (h or "").encode() for k, _, h in tables[1]["pages"]}
    got = {r["page_id"]: r for r in QUERIES["op8_warc"](spark, tables[0]).collect()}
    assert got.keys() == body.keys()
    for k, b in body.items():
        first = min((j for j in body if j is not None and body[j] == b), default=None)
        r = got[k]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        if k is not None:
            assert (r["record_type"], r["refers_to"]) == (("response", None) if first == k else ("revisit", first))


def test_op9(spark, tables):
    got = {r["doc_id"]: r for r in QUERIES["op9_mixing"](spark, tables[0]).collect()}
    sizes, sources = {r[0]: len(split(r[1])) for r in rows_()}, {r[0]: r[3] for r in rows_()}
    total = Counter()
    for k, n in sizes.items():
        total[sources[k]] += n
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[j % 3] for j, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.discard(s)
    taken = Counter()
    for k, r in got.items():
        assert r["size"] == sizes[k] and r["source_size"] == total[sources[k]] and abs(r["target"] - target[sources[k]]) < 1e-6 * max(1, target[sources[k]]) and 0 <= r["taken"] <= 2 * sizes[k]
        taken[sources[k]] += r["taken"]
    # Near: what one document holds at most.
    largest = {s: max((n for k, n in sizes.items() if sources[k] == s), default=0) for s in names}
    assert all(abs(taken[s] - target[s]) <= max(largest[s], 1) for s in names)
    assert {r["doc_id"]: r["taken"] for r in QUERIES["op9_mixing"](spark, tables[0]).collect()} == {k: r["taken"] for k, r in got.items()}


def test_op10(spark, tables):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op10_substring_dedup"](spark, tables[0]).collect()}
    assert got == {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, (n, m, t) in removed(rows_(), 20).items()}


def test_op11(spark, tables):
    want, cents = lloyd_by_force(tables[1]["vectors"], 40, 5)
    out = QUERIES["op11_centroids"](spark, tables[0]).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in out) == want
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest() for r in out)


def test_op12(spark, tables):
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in QUERIES["op12_search"](spark, tables[0]).collect())
    assert got == ranked_by_force([(r[0], r[1]) for r in rows_()], tables[1]["items"], 50)


def test_stages_against_brute_force(spark, tables):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    clean = {r[0] for r in P.reject_toxic(spark, docs, d).collect()}
    assert {k for k in range(90) if k % 6} <= clean and len([k for k in range(0, 90, 6) if k in clean]) <= 2
    roots = components(rows_(), 5, 80, 100)
    two = P.keep_one_of_each_group(spark, docs, d)
    assert two.columns == names and sorted(r[0] for r in two.collect()) == sorted(k for k, (n, root) in roots.items() if root == k or not n)
    three = P.remove_repeated_passages(spark, docs, d)
    want = {k: t for k, (n, m, t) in removed(rows_(), 20).items() if m and m < n} | {r[0]: r[1] for r in rows_() if not removed(rows_(), 20)[r[0]][1]}
    assert three.columns == names and {r["doc_id"]: r["text"] for r in three.collect()} == want
    four = P.mix_to_targets(spark, docs, d)
    taken = {r["doc_id"]: r["taken"] for r in QUERIES["op9_mixing"](spark, d).collect()}
    copies = Counter(r["doc_id"] for r in four.collect())
    sizes = {r[0]: len(split(r[1])) for r in rows_()}
    assert four.columns == names and all(copies[k] * sizes[k] == taken[k] for k in sizes if sizes[k])


def test_run_packs_clean_documents(spark, tables):
    d, _ = tables
    out = P.run(spark, d).collect()
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        assert sum(n for _, n in parts) <= 4096 and [o for o, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist()
    assert len({r["doc_id"] for r in out} & set(range(0, 90, 6))) <= 2
