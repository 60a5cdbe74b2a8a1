"""Every operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import io
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import common, fingerprints, fmindex, harmonic, lloyd, mixing, neighbours, packing, pfor, setjoin, sharding, substrings, tokens, toxicity, tput, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, rank int"
WORDS = [f"w{k}" for k in range(400)]


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    texts = []
    passage = " ".join(rng.choices(WORDS, k=45))
    for k in range(n):
        words = rng.choices(WORDS, k=rng.choice([1, 2, 3, 8, 40, 120]))
        t = " ".join(words)
        if k % 7 == 0 and texts:
            t = rng.choice(texts) or "x"
        elif k % 5 == 0 and texts:
            w = (rng.choice(texts) or "x y").split()
            w[rng.randrange(len(w))] = "edit"
            t = "  ".join(w)
        elif k % 9 == 0:
            t = f"{t}\n{passage} {t.upper()}"
        texts.append(t)
    texts += [None, "", "   \t", "é" * 50, "rep " * 300, " ".join(rng.choices(WORDS, k=30_000))]
    return [(k, t, "en", f"s{k % 3}" if k % 4 else None, len(t or ""), 0.5, "x", 1) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SHAPE).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_folds_and_buckets_take_few_copies():
    """An executor's workers have little room beside its JVM: a fold's asks take less than 10 times its text (once 13.6 here), a bucket's answers less than 8.2 times what it gets (once 9.0)."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 200_000, 500)).encode() for _ in range(800)]
    texts += texts[:50]
    size = sum(map(len, texts))
    setjoin._asks(0, [1], [1], texts[:1], 5, 4)
    tracemalloc.start()
    rows = setjoin._asks(7, list(range(len(texts))), list(range(len(texts))), texts, 5, 1)
    asked = tracemalloc.get_traced_memory()[1]
    part = pd.DataFrame(rows, columns=["bucket", "fold", "kind", "a", "b", "c", "e"])
    got = sum(len(x) for r in rows for x in r if isinstance(x, bytes))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    answers = setjoin._answers(part)
    answered = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert asked < 10 * size and answered < 8.2 * got
    # Against sets of shingles: which are held by several texts, and how many.
    sets = {s.tobytes(): s & setjoin._MASK for s in setjoin.shingle_sets(texts, 5)}
    count = Counter(x for s in sets.values() for x in s.tolist())
    many = answers[answers["kind"] == setjoin._MANY]
    found = dict(zip(setjoin._from_six(many["a"]).tolist(), np.frombuffer(b"".join(many["c"]), np.uint32).tolist()))
    assert found == {x: n for x, n in count.items() if n > 1}


def test_local_tables_start_no_workers(spark):
    rows = [("a", 1, 0.5), (None, None, None)]
    out = common.local(spark, rows, "s string, n long, x double")
    assert [tuple(r) for r in out.collect()] == rows and out.dtypes == [("s", "string"), ("n", "bigint"), ("x", "double")]
    assert "RDD" not in out._jdf.queryExecution().toString()
    none = common.local(spark, [], "s string, n long")
    assert none.columns == ["s", "n"] and none.count() == 0 and "RDD" not in none._jdf.queryExecution().toString()


def test_local_tables_of_toxicity_and_mixing(spark, tmp_path, monkeypatch):
    """No list goes through createDataFrame's Python rows, for which executors would hold a second kind of workers."""
    rows = [(k, f"you idiot {k}" if k % 3 == 0 else f"fine words {k}", f"s{k % 2}") for k in range(60)]
    common.local(spark, rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/d")
    common.local(spark, [(k, int(k % 3 == 0)) for k in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/l")
    docs, labels = spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/l")
    whole = type(spark).createDataFrame

    def arrow_only(self, data, *args, **named):
        assert isinstance(data, pa.Table)
        return whole(self, data, *args, **named)

    monkeypatch.setattr(type(spark), "createDataFrame", arrow_only)
    assert toxicity.fit(docs, labels).voters() and mixing.mixed(docs).count() == 60


# 1


def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(1)
    y = (rng.random(3000) < 0.2).astype(int)
    votes = np.stack([np.where(rng.random(3000) < a, y, rng.random(3000) < 0.1) for a in (0.9, 0.9, 0.5, 0.0)], 1).astype(float)
    votes = np.concatenate((votes, votes[:, :1]), 1)  # a voter that repeats another
    # The rates that tell the classes apart come from 200 rows.
    given = y[:200]
    fire1, fire0 = (given @ votes[:200] + 0.5) / (given.sum() + 1), ((1 - given) @ votes[:200] + 0.5) / ((1 - given).sum() + 1)
    q, says = toxicity.label_model(votes, fire1, fire0, 0.2)
    assert ((q > 0.5) == y).mean() > 0.95
    assert says["share"][0] < 0.6 and says["share"][0] < says["share"][1] and says["share"][3] > 0.9
    assert abs(says["fires_on_toxic"][0] - 0.9) < 0.05


def test_label_model_takes_no_row_s_label():
    texts = ["plain words here " * 5] * 60 + ["idiot zuraka words moron " * 3] * 20
    wrong = [0] * 60 + [1] * 19 + [0]
    model = toxicity.fit_texts(texts, wrong, ["idiot zuraka moron"] * 20)
    # The mislabelled row scores like its like: its own label isn't its class.
    assert model.score(texts[-1]) == model.score(texts[-2]) > 0.5 > model.score(texts[0])
    assert model.accuracies["agreement"] == 79 / 80


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        w = rng.choices(WORDS, k=60)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(60), rng.choice(["idiot", "zuraka", "zurimo", "zuroto"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    rows += [(600, None), (601, ""), (602, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = toxicity.fit(docs, spark.createDataFrame(labels[:400] + [(None, 1), (5, None), (3, 0)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 603
    assert np.mean([(got[k] >= 0.3) == bool(t) for k, t in labels[400:]]) > 0.97
    assert got[600] == got[601] < 0.3


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    texts = ["plain words here " * 5] * 60 + ["idiot zuraka words moron " * 3] * 20
    docs = spark.createDataFrame(list(enumerate(texts + ["idiot zuraka moron"] * 5)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= 60)) for k in range(80)], "doc_id long, toxic int")
    want = toxicity.fit_texts(texts, [0] * 60 + [1] * 20, ["idiot zuraka moron"] * 5)
    monkeypatch.setattr(toxicity, "_mine", None)  # the driver's; workers import their own
    got = toxicity.fit(docs, labels)
    assert got.starts == want.starts and np.array_equal(got.weights, want.weights)
    assert not len(toxicity.fit(docs.where("doc_id < 0"), labels).weights)


def test_toxicity_without_labels(spark, docs):
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(docs, model).count() == docs.count()
    assert model.score("you are an idiot and a moron") > 0.3 > model.score("good day")


def test_toxicity_gate_loses_no_match():
    model = toxicity.Model(starts=[])
    texts = ["fuk", "ffukk", "f*k", "f@ck", "f#k", "fuuckk", "shiit", "shhit", "sh11t", "ssh!t", "sh*tt", "bitch", "b1tch", "b!tches", "b*tch"]
    at = len(model.starts) + 1 + 4
    assert [t for t in texts if model.features(f"so {t} it")[at] == 0] == []


# 2


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 3000):
        ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(500, 700, n)).astype(np.uint32)
        f = io.BytesIO()
        w = pfor.Writer(f)
        for k, part in enumerate(np.split(ids, sorted(rng.integers(0, n + 1, 3)))):
            w.add(None if k == 2 else k, part)
        w.close()
        r = pfor.Reader(f.getvalue())
        got = list(r.documents())
        assert [g[0] for g in got] == [0, 1, None, 3]
        assert (np.concatenate([g[2] for g in got]) == ids).all()
        assert (r.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all()
    with pytest.raises(ValueError):
        pfor.Reader(bytes([f.getvalue()[0] ^ 1]) + f.getvalue()[1:])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    e = tokens.Encoder(public_tokenizers.path(name))
    texts = ["", " ", "a  b", "It's 'll X'D\n\n y\t", "<|endoftext|> z", "“quoted” naïve ² İ", "A b c. d-e 12³", " lead", "trail ", "\n\n", "x\n y \n z", "日本 語"]
    texts += [t for _, t, *_ in corpus(4, 60) if t]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == want
    assert [x.tolist() for _, some in tokens.chunks(texts, 50) for x in e.encode(some)] == want


def test_encoders_go_with_their_operator():
    path = public_tokenizers.path("word_bpe_49k.json")
    e = tokens.encoder(path, 10)
    tokens.released()
    assert tokens.encoder(path, 10) is e
    common.released()  # another operator's task
    assert tokens.encoder(path, 10) is not e


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_asks_once(name):
    """A chunk of several texts is looked up once, and full caches forget no piece that they hold."""
    e = tokens.Encoder(public_tokenizers.path(name), 4)
    asked, ask = [], e._ask
    e._ask = lambda pieces, together, into: asked.extend(pieces) or ask(pieces, together, into)
    first, more = ["alpha beta. Gamma-delta"] * 3, ["beta epsilon", "zeta eta theta iota, kappa"]
    for texts in (first[:1], more, first, more[::-1] + ["alpha"]):
        assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    e = tokens.Encoder(public_tokenizers.path(name), 4)
    e.encode(["one two"])
    e.encode(["three four five six seven"])
    asked.clear()
    e._ask = lambda pieces, together, into: asked.extend(pieces)
    assert len(e.encode(["one two", "one two two"])[1]) and not asked


def test_ids_files(spark, docs, none):
    tok = public_tokenizers.path("byte_bpe_50k.json")
    path = common.new_dir(spark, "ids")
    pfor.write(docs, path, tok)
    e, at = tokens.Encoder(tok), 0
    got = pfor.read(spark, path).orderBy("doc_id").collect()
    for r, (k, t, *_) in zip(got, corpus(), strict=True):
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (k, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    path = common.new_dir(spark, "ids")
    pfor.write(none, path, tok)
    assert pfor.read(spark, path).count() == 0


# 3


def test_fingerprints(spark, docs):
    rows = fingerprints.edited(docs).select("doc_id", "text", "edited", fingerprints.sketch(F.col("text")).alias("a"), fingerprints.sketch(F.col("edited")).alias("b"))
    a, b = F.col("a"), F.col("b")
    got = {r["doc_id"]: r for r in rows.select("*", fingerprints.resemblance(a, b).alias("j"), fingerprints.containment(a, b).alias("c"), fingerprints.distinct_shingles(a).alias("n"), F.size(fingerprints.merge(a, b)).alias("m")).collect()}
    data = {k: t or "" for k, t, *_ in corpus()}
    order = sorted(data, reverse=True)
    for i, k in enumerate(order):
        t, nxt = data[k], data[order[(i + 1) % len(order)]]
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        assert got[k]["edited"] == edited

        def shingles(x):
            w = split(x)
            return {tuple(w)} if 0 < len(w) < 5 else set(zip(*[w[j:] for j in range(5)]))

        x, y = shingles(t), shingles(edited)
        j = len(x & y) / len(x | y) if x | y else 1.0
        assert abs(got[k]["j"] - j) < (1e-9 if max(len(x), len(y)) < 64 else 0.17)
        assert abs(got[k]["c"] - (len(x & y) / len(x) if x else 1.0)) < (1e-9 if max(len(x), len(y)) < 64 else 0.25)
        assert got[k]["n"] == len(x) if len(x) < 128 else abs(got[k]["n"] / len(x) - 1) < 0.4
        assert got[k]["m"] <= 128


def test_fingerprints_repeats_and_one(spark, none):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words"), (2, None)], "doc_id long, text string")
    assert fingerprints.edited(d).count() == 4
    one = fingerprints.edited(d.where("doc_id = 2")).collect()
    assert len(one) == 1 and one[0]["edited"] == ""


# 4


@pytest.mark.parametrize("shards", [3, 24])
def test_sharding(spark, docs, none, shards):
    got = sharding.sharded(docs, shards).collect()
    data = {k: t or "" for k, t, *_ in corpus()}
    assert sorted(r["doc_id"] for r in got) == sorted(data)
    assert all(r["size"] == len(data[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(data[r["doc_id"]].encode()) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(len(by[s]) for s in range(shards)) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    where = defaultdict(set)
    for r in got:
        where[data[r["doc_id"]]].add(r["shard"])
    assert sum(len(v) > 1 for v in where.values()) <= shards
    assert sharding.sharded(none, shards).count() == 0


def test_sharding_hot_group(spark):
    d = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.sharded(d, 10).groupBy("shard").agg(F.count("*").alias("n"), F.sum((F.col("size") == 12).cast("int")).alias("hot")).collect()
    assert {r["n"] for r in got} == {100}
    assert sum(r["hot"] > 0 for r in got) <= 8


@pytest.mark.parametrize("kind", ["hot third", "pairs", "hot third and pairs"])
def test_sharding_leaves_no_group_split(spark, kind):
    n, shards = 4800, 24
    k = F.col("id")
    group = {"hot third": F.when(k < 1600, "hot").when(k < 3200, F.concat(F.lit("g"), k % 200)), "pairs": F.concat(F.lit("p"), k % 2400), "hot third and pairs": F.when(k < 1600, "hot").otherwise(F.concat(F.lit("p"), k % 1600))}[kind]
    d = spark.range(n).select((k * 7919 % n).alias("doc_id"), F.coalesce(group, k.cast("string")).alias("text"))
    got = sharding.sharded(d, shards).join(d.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d"))
    assert {r["count"] for r in got.groupBy("shard").count().collect()} == {n // shards}
    split = got.where("text <> 'hot'").groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1")
    # One group a cut at most.
    assert split.count() < shards


def test_sharding_swaps():
    asked = [{"src": 0, "dst": 1, "gain": 4, "rows": 6}, {"src": 1, "dst": 0, "gain": 4, "rows": 3}]
    assert sharding._grants(asked, [10, 10], 10) == [(0, 1, 4, 0.5), (1, 0, 4, 1.0)]


# 5


def components(rows, n, num, den):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for k, t, *_ in rows:
        w = split((t or "").translate(fold))
        sets[k] = {tuple(w)} if 0 < len(w) < n else set(zip(*[w[j:] for j in range(n)]))
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (2, 50)])
def test_set_join(spark, docs, n, num):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.joined(docs, n, num, 100).collect()}
    assert got == components(corpus(), n, num, 100)


def near_copies():
    rng = random.Random(5)
    rows = []
    for base in (rng.choices(WORDS, k=60), rng.choices(WORDS, k=64)):
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(60)] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
    return rows


def test_set_join_groups_and_blocks(spark, none, monkeypatch):
    rows = near_copies()
    d = spark.createDataFrame(rows + [(None, "a b c d"), (None, None), (None, rows[0][1])], "doc_id long, text string")
    monkeypatch.setattr(setjoin, "BLOCK", 4)  # many blocks of a list
    monkeypatch.setattr(setjoin, "MEET", 2_000)
    monkeypatch.setattr(setjoin, "FOLD", 3_000)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    for num in (90, 80):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.joined(d, 3, num, 100).collect()}
        assert got.pop(None)[1] is None
        assert got == components(rows, 3, num, 100)
    assert setjoin.joined(none, 3, 90, 100).count() == 0


def test_set_join_forms_no_pair_that_answers_rule_out(spark):
    entries = spark.createDataFrame([(7, k, 100, 0) for k in (1, 2, 3)], "token long, node long, size long, pos long")
    answers = spark.createDataFrame([(1, 9, 100, 100, 95, True), (2, 9, 100, 100, 60, False), (3, 9, 100, 100, 95, True)], "x long, y long, sx long, sy long, i long, linked boolean")
    for known, want in ((None, {(1, 2), (1, 3), (2, 3)}), (answers, {(1, 3)})):
        blocks = setjoin.blocks_of(entries, None, known)
        assert {(r["x"], r["y"]) for r in setjoin.candidates(blocks, 80, 100).collect()} == want


def test_set_join_forms_no_pair_that_sketches_rule_out(spark):
    # Every set shares 80 shingles with all others, in other places of its prefix; 1 and 2 alone are linked.
    rng = random.Random(3)
    common_, more = [[rng.randrange(1 << 48) for _ in range(n)] for n in (80, 15)]
    sets = [(k, 100, [*common_, *(more if k < 3 else []), *(rng.randrange(1 << 48) for _ in range(5 if k < 3 else 20))]) for k in range(1, 60)]
    truth = {(x, y) for x, _, a in sets for y, _, b in sets if x < y and 190 * len({*a} & {*b}) >= 90 * 200}
    sets = spark.createDataFrame(sets, "node long, size long, tokens array<long>")
    entries = spark.createDataFrame([(7, k, 100, 0) for k in range(1, 60)], "token long, node long, size long, pos long")
    pairs = [{(r["x"], r["y"]) for r in setjoin.candidates(setjoin.blocks_of(entries, None, None, s), 90, 100).collect()} for s in (None, sets)]
    assert len(pairs[0]) == 59 * 58 // 2
    assert truth == {(1, 2)} and truth <= pairs[1] and len(pairs[1]) < 20


def test_set_join_skips_blocks_and_derives_answers(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 4)
    d = spark.createDataFrame(near_copies(), "doc_id long, text string")
    _, sets = setjoin.folded(d, 3, 80, 100)
    entries = setjoin.entries_of(sets, 80, 100)
    answers = setjoin.verified(setjoin.leading(entries, None, None, 80, 100), sets, 80, 100)
    alone = common.components(answers.where("false").select("x", "y"), "x", "y")
    blocks = setjoin.blocks_of(entries, alone)
    every = blocks.groupBy("token").count().selectExpr("sum(count * (count + 1) / 2)").first()[0]
    assert 0 < setjoin.block_pairs(blocks, 80, 100).count() < every
    cand = setjoin.candidates(blocks, 80, 100)
    says = setjoin.derived(cand, answers, 80, 100)
    tokens_ = {r["node"]: set(r["tokens"]) for r in sets.collect()}
    counts = Counter()
    for r in says.collect():
        i = len(tokens_[r["x"]] & tokens_[r["y"]])
        counts[r["says"]] += 1
        assert r["says"] in (None, 180 * i >= 80 * (r["sx"] + r["sy"]))
    assert counts[True] and counts[False]
    # What bounds don't decide follows from the leader's answer; no pair is counted anew but those without a common leader.
    open_ = says.where("says is null and leader is not null").count()
    stepped = setjoin.increments(common.stored(says, "says"), sets, 80, 100).collect()
    sizes = {r["node"]: r["size"] for r in sets.collect()}
    assert len(stepped) == open_ > 0
    for r in stepped:
        assert r["linked"] == (180 * len(tokens_[r["x"]] & tokens_[r["y"]]) >= 80 * (sizes[r["x"]] + sizes[r["y"]]))
    # No link is skipped.
    found = {(r["x"], r["y"]) for r in cand.collect()}
    sizes = {r["node"]: r["size"] for r in sets.collect()}
    for x in sizes:
        for y in sizes:
            if x < y and 180 * len(tokens_[x] & tokens_[y]) >= 80 * (sizes[x] + sizes[y]):
                assert (x, y) in found


def test_set_join_with_repeated_ids(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(rng.choices(WORDS, k=30)) for _ in range(3))
    rows = [(1, a), (2, b), (1, b), (3, a), (4, c), (4, None), (5, ""), (None, c), (None, b), (6, c + " end")]
    for parts in (1, 3, 7):
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in setjoin.joined(d, 3, 90, 100).collect()), key=str)
        want = [(1, 28, 1), (2, 28, 1), (1, 28, 1), (3, 28, 1), (4, 28, 4), (4, 0, 4), (5, 0, 5), (0, 28, None), (0, 28, None), (6, 29, 4)]
        assert got == sorted(want, key=str)


def test_components(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(k, 300) for k in range(200, 230)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(90)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    for hot in (2000, 3):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}


# 6


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 12))
    x[100:400] = x[100]  # many ties
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    bad = [(2000, None), (2001, [0.0] * 12), (2002, [1.0] * 11 + [None]), (2003, [float("nan")] * 12), (2004, [1.0, 2.0]), (None, [1.0] * 12)]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(d, F.col("id") % 20 == 0, k=20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    s = x @ x.T
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in [r[1] for r in rows]
        assert all(abs(r[2] - s[q, r[1]]) < 1e-9 for r in rows)
        assert [(-round(r[2], 9), r[1]) for r in rows] == sorted((-round(r[2], 9), r[1]) for r in rows)
        want = sorted((-round(v, 9), k) for k, v in enumerate(s[q]) if k != q)[:20]
        hits += len({k for _, k in want} & {r[1] for r in rows})
    assert hits / (20 * len(got)) > 0.95
    assert neighbours.nearest(d.where("vec_id = 40"), F.lit(True), k=20).count() == 0
    assert neighbours.nearest(d.limit(0), F.lit(True), k=20).count() == 0
    assert neighbours.nearest(d.where("vec_id in (40, 60)"), F.lit(True), k=20).count() == 2


def test_neighbours_on_several_cells(spark):
    rng = np.random.default_rng(18)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 1200)] + 0.4 * rng.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[600:900] = x[600] + 1e-3 * rng.normal(size=(300, 16))  # a cell that is dealt to several shards
    d = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    s, hits = x @ x.T, 0
    got = defaultdict(set)
    for r in neighbours.nearest(d, F.col("id") % 20 == 0, k=10, shard=100, probes=5).collect():
        got[r["query_id"]].add(r["vec_id"])
    for q in range(0, 1200, 20):
        hits += len(got[q] & set(sorted((k for k in range(1200) if k != q), key=lambda k: (-s[q, k], k))[:10]))
    assert hits / (10 * len(got)) > 0.95


@pytest.mark.parametrize("shard", [300, 60])
def test_neighbours_without_clusters(spark, shard):
    """On vectors without clusters so many cells are searched that recall stays."""
    x = np.random.default_rng(8).normal(size=(900, 24))
    d = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got, s, hits = defaultdict(set), x @ x.T, 0
    for r in neighbours.nearest(d, F.col("id") % 20 == 0, k=10, shard=shard).collect():
        got[r["query_id"]].add(r["vec_id"])
    for q in range(0, 900, 20):
        hits += len(got[q] & set(sorted((k for k in range(900) if k != q), key=lambda k: (-s[q, k], k))[:10]))
    assert hits / (10 * len(got)) > 0.95


@pytest.mark.parametrize("kind", ["lengths", "outliers", "near copies", "positive", "sparse", "large"])
def test_neighbours_on_odd_rows(spark, kind):
    """Lengths of many sizes, few very long vectors, near copies, a common direction: recall stays."""
    rng = np.random.default_rng(28)
    x = rng.normal(size=(1000, 24))
    if kind == "lengths":
        x *= np.exp(1.5 * rng.normal(size=1000))[:, None]
    elif kind == "outliers":
        x[:3] *= 1e4
    elif kind == "near copies":
        x[500:] = x[0] + 1e-4 * rng.normal(size=(500, 24))
    elif kind == "positive":
        x = np.abs(x)
    elif kind == "sparse":
        x = np.where(rng.random(x.shape) < 0.1, x, 0.0)
        x[~x.any(1), 0] = 1
    else:
        x *= 1e30
    d = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got, s, hits = defaultdict(set), x @ x.T, 0
    np.fill_diagonal(s, -np.inf)
    for r in neighbours.nearest(d, F.col("id") % 20 == 0, k=20).collect():
        got[r["query_id"]].add(r["vec_id"])
    for q in range(0, 1000, 20):
        assert len(got[q]) == 20
        hits += sum(s[q, k] >= np.sort(s[q])[-20] for k in got[q])
    assert hits / 1000 > 0.95


# 7


def test_packing_plans():
    rng = np.random.default_rng(9)
    for lengths, slack in ((rng.integers(1, 65, 300), 1.05), (np.full(50, 33), 1), (np.full(64, 1), 1), (rng.integers(20, 45, 200), 1.2), (np.array([], int), 1)):
        plan = packing.solve(Counter(map(int, lengths)), 64)
        assert all(sum(b) <= 64 for _, b in plan)
        got = Counter()
        for m, b in plan:
            for v in b:
                got[v] += m
        assert got == Counter(map(int, lengths))
        bins = sum(m for m, _ in plan)
        bound = max(-(-int(lengths.sum()) // 64), int((lengths > 32).sum()))
        assert bins <= max(bound, sum(m for m, _ in packing.best_fit(Counter(map(int, lengths)), 64))) and bins <= slack * bound + 1


def fewest(items, capacity):
    """The optimum by exhaustive search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room + items[i] <= capacity:
                j = bins.index(room)
                put(i + 1, [*bins[:j], room + items[i], *bins[j + 1 :]])
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("lengths", [[330 + (7 * k) % 41 for k in range(800)], [284 + (k * k) % 260 for k in range(400)], [333] * 5000 + [334] * 4000, [1100 + (13 * k) % 1000 for k in range(3000)]])
def test_packing_search_ends(lengths):
    """Lengths whose bound isn't met, or of which very many sums are dominated."""
    import time

    counts, report, began = Counter(lengths), {}, time.process_time()
    plan = packing.solve(counts, report=report)
    assert time.process_time() - began < 10
    held = Counter()
    for m, bin_ in plan:
        assert sum(bin_) <= packing.CAPACITY
        for x in bin_:
            held[x] += m
    assert held == counts and report["completed"] and report["bound"] <= report["bins"] <= report["best_fit"]


def test_packing_search_shares_its_tables():
    """A table of sums for each of 1,000 lengths at each of 64 levels would be tens of MB."""
    left = np.ones(4097, np.int64)
    left[1001:] = 0
    search = packing.fillings(left, 4000, 0)
    assert next(search).total() > 2
    reach = search.gi_frame.f_locals["reach"]
    assert len(reach) == 1000 and len({id(x) for x in reach}) < 200


def test_packing_is_optimal_on_small_cases_and_beats_best_fit():
    rng = random.Random(1)
    for _ in range(120):
        capacity = rng.choice([20, 40, 100])
        items = [rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(capacity // 6, capacity // 2) for _ in range(rng.randint(1, 11))]
        says = {}
        plan = packing.solve(Counter(items), capacity, report=says)
        assert sum((Counter(b) for m, b in plan for _ in range(m)), Counter()) == Counter(items)
        assert sum(m for m, _ in plan) == fewest(items, capacity) and says["optimal"]
    better = 0
    for _ in range(20):
        says = {}
        packing.solve(Counter(rng.randint(180, 480) for _ in range(60)), 1000, report=says)
        assert says["bins"] <= says["best_fit"] and says["completed"]
        better += says["bins"] < says["best_fit"]
    assert better >= 15


def test_packing(spark, docs, none):
    tok = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs.unionByName(docs.where("doc_id = 3")), tok, capacity=256, with_ids=True).collect()
    e = tokens.Encoder(tok)
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t, *_ in corpus():
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(by[k], key=lambda r: r["piece"])
        parts = parts[::2] if k == 3 else parts
        assert [x for r in parts for x in r["ids"]] == ids
        assert [r["start"] for r in parts] == list(range(0, len(ids), 256))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in parts)
    for v in seqs.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 256
    assert len(seqs) <= sum(r["length"] for r in rows) / 256 * 1.03 + 1
    assert packing.pack(none, tok).count() == 0


# 8


def test_archives(spark):
    rows = [(1, "u", "x"), (2, "u", "x"), (3, "v", None), (4, "v", ""), (5, "w", "é" * 9000), (6, None, "é" * 9000), (1, "u", "x")] + [(k, "u", f"<p>{k % 40}</p>") for k in range(10, 400)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for least in (0, 1):
        path = common.new_dir(spark, "warc")
        warc.write(d, path, least=least)
        got = warc.read(spark, path).collect()
        assert len(got) == len(rows)
        first = {}
        for k, _, t in rows:
            first[t or ""] = min(k, first.get(t or "", k))
        texts = {k: t or "" for k, _, t in rows}
        for r in got:
            t = texts[r["page_id"]]
            assert r["payload_bytes"] == len(t.encode()) and r["payload_digest"] == warc.digest(t.encode())
            if first[t] == r["page_id"] or len(t) < least:
                assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, t.encode())
            else:
                assert (r["record_type"], r["refers_to"]) == ("revisit", first[t])
    path = common.new_dir(spark, "warc")
    warc.write(d.limit(0), path)
    assert warc.read(spark, path).count() == 0


def test_archives_without_page_ids(spark):
    d = spark.createDataFrame([(None, "u", "same"), (None, None, "same"), (None, "v", None), (4, "w", "same"), (7, "x", "same")], "page_id long, url string, html string")
    path = common.new_dir(spark, "warc")
    warc.write(d, path)
    got = [(r["page_id"], r["uri"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(spark, path).collect()]
    want = [(None, "u", 4, "response", None), (None, "", 4, "response", None), (None, "v", 0, "response", None), (4, "w", 4, "response", None), (7, "x", 4, "revisit", 4)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_archive_reader_refuses():
    f = io.BytesIO()
    w = warc.Writer(f)
    w.add(warc._record("response", 7, "u", b"body", warc.digest(b"body"), None))
    w.close()
    assert [warc.parse(r)["payload"] for r in warc.records(io.BytesIO(f.getvalue()))] == [b"body"]
    for data in (b"", f.getvalue()[:6], f.getvalue()[:-3], b"xxxx" + f.getvalue()[4:]):
        with pytest.raises(Exception):
            list(warc.records(io.BytesIO(data)))
    good = warc._record("response", 7, "u", b"body", warc.digest(b"body"), None)
    for bad in (good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"body", b"b0dy"), good + b"x", good.replace(b"WARC-Date", b"WARC-Data")):
        with pytest.raises(ValueError):
            warc.parse(bad)


# 9


def test_targets():
    t = mixing.targets({"a": 100, "b": 100, None: 100, "c": 0})
    assert abs(sum(t.values()) - 450) < 1e-6 and t["c"] == 0 and abs(t["a"] - 450 * 3 / 7) < 1e-6
    assert mixing.targets({}) == {}


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(10)
    size = rng.integers(0, 500, 800)
    p = np.full(800, 0.37)
    done = mixing.flight(p, size, 1)
    assert ((done > 1e-9) & (done < 1 - 1e-9)).sum() <= mixing.LANDING
    assert abs(done.sum() - p.sum()) < 1e-6 and abs((done * size).sum() - (p * size).sum()) < 1e-3
    assert (mixing.land(done, size, 1e9) >= 0).all()


def test_mixing(spark, docs, none, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    more = docs.unionByName(spark.createDataFrame([(k, " ".join(WORDS[: k % 50]), "en", "hot", 0, 0.0, "", 0) for k in range(1000, 1400)], SHAPE))
    got = mixing.mixed(more).collect()
    again = mixing.mixed(more.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert len(got) == more.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    want = mixing.targets({s: sum(r["size"] for r in v) for s, v in by.items()})
    for s, v in by.items():
        assert abs(v[0]["target"] - want[s]) < 1e-6
        assert abs(sum(r["taken"] for r in v) - want[s]) <= max(r["size"] for r in v) / 2 + 1
    assert mixing.mixed(none).count() == 0


# The index of operator 10 on texts that aren't in it


def test_matching_statistics_of_foreign_texts():
    rng = np.random.default_rng(11)
    for depth in (3, 5, 8):
        for _ in range(6):
            text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 30)), 0) for _ in range(5)])
            index = fmindex.FMIndex(text, depth)
            held = {tuple(text[i : i + n]) for n in range(1, depth + 1) for i in range(len(text) - n + 1)}
            queries = [rng.integers(1, 6, rng.integers(1, 40)) for _ in range(7)]  # 4 and 5 aren't indexed
            flat, lengths = np.concatenate(queries), np.array([len(q) for q in queries])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            seen = 0
            for number, offset, have, lo, hi in index.steps(flat, starts, lengths):
                for k, o, n, a, b in zip(number, offset, have, lo, hi):
                    q = tuple(queries[k][o:].tolist())
                    longest = max((m for m in range(min(depth, len(q)) + 1) if m == 0 or q[:m] in held), default=0)
                    assert n == longest
                    if n:
                        at = sorted(index.suffixes[a:b].tolist())
                        assert at == [i for i in range(len(text)) if tuple(text[i : i + n]) == q[:n]]
                    seen += 1
            assert seen == lengths.sum()


def test_substrings_with_hot_keys_and_clashing_columns(spark, monkeypatch):
    rng = random.Random(6)
    licence = " ".join(rng.choices(WORDS, k=24))
    own = lambda k: " ".join(f"o{k}x{j}" for j in range(30))
    rows = [(k, f"{own(k)} {licence} {own(k + 100)}", 1, 2, "x", "y") for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _d int, _h int, _spans string, kept string").repartition(5)
    want = sorted((r["doc_id"], r["n_removed"], r["kept"]) for r in substrings.deduplicated(d).collect())
    assert all(n == (24 if k else 0) for k, n, _ in want)
    monkeypatch.setattr(substrings, "HOT_PLACES", 10)
    out = substrings.deduplicated(d, out=("a", "b", "c"))
    assert out.columns == [*d.columns, "a", "b", "c"]
    assert sorted((r["doc_id"], r["b"], r["c"]) for r in out.collect()) == want
    assert {(r["_d"], r["_h"], r["_spans"], r["kept"]) for r in out.collect()} == {(1, 2, "x", "y")}


# 10


def removed(rows, length):
    seen, out = {}, {}
    texts = {k: split(t) for k, t, *_ in rows}
    for k in sorted(texts):
        w = texts[k]
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if key in seen:
                gone[s : s + length] = [True] * length
            seen.setdefault(key, (k, s))
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("length", [20, 9, 3])
def test_substring_dedup(spark, docs, none, length):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.deduplicated(docs, length).collect()}
    assert got == removed(corpus(), length)
    assert substrings.deduplicated(none, length).count() == 0


def test_substring_dedup_repeated_ids(spark):
    t = " ".join(WORDS[:30])
    d = spark.createDataFrame([(1, t), (1, t), (2, t), (None, "a b")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.deduplicated(d).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 30)]


@pytest.mark.parametrize("key", [None, 1])
def test_substring_dedup_different_texts_of_one_id(spark, key):
    passage, clean, other = " ".join(WORDS[:30]), " ".join(WORDS[100:170]), " ".join(WORDS[200:230])
    # A passage that a row repeats, and one that two rows begin with, beside rows that repeat nothing.
    texts = [f"{passage} x {passage} y", clean, f"{other} one", f"{other} two"]
    d = spark.createDataFrame([(key, t) for t in texts] + [(2, f"z {clean}")], "doc_id long, text string")
    got = {r["text"]: (r["n_removed"], r["kept"]) for r in substrings.deduplicated(d).collect()}
    assert got[texts[0]] == (30, f"{passage} x y")
    assert got[clean] == (0, clean)
    assert sorted(got[t] for t in texts[2:]) in ([(0, texts[2]), (30, "two")], [(0, texts[3]), (30, "one")])
    assert got[f"z {clean}"] == (70, "z")


def test_full_bitmap_loses_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(substrings, "BITMAP_BYTES", 1)
    got = {r["doc_id"]: r["n_removed"] for r in substrings.deduplicated(docs, 20).collect()}
    assert got == {k: v[1] for k, v in removed(corpus(), 20).items()}


# Shared parts.


def test_components_of_random_pairs(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_word_hashes():
    texts = [b"", b" ", b"A b\tc", b"b" * 3_000_000 + b" c", b"a  B"]
    h, n = common.word_hashes(texts)
    assert n.tolist() == [0, 0, 3, 2, 2] and h[2] == h[4] and h[1] != h[6]
    low, _ = common.word_hashes(texts, fold_case=True)
    assert low[0] == low[5] and low[1] == low[6]
    one, _ = common.word_hashes([b"x " + b"b" * 3_000_000])
    assert one[1] == h[3]


# 11


def lloyd_by_force(rows, k, rounds, scale=256):
    import hashlib

    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], []
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [list(v) for _, v in order[:k]]
    for n in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]
        if n < rounds:
            for j in range(len(cents)):
                own = [v for (_, v), (_, c) in zip(kept, near) if c == j]
                if own:
                    cents[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i if i is not None else -1), j, d) for (i, _), (d, j) in zip(kept, near)), cents


@pytest.mark.parametrize("kind", ["clusters", "ties", "few"])
def test_centroids(spark, monkeypatch, kind):
    monkeypatch.setattr(lloyd, "SHARD", 37)
    monkeypatch.setattr(lloyd, "LEAF", 3)
    rng = np.random.default_rng(3)
    if kind == "clusters":
        v = rng.integers(0, 9, 230)[:, None] / 3 + rng.normal(0, 0.05, (230, 64))
    elif kind == "ties":
        v = rng.integers(0, 2, (150, 64)) * (np.arange(64) < 3)
    else:
        v = rng.normal(0, 1, (3, 64))
    rows = [(k, [float(np.float32(x)) for x in r]) for k, r in enumerate(v)]
    rows += [rows[0], (rows[1][0], rows[2][1]), (None, rows[1][1]), (900, None), (901, rows[0][1][:63]), (902, [*rows[0][1][:63], None]), (903, [*rows[0][1][:63], float("nan")]), (904, [*rows[0][1][:63], float("inf")]), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).repartition(3)
    want, cents = lloyd_by_force(rows, 12, 3)
    out = lloyd.clustered(df, k=12, rounds=3).collect()
    assert sorted(((r["vec_id"] if r["vec_id"] is not None else -1), r["cluster"], r["distance"]) for r in out) == want
    total = sum(d for _, _, d in want)
    for r in out:
        assert r["centroid"] == cents[r["cluster"]] and r["inertia"] == total and r["cluster_inertia"] == sum(d for _, j, d in want if j == r["cluster"])
    assert lloyd.clustered(df.where("vec_id > 900")).count() == 0


def test_centroid_trees_prune(monkeypatch):
    rng = np.random.default_rng(1)
    group = rng.integers(0, 20, 3000)
    x = (group[:, None] * 300 + rng.integers(0, 20, (3000, 64))).astype(np.int64)
    t = lloyd.CoverTree(x)
    for node in range(len(t.lo)):
        own = t.x[t.lo[node] : t.hi[node]]
        assert np.sqrt(lloyd.squared(own, np.broadcast_to(t.x[t.centre[node]], own.shape)).max()) <= t.radius[node] + 1e-9
        if t.fan[node]:
            below = range(t.first[node], t.first[node] + t.fan[node])
            assert t.lo[below[0]] == t.lo[node] and t.hi[below[-1]] == t.hi[node] and t.centre[below[0]] == t.centre[node]
            # Children lie apart at least as far as they cover.
            c = t.x[t.centre[list(below)]]
            apart = min(np.sqrt(lloyd.squared(c[a : a + 1], c[b : b + 1])[0]) for a in range(len(c)) for b in range(a))
            assert apart >= max(t.radius[list(below)]) - 1e-9
    c, seen = x[np.unique(group, return_index=True)[1]], {}
    label = lloyd.assigned(t, lloyd.Centroids(c), seen)
    d = ((t.x[:, None].astype(float) - c[None]) ** 2).sum(2)
    assert (label == d.argmin(1)).all() and seen["whole"] > 2500 and seen["pairs"] < 3000 * 20 / 4


# 12


def ranked_by_force(docs, items, k):
    import math

    terms = lambda t: [re.sub("[A-Z]+", lambda m: m.group().lower(), x) for x in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(x for _, b, _ in bags for x in b)
    out = []
    for item, text in sorted(set(items), key=str):
        want = set(terms(text))
        scores = []
        for d, b, n in bags:
            m = 50 + (50 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * b[x]) // (1000 * b[x] + 20 * m)) for x in want & b.keys())
            if s > 0:
                scores.append((-s, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_search(spark, none, monkeypatch):
    monkeypatch.setattr(tput, "PART", 20)
    monkeypatch.setattr(tput, "ADDED", 50)
    rng = random.Random(7)
    rows = corpus(4, 200)
    rows += [(500 + k, "É na-Ïve " * k + "W1 w2, w3", "en", "s", 0, 0.1, "y", 2) for k in range(4)] + [rows[3], rows[3], (rows[5][0], "other w7 words", *rows[5][2:])]
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.randint(1, 30)))) for k in range(12)] + [(20, None), (21, "..."), (22, "É NA, w1"), (22, "É NA, w1"), (23, "nowhere"), (24, rows[8][1])]
    asked = spark.createDataFrame(items, "item_id int, text string").withColumn("rank", F.lit("x"))
    want = ranked_by_force([(r[0], r[1]) for r in rows], items, 7)
    pick = lambda df: sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    assert pick(tput.ranked(docs, asked, k=7)) == want
    # With more terms than tasks hold, more rows than are broadcast and many blocks of queries, the results are the same.
    monkeypatch.setattr(tput, "HELD_TERMS", 5)
    monkeypatch.setattr(tput, "BEST", 20)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100)
    assert pick(tput.ranked(docs, asked, k=7)) == want
    monkeypatch.undo()
    assert tput.ranked(none, asked).count() == 0 and tput.ranked(docs, asked.limit(0)).count() == 0


# 13


@pytest.mark.parametrize("slack", [32, 128, 512])
def test_harmonic_cuts(slack):
    for n, parts in enumerate(harmonic.cuts(slack=slack)):
        assert sum(parts) == n and all((2048 - 2048 // t * t) * slack <= 2048 for t in parts)
    assert max(map(len, harmonic.cuts())) <= 4


@pytest.mark.parametrize("merge", [None, 1])
def test_harmonic(spark, docs, none, monkeypatch, merge):
    path, end = public_tokenizers.path("byte_bpe_50k.json"), 1
    if merge:
        monkeypatch.setattr(harmonic, "MERGE", merge)  # workers take over little, in several levels
    out = harmonic.pack(docs.withColumn("length", F.lit("x")), path, end_id=end, with_ids=True).collect()
    encoder = tokens.Encoder(path)
    want = {r[0]: np.append(encoder.encode([r[1] or ""])[0], end).astype("<u4") for r in corpus()}
    got, bins = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
        got[r["doc_id"]].append((r["start"], ids))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got.keys() == want.keys()
    for d, parts in got.items():
        assert np.array_equal(np.concatenate([x for _, x in sorted(parts, key=lambda p: p[0])]), want[d])
        assert [s for s, _ in sorted(parts, key=lambda p: p[0])] == np.cumsum([0, *[len(x) for _, x in sorted(parts, key=lambda p: p[0])]])[:-1].tolist()
    padded = total = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    assert padded <= total / 128
    assert harmonic.pack(none, path).count() == 0
    assert harmonic.pack(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")), path).select("doc_id").distinct().collect()[0][0] is None
