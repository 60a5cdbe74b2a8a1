"""Exact Jaccard join of word-shingle sets by set-relation skipping, and the components of its links.

A set's name is its content's 64-bit hash, so equal sets are one node from the start.

1. Asking.  Every task folds documents and asks, of each distinct shingle in the fold,
   how many sets hold it; askers and answers meet by the shingle's hash, once for each
   fold, so that a shingle in a third of all sets is asked as often as there are folds.
   A set of which fewer than t of its shingles occur elsewhere has no partner and ends here.
2. Index lists.  A set's shingles are ordered by rarity; it is listed under those of its
   prefix that others hold.
3. Leaders.  Of each list a set of its largest component so far leads.  Every set of another component
   is compared with the leader that it meets most often; verified links alone form components.  A turn
   takes a few comparisons for each set, however large a group of near copies is; turns go on while they pay.
4. Index-level skipping.  Lists of one component are dropped.  The others are cut into
   blocks by position, each with its least position, sizes and components; pairs of headers
   are skipped on these, and only the entries of pairs that are left are read.  Sketches (parities of
   the number of shingles in each of 1,024 classes) bound an overlap from above; pairs that they rule out are not formed.
5. Answer-level skipping.  Sets x and y with computed answers for one leader L get bounds from them:
   |x & L| + |y & L| - |L| <= |x & y| <= min(|x & L| + |y - L|, |y & L| + |x - L|).
   Where the upper bound rules a link out, no pair is formed; where the lower one decides, nothing is counted.  Where they don't, the answer is derived from that of the leader:
   |x & y| = |L & y| - |(L - x) & y| + |(x - L) & y|, so that only the shingles in which x differs from its leader,
   found once for x, are looked up in y.  Pairs without a common leader are counted.

A set: distinct n-word shingles of the text with A-Z lower-cased, words being runs
without ASCII white space; a shorter text is one shingle; a text without words, or
null, is empty and linked with nothing.  Rows of one id are one node of the
components, whatever their texts; rows without an id have no links and no component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

#: Text bytes and documents that a task folds before it asks.
FOLD, FOLD_ROWS = 8_000_000, 65_000
#: Text bytes of a fold whose words are hashed together.
HASHED = 1_000_000
#: Text bytes whose shingles meet in one task, about.
MEET = 8_000_000
#: Entries in a block of an index list, about.
BLOCK = 128
#: Headers of a list whose pairs with all of the list one task forms, about.
PAIRED = 256
#: Classes of shingles whose parities tell sets apart, a power of two.
SKETCH = 1024
#: Comparing with leaders goes on while one in so many comparisons finds a link.
PAYS = 5
_MASK = np.uint64((1 << 48) - 1)
_MESSAGE = "bucket int, fold long, kind int, a binary, b binary, c binary, e binary"
_SINGLE, _MANY, _ROWS, _SETS, _HELD = range(5)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Of each text, the sorted hashes of its distinct shingles."""
    h, counts = common.word_hashes(texts, fold_case=True)
    ends = np.cumsum(counts)
    every = common.grams(h, n) if len(h) >= n else h[:0]
    out = []
    for c, e in zip(counts.tolist(), ends.tolist()):
        if c >= n:
            out.append(np.unique(every[e - c : e - n + 1]))
        elif c:
            out.append(common.mixed(common.grams(h[e - c : e], c) ^ np.uint64(0x5EED + c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _six(x: np.ndarray) -> bytes:
    """48-bit values as six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(parts) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _message(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "fold", "kind", "a", "b", "c", "e"])


def _sorted(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts ``tokens``, their distinct values, where each value begins in that order): what np.unique gives, without as many copies."""
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    first = np.ones(len(tokens), bool)
    np.not_equal(tokens[1:], tokens[:-1], out=first[1:])
    begin = np.flatnonzero(first)
    return order, tokens[begin], begin


def _asks(fold: int, ids: list, hashes: list, texts: list[bytes], n: int, buckets: int) -> list[tuple]:
    """A fold's messages: its rows and sets for itself, its distinct shingles for their buckets."""
    sets, at, held = [], 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= HASHED or k == len(texts) - 1:
            sets += shingle_sets(texts[at : k + 1], n)
            at, held = k + 1, 0
    sizes = np.array([len(s) for s in sets], np.int64)
    named = np.array([d is not None for d in ids])
    d = np.array([x or 0 for x in ids], np.int64)
    content = np.array([common.mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    # Empty sets are told apart by id, so that they equal nothing.
    content = common.mixed(np.where(sizes > 0, content, common.mixed(d.view(np.uint64) ^ np.uint64(0xE3B7))) ^ (sizes.astype(np.uint64) << np.uint64(40)))
    home = fold % buckets
    out = [(home, fold, _ROWS, d.tobytes() + named.astype(np.int64).tobytes(), np.array(hashes, np.int64).tobytes(), sizes.tobytes(), content.tobytes())]
    live = np.flatnonzero((sizes > 0) & named)
    if not len(live):
        return out
    _, one = np.unique(content[live], return_index=True)
    live = live[np.sort(one)]
    token = np.concatenate([sets[k] for k in live])
    token &= _MASK
    del sets
    owner = np.repeat(np.arange(len(live), dtype=np.uint16), sizes[live])
    order, distinct, begin = _sorted(token)
    del token
    count = np.diff(begin, append=len(order)).astype(np.uint32)
    many = count > 1
    first = owner[order[begin]]
    # What several sets of the fold hold is asked once; who holds it stays with the fold.
    place = np.empty(len(order), np.int32)
    place[order] = np.repeat(np.where(many, np.cumsum(many) - 1, -1).astype(np.int32), count)
    del order, begin
    held = place >= 0
    out.append((home, fold, _SETS, content[live].tobytes(), sizes[live].tobytes(), np.bincount(owner[held], minlength=len(live)).astype(np.int64).tobytes(), None))
    out.append((home, fold, _HELD, place[held].tobytes(), None, None, None))
    del place, held, owner
    bucket = (common.mixed(distinct) % np.uint64(buckets)).astype(np.int32)
    for kind, pick, value in ((_SINGLE, ~many, first), (_MANY, many, count)):
        at = np.flatnonzero(pick)
        at = at[np.argsort(bucket[at], kind="stable")]
        cuts = np.searchsorted(bucket[at], np.arange(buckets + 1))
        for k in range(buckets):
            if cuts[k] < cuts[k + 1]:
                some = at[cuts[k] : cuts[k + 1]]
                out.append((k, fold, kind, _six(distinct[some]), value[some].tobytes(), None, None))
    return out


def _answers(part: pd.DataFrame) -> pd.DataFrame:
    """One bucket: each ask is answered with those of its shingles that more than one set holds, and how many do."""
    asked = part["kind"] <= _MANY
    own, out = part[~asked], []
    rows = part[asked]
    if len(rows):
        tokens = _from_six(rows["a"])
        weight = np.concatenate([np.ones(len(a) // 6, np.uint32) if kind == _SINGLE else np.frombuffer(b, np.uint32) for a, kind, b in zip(rows["a"], rows["kind"], rows["b"])])
        order, distinct, begin = _sorted(tokens)
        total = np.empty(len(order), np.uint32)
        total[order] = np.repeat(np.add.reduceat(weight[order], begin, dtype=np.uint32), np.diff(begin, append=len(order)))
        del order, distinct, begin, weight
        at = 0
        for a, fold, kind, b in zip(rows["a"], rows["fold"], rows["kind"], rows["b"]):
            some = slice(at, at + len(a) // 6)
            t, f = tokens[some], total[some]
            at = some.stop
            more = f > 1
            if more.any():
                out.append((fold, kind, _six(t[more]), np.frombuffer(b, np.uint16)[more].tobytes() if kind == _SINGLE else None, f[more].tobytes(), None))
        del tokens, total, t, f
        common.trimmed()
    answered = pd.DataFrame(out, columns=["fold", "kind", "a", "b", "c", "e"])
    return pd.concat([own[["fold", "kind", "a", "b", "c", "e"]], answered], ignore_index=True)


def _assembled(num: int, den: int):
    """One fold: its rows, and its sets of which enough shingles are shared, those in order of rarity."""

    def assemble(part: pd.DataFrame) -> pd.DataFrame:
        by = {k: g for k, g in part.groupby("kind")}
        r = by[_ROWS].iloc[0]
        d = np.frombuffer(r["a"], np.int64)
        rows = pd.DataFrame({"d": d[: len(d) // 2], "named": d[len(d) // 2 :] == 1, "h": np.frombuffer(r["b"], np.int64), "size": np.frombuffer(r["c"], np.int64), "content": np.frombuffer(r["e"], np.int64)})
        rows["kind"], rows["tokens"] = 0, None
        names = ["kind", "d", "named", "h", "content", "size", "tokens"]
        if _SETS not in by:
            return rows[names]
        s = by[_SETS].iloc[0]
        content, size, holds = np.frombuffer(s["a"], np.int64), np.frombuffer(s["b"], np.int64), np.frombuffer(s["c"], np.int64)
        held = np.frombuffer(by[_HELD].iloc[0]["a"], np.int32)
        token, owner, often = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if _MANY in by:
            t, f = _from_six(by[_MANY]["a"]), np.frombuffer(b"".join(by[_MANY]["c"]), np.uint32).astype(np.int64)
            order = np.argsort(t)
            token.append(t[order][held])
            often.append(f[order][held])
            owner.append(np.repeat(np.arange(len(content)), holds))
        if _SINGLE in by:
            token.append(_from_six(by[_SINGLE]["a"]))
            owner.append(np.frombuffer(b"".join(by[_SINGLE]["b"]), np.uint16).astype(np.int64))
            often.append(np.frombuffer(b"".join(by[_SINGLE]["c"]), np.uint32).astype(np.int64))
        token, owner, often = np.concatenate(token), np.concatenate(owner), np.concatenate(often)
        shared = np.bincount(owner, minlength=len(content))
        alive = shared * den >= size * num
        pick = alive[owner]
        token, owner, often = token[pick].astype(np.int64), owner[pick], often[pick]
        order = np.lexsort((token, often, owner))
        token = token[order]
        ends = np.cumsum(np.where(alive, shared, 0))
        k = np.flatnonzero(alive)
        some = pd.DataFrame({"kind": 1, "d": 0, "named": True, "h": 0, "content": content[k], "size": size[k], "tokens": [token[ends[i] - shared[i] : ends[i]] for i in k]})
        del owner, often, order, pick
        common.trimmed()
        return pd.concat([rows[names], some[names]], ignore_index=True) if len(some) else rows[names]

    return assemble


def folded(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored (rows, sets): every row's id (d, if named), text hash h, content and size; every possible partner's size and shared shingles.

    ``docs`` must give the same rows when a task is repeated, as files and stored tables do.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(body).alias("h"), body.alias("t"))
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = max(common.parts_for(spark), -(-total // MEET))

    def ask(batches):
        from pyspark import TaskContext

        common.released()
        fold = TaskContext.get().partitionId() << 32
        ids, hashes, kept, held = [], [], [], 0
        for b in batches:
            for d, h, t in zip(*(b.column(c).to_pylist() for c in ("d", "h", "t"))):
                ids.append(d)
                hashes.append(h)
                kept.append(t)
                held += len(t)
                if held >= FOLD or len(kept) >= FOLD_ROWS:
                    message = _message(_asks(fold, ids, hashes, kept, n, buckets))
                    fold += 1
                    ids, hashes, kept, held = [], [], [], 0
                    common.trimmed()
                    yield message
                    del message
        if kept:
            yield _message(_asks(fold, ids, hashes, kept, n, buckets))
        common.released()

    answered = texts.mapInArrow(ask, _MESSAGE).groupBy("bucket").applyInPandas(_answers, _MESSAGE.removeprefix("bucket int, "))
    every = answered.groupBy("fold").applyInPandas(_assembled(num, den), "kind int, d long, named boolean, h long, content long, size long, tokens array<long>")
    every = common.stored(every, "folded")
    rows = every.where("kind = 0").select(F.when(F.col("named"), F.col("d")).alias("d"), "h", "content", "size")
    # A set that several folds hold is the same in each.
    sets = every.where("kind = 1").groupBy(F.col("content").alias("node")).agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"))
    return rows, common.stored(sets, "sets")


def _need(num: int, den: int, both: Column) -> Column:
    """The least overlap of two linked sets with ``both`` members together."""
    return F.floor((both * num + (num + den - 1)) / (num + den)).cast("long")


def _near(num: int, den: int, a: Column, b: Column) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Stored ``pairs`` (x, y) with sizes sx, sy, the counted overlap i and whether they are ``linked``."""
    # Only the sets that are asked for are dealt.
    asked = pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).distinct()
    asked = F.broadcast(asked) if common.at_most(pairs, common.BROADCAST_ROWS // 2) else asked
    sets = sets.join(asked, "node", "left_semi")
    one = sets.select(F.col("node").alias("x"), F.col("size").alias("sx"), F.col("tokens").alias("tx"))
    two = sets.select(F.col("node").alias("y"), F.col("size").alias("sy"), F.col("tokens").alias("ty"))
    met = common.salted_join(common.salted_join(pairs, two, "y", "x"), one, "x", "y")
    met = met.select("x", "y", "sx", "sy", F.size(F.array_intersect("tx", "ty")).cast("long").alias("i"))
    return common.stored(met.withColumn("linked", F.col("i") >= _need(num, den, F.col("sx") + F.col("sy"))), "verified")


def entries_of(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Stored index entries (token, node, size, pos): the shared shingles of each set's prefix."""
    held = F.size("tokens").cast("long")
    least = F.floor((F.col("size") * num + den - 1) / den).cast("long")
    prefix = F.slice("tokens", 1, (held - least + 1).cast("int"))
    out = sets.select("node", "size", (F.col("size") - held).alias("own"), F.posexplode(prefix).alias("k", "token"))
    return common.stored(out.select("token", "node", "size", (F.col("own") + F.col("k")).alias("pos")), "entries")


def placed(entries: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``entries`` with the component of each set."""
    if comps is None:
        return entries.withColumn("comp", F.col("node"))
    return entries.join(comps, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def leading(entries: DataFrame, comps: DataFrame | None, tried: DataFrame | None, num: int, den: int, turn: int = 0) -> DataFrame:
    """Stored pairs (x, y): sets and the leaders that they meet most often, sets of other components; 2 to the ``turn`` leaders for each.

    A list's leader is of its largest component: the set where the list's shingle comes first, for few rare
    shingles before it mean a set in the middle of its like; later turns blur that order.  Pairs in ``tried`` are left out.
    """
    e = placed(entries, comps) if comps is None else common.stored(placed(entries, comps), "placed")
    o = F.col("pos") + F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 + 8 * turn))
    lead = e.groupBy("token", "comp").agg(F.count("*").alias("n"), F.min(F.struct(o.alias("o"), "node", "size")).alias("lead"))
    lead = lead.groupBy("token").agg(F.max(F.struct("n", "comp", "lead")).alias("v"), F.count("*").alias("comps")).where("comps > 1")
    lead = lead.select("token", F.col("v.comp").alias("cy"), F.col("v.lead.node").alias("y"), F.col("v.lead.size").alias("sy"))
    met = common.salted_join(e, lead, "token", "node").where((F.col("comp") != F.col("cy")) & _near(num, den, F.col("size"), F.col("sy")))
    often = met.groupBy(F.col("node").alias("x"), "y").agg(F.count("*").alias("n"))
    if tried is not None:
        often = often.join(tried.select("x", "y"), ["x", "y"], "left_anti")
    # A set has no more leaders than shingles in its prefix.
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.xxhash64("y").alias("o"), "y"))), 1, 1 << turn)
    best = often.groupBy("x").agg(best.alias("best")).select("x", F.explode("best").alias("v"))
    out = common.stored(best.select("x", F.col("v.y").alias("y")), "leading")
    common.forget(e)
    return out


def leaders_of(answers: DataFrame) -> DataFrame:
    """(x, lx, sl, ix): of each set with answers, the leader with which it shares most, that one's size and their overlap."""
    one = answers.groupBy("x").agg(F.max(F.struct("i", "y", "sy")).alias("v"))
    return one.select("x", F.col("v.y").alias("lx"), F.col("v.sy").alias("sl"), F.col("v.i").alias("ix"))


def sketched(sets: DataFrame) -> DataFrame:
    """(node, shared, sketch): of each set how many of its shingles others hold, and for SKETCH classes of these whether their number is odd.

    A class whose numbers differ in parity holds a shingle of one set alone, so at most (shared + shared - differing classes) / 2 are common.
    """

    def sketch(batches):
        for b in batches:
            out = []
            for t in b.column("tokens"):
                at = np.asarray(t.values) & (SKETCH - 1) if t.is_valid else np.zeros(0, np.int64)
                out.append(np.packbits(np.bincount(at, minlength=SKETCH) & 1).view("<i8").tolist())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("shared"), pa.array(out, pa.list_(pa.int64()))], names=["node", "shared", "sketch"])

    return sets.select("node", F.size("tokens").cast("long").alias("shared"), "tokens").mapInArrow(sketch, "node long, shared long, sketch array<long>")


def blocks_of(entries: DataFrame, comps: DataFrame, answers: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """Stored blocks of the lists that hold more than one component, with headers for skipping, what ``answers`` say of each set's leader, and the sketches of ``sets``."""
    every = e = common.stored(placed(entries, comps), "placed")
    open_ = e.groupBy("token").agg(F.count("*").alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token", "n")
    e = common.salted_join(e, open_, "token", "node")
    if answers is None:
        e = e.select("*", *(F.lit(None).cast("long").alias(c) for c in ("lx", "ix")))
    else:
        e = e.join(leaders_of(answers).select(F.col("x").alias("node"), "lx", "ix"), "node", "left")
    if sets is None:
        e = e.select("*", F.lit(None).cast("long").alias("shared"), F.lit(None).cast("array<long>").alias("sketch"))
    else:
        e = e.join(sketched(sets.join(e.select("node").distinct(), "node", "left_semi")), "node", "left")
    band = F.when(F.col("n") <= BLOCK, 0).otherwise(F.floor(F.log2(F.col("pos") + 1.0)).cast("int"))
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).cast("int")
    cut = e.groupBy("token", band.alias("band"), salt.alias("salt")).agg(
        F.min("pos").alias("pos"), F.min("size").alias("low"), F.max("size").alias("high"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.collect_list(F.struct("node", "size", "pos", "comp", "lx", "ix", "shared", "sketch")).alias("held"),
    )
    out = common.stored(cut.withColumn("block", F.struct("band", "salt")), "blocks")
    common.forget(every)
    return out


def block_pairs(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Stored pairs of blocks of a list (token, block_a, block_b) that their headers can't rule out; a list of many blocks is dealt to several tasks."""
    heads = common.stored(blocks.drop("held"), "headers")
    lists = heads.groupBy("token").agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("parts"))
    a, b = (heads.join(lists, "token").select("token", "parts", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "pos", "low", "high", "c0", "c1"))) for s in "ab")
    a = a.withColumn("part", F.pmod(F.xxhash64("block_a"), F.col("parts")).cast("int")).drop("parts")
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = a.join(b, ["token", "part"]).where("block_a <= block_b")
    one = (F.col("c0_a") == F.col("c1_a")) & (F.col("c0_b") == F.col("c1_b")) & (F.col("c0_a") == F.col("c0_b"))
    far = (F.col("high_a") * den < F.col("low_b") * num) | (F.col("high_b") * den < F.col("low_a") * num)
    left = F.least(F.col("high_a") - F.col("pos_a"), F.col("high_b") - F.col("pos_b"))
    out = common.stored(met.where(~one & ~far & (left >= _need(num, den, F.col("low_a") + F.col("low_b")))).select("token", "block_a", "block_b"), "pairs")
    common.forget(heads)
    return out


def candidates(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Stored pairs (x, y, sx, sy, cx, cy) of sets of different components, x < y, whose positions leave enough.

    Pairs whose answers for a common leader or whose sketches rule a link out are never formed: of a group of near copies these are almost all.
    """

    def meets(p: Column, q: Column) -> Column:
        need = _need(num, den, p["size"] + q["size"])
        enough = F.least(p["size"] - p["pos"], q["size"] - q["pos"]) >= need
        most = F.least(p["ix"] + q["size"] - q["ix"], q["ix"] + p["size"] - p["ix"])
        may = F.coalesce((p["lx"] != q["lx"]) | (most >= need), F.lit(True))
        differ = sum((F.bit_count(p["sketch"][k].bitwiseXOR(q["sketch"][k])) for k in range(1, SKETCH // 64)), F.bit_count(p["sketch"][0].bitwiseXOR(q["sketch"][0])))
        alike = F.coalesce(p["shared"] + q["shared"] - differ >= 2 * need, F.lit(True))
        return (p["comp"] != q["comp"]) & _near(num, den, p["size"], q["size"]) & enough & may & alike

    def pair(p: Column, q: Column) -> Column:
        first = p["node"] < q["node"]
        return F.struct(*(F.when(first, a[c]).otherwise(b[c]).alias(n) for n, a, b, c in (("x", p, q, "node"), ("y", q, p, "node"), ("sx", p, q, "size"), ("sy", q, p, "size"), ("cx", p, q, "comp"), ("cy", q, p, "comp"))))

    held = lambda s: blocks.select("token", F.col("block").alias(f"block_{s}"), F.col("held").alias(f"held_{s}"))
    pairs = block_pairs(blocks, num, den)
    got = pairs.join(held("a"), ["token", "block_a"]).join(held("b"), ["token", "block_b"])
    got = got.select(F.explode("held_a").alias("p"), "held_b").select("p", F.explode(F.filter("held_b", lambda q: meets(F.col("p"), q))).alias("q"))
    return common.stored(got.select(pair(F.col("p"), F.col("q")).alias("v")).select("v.*").distinct(), "candidates")


def derived(cand: DataFrame, answers: DataFrame, num: int, den: int) -> DataFrame:
    """``cand`` with ``says``: true or false where answers decide, else null; and the common ``leader``, if there is one, with its overlap ``iy`` with y.

    Answers (x, y, sx, sy, i) for a common leader y bound a pair's overlap; a pair that has its own answer follows it.
    """
    x = leaders_of(answers)
    y = x.select(F.col("x").alias("y"), F.col("lx").alias("ly"), F.col("ix").alias("iy"))
    own = answers.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.col("linked").alias("own")).distinct()
    both = cand.join(x, "x", "left").join(y, "y", "left").join(own, ["x", "y"], "left")
    need = _need(num, den, F.col("sx") + F.col("sy"))
    low = F.col("ix") + F.col("iy") - F.col("sl")
    high = F.least(F.col("ix") + F.col("sy") - F.col("iy"), F.col("iy") + F.col("sx") - F.col("ix"))
    says = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("lx") == F.col("ly"), F.when(low >= need, True).when(high < need, False))
    return both.select("x", "y", "sx", "sy", "cx", "cy", says.alias("says"), F.when(F.col("lx") == F.col("ly"), F.col("lx")).alias("leader"), "iy")


def increments(open_: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Stored pairs (x, y) of ``open_`` with a common leader, ``linked`` or not: the leader's overlap with y, changed by what x lacks and has beside it."""
    pairs = open_.where("says is null and leader is not null")
    tokens = lambda c, t: sets.select(F.col("node").alias(c), F.col("tokens").alias(t))
    own = pairs.select("x", "leader").distinct().join(tokens("x", "tx"), "x").join(tokens("leader", "tl"), "leader")
    own = common.stored(own.select("x", F.array_except("tl", "tx").alias("lacks"), F.array_except("tx", "tl").alias("has")), "increments")
    met = common.salted_join(common.salted_join(pairs.select("x", "y", "sx", "sy", "iy"), tokens("y", "ty"), "y", "x"), own, "x", "y")
    i = F.col("iy") - F.size(F.array_intersect("lacks", "ty")) + F.size(F.array_intersect("has", "ty"))
    out = common.stored(met.select("x", "y", (i >= _need(num, den, F.col("sx") + F.col("sy"))).alias("linked")), "answered")
    common.forget(own)
    return out


def reached(sets: DataFrame, num: int, den: int, seen: dict | None = None) -> DataFrame:
    """(node, root): the sets that links reach, root the smallest of their component.  ``seen`` gets how many pairs were decided in which way."""
    entries = entries_of(sets, num, den)
    answers, comps, turn = None, None, 0
    while True:
        # As long as comparing with leaders pays.
        pairs = leading(entries, comps, answers, num, den, turn)
        if common.at_most(pairs, 0) and answers is not None:
            break
        now = verified(pairs, sets, num, den)
        paired = pairs._rows
        common.forget(pairs)
        answers = now if answers is None else answers.unionByName(now)
        found, turn = now.where("linked").count(), turn + 1
        if PAYS * found < paired or not found:
            break
        before, comps = comps, common.components(answers.where("linked").select("x", "y"), "x", "y")
        if before is not None:
            common.forget(before)
    links = answers.where("linked").select("x", "y")
    if comps is None or found:
        before, comps = comps, common.components(links, "x", "y")
        if before is not None:
            common.forget(before)
    blocks = blocks_of(entries, comps, answers, sets)
    cand = candidates(blocks, num, den)
    common.forget(blocks, entries)
    if common.at_most(cand, 0):
        return comps
    open_ = common.stored(derived(cand, answers, num, den), "derived")
    stepped = increments(open_, sets, num, den)
    counted = verified(common.stored(open_.where("says is null and leader is null").select("x", "y"), "open"), sets, num, den)
    if seen is not None:
        seen.update(candidates=cand._rows, bounds=open_.where("says is not null").count(), increments=stepped._rows, counted=counted._rows)
    found = open_.where("says").select("x", "y").union(stepped.where("linked").select("x", "y")).union(counted.where("linked").select("x", "y"))
    found = common.stored(found, "found")
    common.forget(cand, open_, stepped, counted)
    return comps if common.at_most(found, 0) else common.components(links.union(found), "x", "y")


def grouped(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", merge_ids: bool = False) -> DataFrame:
    """Stored (d, h, content, size, root) of every row: its set and the least set that links reach, null for rows without an id.

    With ``merge_ids`` the different texts of one id are linked as well.
    """
    rows, sets = folded(docs, n, num, den, id_col, text_col)
    comps = reached(sets, num, den)
    if merge_ids:
        named = rows.where("d is not null")
        several = named.groupBy("d").agg(F.min("content").alias("b"), F.max("content").alias("m")).where("b <> m").select("d", "b")
        several = common.stored(several, "several")
        if not common.at_most(several, 0):
            again = common.salted_join(named.select("d", F.col("content").alias("a")), several, "d", "a").select("a", "b")
            comps = common.components(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).union(again))
    out = common.salted_join(rows, comps.select(F.col("node").alias("content"), "root"), "content", "h", "left")
    return common.stored(out.withColumn("root", F.when(F.col("d").isNotNull(), F.coalesce("root", "content"))), "grouped")


def joined(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles and component_id (the smallest id reachable by links) of every row.

    Two sets are linked when den * |intersection| >= num * |union|.
    """
    rows = grouped(docs, n, num, den, id_col, text_col, merge_ids=True)
    least = rows.where("d is not null").groupBy("root").agg(F.min("d").alias("component_id"))
    out = common.salted_join(rows, least, "root", "h", "left")
    return out.select(F.col("d").alias(id_col), F.col("size").alias("n_shingles"), "component_id")
