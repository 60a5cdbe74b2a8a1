"""Mixing sources to target weights by the cube method.

Every source has a target share of words.  Each of its documents is taken
floor(target / size) times for certain, and once more with the fractional rest as its
inclusion probability.  The cube method's flight phase moves those probabilities to 0
or 1 along directions in the null space of two balancing constraints (words and
documents stay at their expected totals) within blocks of documents; the few left
undecided in each block meet in blocks of the next round, until a handful is left in
each source.  That landing problem is solved outright: the rounding nearest to the
source's target.

Null texts have no words.  A source without words is taken zero times.  Rows that
repeat an id are decided separately.  All choices derive from hashes of ids and
texts, so reruns agree.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a block; a hot source becomes many blocks.
BLOCK = 1024
#: Undecided documents left in a source when the landing begins, at most.
LANDING = 10
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
_EPS = 1e-9


def size_of(text_col: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> dict:
    """Words to take of each source: ``share`` of all, by weight, none above ``repeats`` times its size.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn.  What
    a source can't hold goes to the others by weight, again until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * per > repeats * sizes[s]]
        if not full:
            out |= {s: weight[s] * per for s in open_}
            break
        for s in full:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def flight(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities moved until at most LANDING lie strictly between 0 and 1.

    Three undecided documents at a time leave one direction that changes neither their
    expected number nor their expected words; a step along it, to whichever side a fair
    draw says, decides at least one of them.
    """
    p = p.astype(float).copy()
    todo = list(np.flatnonzero((p > _EPS) & (p < 1 - _EPS)))
    rng = np.random.default_rng(seed)
    draws = iter(rng.random(len(todo) + 1))
    at, active = 0, []
    x, s = p.tolist(), size.tolist()
    while True:
        while len(active) < 3 and at < len(todo):
            active.append(todo[at])
            at += 1
        if len(active) < 3 or len(active) + len(todo) - at <= LANDING:
            break
        a, b, c = active
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - x[i]) / v if v > 0 else x[i] / -v for i, v in zip(active, u) if v)
        down = min(x[i] / v if v > 0 else (1 - x[i]) / -v for i, v in zip(active, u) if v)
        step = up if next(draws) * (up + down) < down else -down
        for i, v in zip(active, u):
            x[i] += step * v
        kept = [i for i in active if _EPS < x[i] < 1 - _EPS]
        for i in active:
            if i not in kept:
                x[i] = float(round(x[i]))
        active = kept
    return np.array(x)


def land(p: np.ndarray, size: np.ndarray, gap: float) -> np.ndarray:
    """The 0/1 choice whose words come nearest to ``gap``; ties go to fewer documents."""
    undecided = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    best = min(
        itertools.product((0, 1), repeat=len(undecided)),
        key=lambda c: (abs(sum(size[i] for i, x in zip(undecided, c) if x) - gap), sum(c), c),
    )
    out = p.round()
    out[undecided] = best
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rule) -> DataFrame:
    """``id_col``, row key ``h``, source, size, source_size, target, times and taken of every document.

    Texts are read once, for their number of words.  The sources' totals, one row for
    each source, go to the driver; documents don't.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("d"), F.col(source_col).alias("s"), size_of(text_col).alias("size"), F.xxhash64(id_col, text_col).alias("h"))
    rows = common.stored(rows, "sizes")
    sums = {r["s"]: (r["t"], r["n"]) for r in rows.groupBy("s").agg(F.sum("size").alias("t"), F.count("*").alias("n")).collect()}
    goal = targets({s: t for s, (t, _) in sums.items()}, **rule)
    table = [(s, t, n, float(goal[s]), goal[s] / t if t else 0.0) for s, (t, n) in sums.items()]
    shape = "s string, source_size long, n long, target double, rate double"
    table = common.local(spark, table, shape)
    table = F.broadcast(table) if len(sums) <= 100_000 else table
    rows = rows.withColumnRenamed("s", "source").join(table, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rows = rows.withColumn("sure", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.col("sure"))

    # Round after round: blocks of documents of one source, by hash; repeats of a key stay together.
    # A block is far larger than what it leaves, or rounds would not end.
    block = max(BLOCK, 8 * LANDING)
    blocks = F.ceil(F.col("n") / block)
    state = rows.withColumn("b", F.pmod(F.xxhash64("h", F.lit(17)), blocks))
    shape = "d {d}, h long, source string, size long, source_size long, n long, target double, sure long, p double, b long".format(d=dict(docs.dtypes)[id_col])
    columns = ["d", "h", "source", "size", "source_size", "n", "target", "sure", "p", "b"]

    def fly(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "size"], kind="stable", ignore_index=True)
        seed = zlib.crc32(f"{part['source'].iloc[0]}/{part['b'].iloc[0]}/{part['n'].iloc[0]}".encode())
        part["p"] = flight(part["p"].to_numpy(), part["size"].to_numpy(), seed)
        return part[columns]

    state = common.stored(state.select(*columns).groupBy("source", "b").applyInPandas(fly, shape), "flight")
    decided, counts = [], sums
    open_ = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
    while True:
        decided.append(state.where(~open_))
        state = state.where(open_)
        counts = {r["source"]: r["n"] for r in state.groupBy("source").agg(F.count("*").alias("n")).collect()}
        if not counts or max(counts.values()) <= LANDING:
            break
        now = common.local(spark, list(counts.items()), "s string, n long")
        now = F.broadcast(now) if len(counts) <= 100_000 else now
        state = state.drop("n", "b").join(now, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        # Each block leaves LANDING of them, so their number falls by BLOCK / LANDING a round.
        state = state.withColumn("b", F.pmod(F.xxhash64("h", F.lit(17)), F.ceil(F.col("n") / block)))
        state = common.stored(state.select(*columns).groupBy("source", "b").applyInPandas(fly, shape), "flight")

    # The landing: what the decided documents lack of each source's target, less the sure copies.
    done = decided[0]
    for x in decided[1:]:
        done = done.unionByName(x)
    got = done.groupBy("source").agg(F.sum(F.col("size") * F.col("p").cast("long")).alias("got"))
    gaps = {r["source"]: r["got"] or 0 for r in got.collect()}
    gaps = {s: goal[s] - (int(goal[s] // sums[s][0]) if sums[s][0] else 0) * sums[s][0] - gaps.get(s, 0) for s in counts}

    def landing(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "size"], kind="stable", ignore_index=True)
        s = part["source"].iloc[0]
        part["p"] = land(part["p"].to_numpy(), part["size"].to_numpy(), gaps[None if s is None or s != s else s])
        return part[columns]

    if counts:
        done = done.unionByName(state.groupBy("source").applyInPandas(landing, shape))
    out = done.withColumn("times", F.col("sure") + F.round("p").cast("long"))
    out = out.withColumn("taken", F.col("times") * F.col("size"))
    return out.select(F.col("d").alias(id_col), "h", "source", "size", "source_size", "target", "times", "taken")
