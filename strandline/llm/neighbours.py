"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt to cells: bands of about equal length, and in a band those around centroids, which are
learned from a bounded sample.  A cell of more than ``SHARD`` vectors is dealt to several shards, each with its own graph: a vector's
neighbours are proposed by a greedy search on the graph so far, and kept by relaxed
pruning (a candidate goes if a kept neighbour is ALPHA times nearer to it than the
vector is).  A query searches its most promising cell first, by a beam search on its graphs, then
rounds of more and more of the others, each without the cells that can't hold a score above the query's
least so far (a cell's centre, radius and longest vector bound its scores), so what a round finds
for a query grows with the number of rounds, not with that of the cells.  A shard's graph is read
once a round for every ``BLOCK`` queries that come to it.  Scores of what is found are the measure itself, in double precision.

Graphs are built on vectors less their middle, which changes all scores of a query alike; in a band, whose
lengths differ little, inner products become distances by one more coordinate, which gives all vectors the
same length.  Equal vectors are one node of a graph; of each, the smallest
ids, as many as a query can return, are joined back.  Null vectors, zero vectors, those
with null or non-finite components, and those of another dimension than most take no
part.  Rows that repeat an id keep one vector, the smallest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import common

#: Vectors in a shard, about; edges of a node; beams while building and searching.
SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA = 4_000, 32, 48, 112, 1.2
#: Cells at most; nodes whose vectors teach the centroids.
CELLS, SAMPLE = 4_096, 40_000
#: Lengths in a band differ by this factor at most; the band of vectors that lie in the middle.
RATIO, INNERMOST = 1.25, -20_000
#: A round searches so many times the cells that were searched before it.
GROWS = 2
#: Queries in a block.
BLOCK = 2_048


def _distances(x: np.ndarray, sq: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances, less |q|^2, of rows of q to x[ids] (ids: queries x k)."""
    return sq[ids] - 2 * np.einsum("bkd,bd->bk", x[ids], q, optimize=True)


def beam_search(x: np.ndarray, sq: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances), nearest first, -1 where fewer: greedy beam search for all rows of q at a time."""
    b, n = len(q), len(x)
    seen = np.zeros((b, n), bool)
    rows = np.arange(b)
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf)
    done = np.ones((b, beam), bool)
    ids[:, 0] = entry
    dist[:, 0] = _distances(x, sq, q, np.full((b, 1), entry))[:, 0]
    done[:, 0] = False
    seen[:, entry] = True
    live = rows
    while len(live):
        best = np.argmin(np.where(done[live], np.inf, dist[live]), axis=1)
        live = live[~done[live, best]] if done[live, best].any() else live
        if not len(live):
            break
        best = np.argmin(np.where(done[live], np.inf, dist[live]), axis=1)
        done[live, best] = True
        near = graph[ids[live, best]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, ids[live, best][:, None])] = True
        d = np.where(fresh, _distances(x, sq, q[live], np.maximum(near, 0)), np.inf)
        all_d = np.concatenate((dist[live], d), 1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        at = np.arange(len(live))[:, None]
        ids[live] = np.concatenate((ids[live], np.where(fresh, near, -1)), 1)[at, keep]
        done[live] = np.concatenate((done[live], ~fresh), 1)[at, keep]
        dist[live] = all_d[at, keep]
        live = live[(~done[live]).any(1)]
    order = np.argsort(dist, axis=1, kind="stable")
    return ids[rows[:, None], order], dist[rows[:, None], order]


def robust_prune(x: np.ndarray, sq: np.ndarray, p: np.ndarray, cand: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Kept neighbours (rows x degree, -1 where fewer) of nodes p among candidates (rows x k, -1 for none)."""
    b, k = cand.shape
    c = np.maximum(cand, 0)
    v = x[c]
    d = np.einsum("bkd,bkd->bk", v - x[p][:, None], v - x[p][:, None])
    d = np.where((cand < 0) | (cand == p[:, None]), np.inf, d)
    order = np.argsort(d, axis=1, kind="stable")
    at = np.arange(b)[:, None]
    cand, d, v = cand[at, order], d[at, order], v[at, order]
    # A node that is proposed twice counts once.
    alive = np.isfinite(d)
    s = sq[np.maximum(cand, 0)]
    cross = np.maximum(s[:, :, None] + s[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0)
    out = np.full((b, degree), -1, np.int64)
    row = np.arange(b)
    for r in range(degree):
        pick = np.argmax(alive, axis=1)
        ok = alive[row, pick]
        if not ok.any():
            break
        out[ok, r] = cand[row, pick][ok]
        gone = alpha * alpha * cross[row, pick] <= d
        gone |= cand == cand[row, pick][:, None]
        alive &= ~(gone & ok[:, None])
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(graph, entry): nodes are inserted in growing batches, then all once more with the relaxed rule."""
    n = len(x)
    sq = np.einsum("nd,nd->n", x, x)
    graph = np.full((n, degree), -1, np.int64)
    entry = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    if n == 1:
        return graph, entry
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate(([entry], order[order != entry]))

    def insert(batch: np.ndarray, a: float) -> None:
        found, _ = beam_search(x, sq, graph, entry, x[batch], beam)
        cand = np.concatenate((found, graph[batch]), 1)
        graph[batch] = robust_prune(x, sq, batch, cand, a, degree)
        # Edges back; nodes that would have too many are pruned as well.
        src = np.repeat(batch, degree)
        dst = graph[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        head = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1])))
        nodes = dst[head]
        rank = np.arange(len(dst)) - np.repeat(head, np.diff(np.append(head, len(dst))))
        most = 2 * degree
        back = np.full((len(nodes), most), -1, np.int64)
        put = rank < most
        back[np.repeat(np.arange(len(nodes)), np.diff(np.append(head, len(dst))))[put], rank[put]] = src[put]
        both = np.concatenate((graph[nodes], back), 1)
        count = (both >= 0).sum(1)
        easy = count <= degree
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]
        if easy.any():
            packed_easy = packed[easy]
            dup = np.sort(packed_easy, axis=1)
            twice = ((dup[:, 1:] == dup[:, :-1]) & (dup[:, 1:] >= 0)).any(1)
            rows = np.flatnonzero(easy)
            graph[nodes[rows[~twice]]] = packed_easy[~twice]
            easy[rows[twice]] = False
        hard = np.flatnonzero(~easy)
        for i in range(0, len(hard), 1024):
            h = hard[i : i + 1024]
            graph[nodes[h]] = robust_prune(x, sq, nodes[h], both[h], a, degree)

    at, size = 1, 1
    while at < n:
        insert(order[at : at + size], 1.0)
        at += size
        size = min(2 * size, max(32, min(512, n // 20)))
    for i in range(0, n, 512):
        insert(order[i : i + 512], alpha)
    return graph, entry


class Index:
    """The graph of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cells: Cells, graph: np.ndarray | None = None, entry: int = 0):
        self.ids, self.vectors = ids, vectors
        v = cells.moved(vectors)
        v /= np.abs(v).max() or 1.0
        norm = np.einsum("nd,nd->n", v, v)
        extra = np.sqrt(np.maximum(norm.max() - norm, 0))
        self.x = np.concatenate((v, extra[:, None]), 1)
        self.graph, self.entry = build(self.x) if graph is None else (graph, entry)
        self.sq = np.einsum("nd,nd->n", self.x, self.x)

    def search(self, q: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(ids, inner products) of the k largest found, ties to the smaller id; -1 where fewer."""
        wide = np.concatenate((_unit(q), np.zeros((len(q), 1))), 1)
        ids, out = [], []
        for i in range(0, len(q), 512):
            found, _ = beam_search(self.x, self.sq, self.graph, self.entry, wide[i : i + 512], max(beam, k))
            score = np.einsum("bkd,bd->bk", self.vectors[np.maximum(found, 0)], q[i : i + 512])
            score = np.where(found < 0, -np.inf, score)
            real = np.where(found < 0, np.iinfo(np.int64).max, self.ids[np.maximum(found, 0)])
            top = np.lexsort((real, -score), axis=1)[:, :k]
            ids.append(np.where(np.take_along_axis(found, top, 1) < 0, -1, np.take_along_axis(real, top, 1)))
            out.append(np.take_along_axis(score, top, 1))
        return np.concatenate(ids), np.concatenate(out)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that take part; v as doubles."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Components that look null to exists() are caught by the count of sound ones.
    sound = F.size(F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))) == F.size(v)
    some = F.exists(v, lambda x: x != 0)
    out = rows.where(v.isNotNull() & F.col(id_col).isNotNull()).where(sound & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))
    return out.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v.cast("array<double>")).alias("v"))


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly drawn rows; a centre without rows stays where it is."""
    c = x[np.random.default_rng(k).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest_cells(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest_cells(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    k, out = min(k, len(c)), []
    sq = np.einsum("kd,kd->k", c, c)
    for i in range(0, len(x), 4096):
        d = sq - 2 * x[i : i + 4096] @ c.T
        top = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
        out.append(np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def _unit(q: np.ndarray) -> np.ndarray:
    """Rows of length 1 (zero rows as they are); their components may be very large or small."""
    q = q / np.maximum(np.abs(q).max(1, keepdims=True), np.finfo(float).tiny)
    return q / np.maximum(np.sqrt(np.einsum("nd,nd->n", q, q)), 1e-300)[:, None]


class Cells:
    """What deals vectors to cells: a scale (a power of two) and a middle, and the centres of each band of the sample."""

    def __init__(self, sample: np.ndarray, top: float, total: int, shard: int):
        self.scale = float(np.ldexp(1.0, min(int(np.frexp(top)[1]), 1023)))
        self.middle = np.zeros(sample.shape[1])
        self.middle = np.median(self.moved(sample), axis=0)
        y = self.moved(sample)
        band = self._bands(y)
        self.first: dict[int, int] = {}
        parts, at = [], 0
        for b in np.unique(band):
            own = y[band == b]
            k = max(1, min(len(own), CELLS * len(own) // len(y), -(-len(own) * total // (len(y) * shard))))
            self.first[int(b)] = at
            parts.append(centroids(own, k) if k > 1 else own.mean(0)[None])
            at += k
        self.centres, self.cuts = np.concatenate(parts), [*self.first.values(), at]

    def moved(self, v: np.ndarray) -> np.ndarray:
        return v / self.scale - self.middle

    @staticmethod
    def _bands(y: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.einsum("nd,nd->n", y, y))
        return np.where(norm > 0, np.floor(np.log(np.maximum(norm, 1e-300)) / np.log(RATIO)), INNERMOST).astype(np.int64)

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's cell, its length from the middle and its distance to the cell's centre; a band that the sample lacks is a cell."""
        y = self.moved(v)
        band = self._bands(y)
        norm = np.sqrt(np.einsum("nd,nd->n", y, y))
        cell, far = len(self.centres) + band - INNERMOST, norm.copy()
        for (b, lo), hi in zip(self.first.items(), self.cuts[1:]):
            own = np.flatnonzero(band == b)
            if len(own):
                cell[own] = lo + nearest_cells(y[own], self.centres[lo:hi], 1)[:, 0]
                gap = y[own] - self.centres[cell[own]]
                far[own] = np.sqrt(np.einsum("nd,nd->n", gap, gap))
        return cell, norm, far

    def centre(self, cell: int) -> np.ndarray:
        return self.centres[cell] if cell < len(self.centres) else np.zeros_like(self.middle)


def with_cells(nodes: DataFrame, total: int, shard: int = SHARD) -> tuple[DataFrame, Cells]:
    """``nodes`` (node, v, q) with ``cell``, ``norm`` and ``far``, and what deals them."""
    top = nodes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    sample = nodes.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    cells = Cells(np.array([r["v"] for r in sample], np.float64), top, total, shard)

    def assign(batches):
        for part in batches:
            if len(part):
                part["cell"], part["norm"], part["far"] = cells.assign(np.array(part["v"].tolist(), np.float64))
                yield part

    shape = T.StructType([*nodes.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("norm", T.DoubleType()), T.StructField("far", T.DoubleType())])
    return nodes.mapInPandas(assign, shape), cells


def asking(cells: Cells, sizes: list, lo: int, hi: int):
    """For mapInPandas: each query's cells from place ``lo`` to ``hi`` in its order, without those whose scores can't reach its ``tau``.

    ``sizes`` holds (cell, norm, far): the longest vector of each cell, and its radius.
    """
    number = np.array([r["cell"] for r in sizes], np.int64)
    norm, far = (np.array([r[c] for r in sizes]) for c in ("norm", "far"))
    centre = np.array([cells.centre(r["cell"]) for r in sizes])

    def ask(batches):
        for part in batches:
            if len(part):
                v = np.array(part["v"].tolist(), np.float64)
                q = v / cells.scale
                length = np.sqrt(np.einsum("nd,nd->n", q, q))[:, None]
                near = q @ centre.T
                # Half of the radius tells more of what a cell holds than all of it.
                order = np.argsort(-np.minimum(near + length * far / 2, length * norm), axis=1, kind="stable")[:, lo:hi]
                most = np.minimum(near + length * far, length * norm) + (q @ cells.middle)[:, None]
                with np.errstate(over="ignore", invalid="ignore"):
                    tau = part["tau"].to_numpy(np.float64) / cells.scale / cells.scale
                tau = np.where(np.isfinite(tau), tau, -np.inf)[:, None]
                slack = 1e-9 * length * (norm + np.sqrt(np.einsum("d,d->", cells.middle, cells.middle)) + far)
                may = np.take_along_axis(most + slack >= tau, order, 1)
                part["asks"] = [number[o[m]].tolist() for o, m in zip(order, may)]
                yield part[["query", "v", "tau", "asks"]]

    return ask


def nearest(rows: DataFrame, queries: F.Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM, probes: int | None = None, shard: int = SHARD) -> DataFrame:
    """query_id, rank, ``id_col``, score: the k rows of largest inner product found for each row that meets ``queries``.

    ``probes`` cells are searched for each query at most; if not given, all that can hold one of its k.
    """
    spark = rows.sparkSession
    sound = usable(rows, id_col, vector_col)
    sound = sound.withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: F.hex(F.xxhash64(x))), ""), 256)).withColumn("q", F.coalesce(queries, F.lit(False)))
    sound = common.stored(sound, "vectors")
    sizes = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    shape = f"query_id long, rank int, {id_col} long, score double"
    if not sizes:
        return spark.createDataFrame([], shape)
    sound = sound.where(F.size("v") == sizes[0]["d"])
    # Equal vectors are one node; of its ids only the k + 1 smallest can be returned.
    nodes = sound.groupBy("key").agg(F.min("id").alias("node"), F.first("v").alias("v"), F.max("q").alias("q"))
    nodes = common.stored(nodes, "nodes")
    total = nodes.count()
    placed, cells = with_cells(nodes, total, shard)
    placed = common.stored(placed, "cells")
    w = Window.partitionBy("key").orderBy("id")
    ids = sound.select("key", "id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    ids = ids.join(nodes.select("key", "node"), "key").select("node", F.col("id"))
    # A row for each cell: there are CELLS, and as many more as bands, at most.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"), F.max("norm").alias("norm"), F.max("far").alias("far")).orderBy("cell").collect()
    parts = F.broadcast(spark.createDataFrame([(r["cell"], r["parts"]) for r in sizes], "cell int, parts int"))

    def index(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", ignore_index=True)
        vectors = np.array(part["v"].tolist(), np.float64)
        x = Index(part["node"].to_numpy(), vectors, cells)
        return pd.DataFrame({"cell": [part["cell"].iloc[0]], "part": [part["part"].iloc[0]], "ids": [x.ids.astype(np.int64).tobytes()], "vectors": [vectors.tobytes()], "graph": [x.graph.astype(np.int32).tobytes()], "entry": [x.entry]})

    graphs = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("cell", "part", "node", "v")
    graphs = graphs.groupBy("cell", "part").applyInPandas(index, "cell int, part int, ids binary, vectors binary, graph binary, entry long")
    graphs = common.stored(graphs, "graphs")
    def search(graph: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(part):
            return pd.DataFrame({"query": [], "node": [], "score": []}).astype({"query": "int64", "node": "int64", "score": "float64"})
        g = graph.iloc[0]
        own = np.frombuffer(g["ids"], np.int64)
        x = Index(own, np.frombuffer(g["vectors"], np.float64).reshape(len(own), -1), cells, np.frombuffer(g["graph"], np.int32).reshape(len(own), -1).astype(np.int64), int(g["entry"]))
        found, score = x.search(np.array(part["v"].tolist(), np.float64), k + 1, beam)
        query = np.repeat(part["query"].to_numpy(), found.shape[1])
        ok = (found >= 0) & ~(score < part["tau"].to_numpy(np.float64)[:, None])
        ok = ok.ravel()
        return pd.DataFrame({"query": query[ok], "node": found.ravel()[ok], "score": score.ravel()[ok]})

    first = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    asked = placed.where("q").select(F.col("node").alias("query"), "v")
    found, lo, last = None, 0, len(sizes) if probes is None else min(probes, len(sizes))
    while lo < last:
        hi = min(last, lo + max(1, GROWS * lo))
        if found is None:
            now = asked.withColumn("tau", F.lit(float("-inf")))
        else:
            least = found.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).alias("tau"))
            now = asked.join(least, "query", "left").withColumn("tau", F.coalesce("tau", F.lit(float("-inf"))))
        now = now.mapInPandas(asking(cells, sizes, lo, hi), "query long, v array<double>, tau double, asks array<int>")
        now, lo = common.stored(now.select("query", "v", "tau", F.explode("asks").alias("cell")), "asks"), hi
        if common.at_most(now, 0):
            continue
        plan = F.broadcast(parts.join(now.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cell"))
        met = graphs.join(plan, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("parts", "blocks")
        asks = now.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("query", F.lit(3)), F.col("blocks")).cast("int"))
        asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "blocks")
        more = met.groupBy("cell", "part", "block").cogroup(asks.groupBy("cell", "part", "block")).applyInPandas(search, "query long, node long, score double")
        before, more = found, more if found is None else more.unionByName(found)
        found = common.stored(more.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r"), "best")
        common.forget(now, *[t for t in (before,) if t is not None])
    if found is None:
        return spark.createDataFrame([], shape)
    found = found.join(ids, "node")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    # Every query gets its vector's list, without itself.
    mine = sound.where("q").select("key", F.col("id").alias("query_id")).join(nodes.select("key", F.col("node").alias("query")), "key").drop("key")
    out = mine.join(found, "query").where("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
