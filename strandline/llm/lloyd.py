"""Dual-tree Lloyd: exact k-means on integer vectors by a tree over vectors and a tree over centroids.

Vectors are held in shards of ``SHARD``, as they are read, so nothing is shuffled.  A shard has
a cover tree that is built once: a node's children are picked farthest first, so they
lie apart at least as far as they cover.  Every round builds such a tree over the
centroids and walks both from their roots.  For a vector node with centre p and radius r,
a centroid node with centre c and radius s holds no nearest centroid if
|p - c| - r - s > |p - c'| + r for some other centroid c' in view.  A vector node with one centroid left is
assigned as a whole, with the sum that its shard keeps; pairs of leaves are compared exactly.
Bounds are widened by more than a float's error, so ties are always compared.

Only sums by centroid leave the shards: ``k`` times the dimensions numbers a task, added up by Spark.

Vectors that are null, of another length, or hold null or non-finite components take no part.
Rows that repeat an id are clustered each; a row without an id is clustered, but isn't a first centroid.
Of equal centroids the smallest number gets the vectors.  With fewer vectors than ``k`` there are as
many centroids as vectors; an empty table gives an empty result.  Scaled components beyond 2**26 are an error,
for squared distances then exceed a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

#: Vectors in a shard; points in a leaf; children of a node at most, of vectors and of centroids.
SHARD, LEAF, FAN, CENTROID_FAN = 4_096, 16, 12, 4
#: Numbers that the centroids may be, for each task gets them all.
CENTROID_NUMBERS = 4_000_000
#: Largest scaled component.
LARGEST = 1 << 26
#: Pairs whose distances are worked out at a time.
PAIRS = 20_000


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x and y, pair by pair."""
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), PAIRS):
        d = x[i : i + PAIRS] - y[i : i + PAIRS]
        # Below 2**23 all sums are whole numbers that a double holds.
        small = not len(d) or max(-int(d.min()), int(d.max())) < 1 << 23
        out[i : i + PAIRS] = np.einsum("nd,nd->n", *[d.astype(np.float64) if small else d] * 2).astype(np.int64)
    return out


class CoverTree:
    """Nodes as arrays: ``centre`` (a row of ``x``), ``radius``, rows ``lo`` to ``hi`` of ``x``, and children ``first`` to ``first + fan``.

    ``x`` is put in the order of the leaves; ``order`` are the rows' former places.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        n = len(x)
        order = np.arange(n)
        lo, hi, centre, radius, first, count = [0], [n], [0], [0.0], [-1], [0]
        at = 0
        while at < len(lo):
            a, b = lo[at], hi[at]
            own = x[order[a:b]]
            d = squared(own, np.broadcast_to(x[centre[at]], own.shape))
            radius[at] = float(np.sqrt(d.max()))
            if b - a > leaf and d.max() > 0:
                # The node's own point is its first child's.
                nearest, owner, picked = d.copy(), np.zeros(b - a, np.int64), [centre[at]]
                while len(picked) < fan and nearest.max() > 0:
                    far = int(np.argmax(nearest))
                    picked.append(int(order[a + far]))
                    d = squared(own, np.broadcast_to(own[far], own.shape))
                    closer = d < nearest
                    nearest[closer], owner[closer] = d[closer], len(picked) - 1
                by = np.argsort(owner, kind="stable")
                order[a:b] = order[a:b][by]
                cut = a + np.searchsorted(owner[by], np.arange(len(picked) + 1))
                first[at], count[at] = len(lo), len(picked)
                for k, c in enumerate(picked):
                    for column, v in zip((lo, hi, centre, radius, first, count), (int(cut[k]), int(cut[k + 1]), c, 0.0, -1, 0)):
                        column.append(v)
            at += 1
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.order, self.x = order, x[order]
        self.lo, self.hi, self.centre = np.array(lo), np.array(hi), place[np.array(centre)]
        self.radius, self.first, self.fan = np.array(radius), np.array(first), np.array(count)

    _PARTS = ("lo", "hi", "centre", "first", "fan", "radius")

    def dumped(self) -> bytes:
        return b"".join(getattr(self, c).astype(np.float64 if c == "radius" else np.int64).tobytes() for c in self._PARTS)

    @classmethod
    def loaded(cls, x: np.ndarray, data: bytes) -> CoverTree:
        self = cls.__new__(cls)
        m = len(data) // (8 * len(cls._PARTS))
        self.x, self.order = x, np.arange(len(x))
        for k, c in enumerate(cls._PARTS):
            setattr(self, c, np.frombuffer(data, np.float64 if c == "radius" else np.int64, m, 8 * m * k))
        return self


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ..., n[i] of each, one after the other."""
    begin = np.cumsum(n) - n
    return np.repeat(first - begin, n) + np.arange(n.sum())


class Centroids:
    """The tree over one round's centroids; of equal ones the smallest number stands for all."""

    def __init__(self, centroids: np.ndarray):
        _, one = np.unique(centroids, axis=0, return_index=True)
        self.number = np.sort(one)
        self.tree = CoverTree(centroids[self.number], 1, CENTROID_FAN)
        self.number = self.number[self.tree.order]


def assigned(t: CoverTree, c: Centroids, seen: dict | None = None) -> np.ndarray:
    """The number of the nearest centroid of each row of ``t.x``; ``seen`` counts rows assigned by node and distances worked out."""
    label = np.full(len(t.x), -1, np.int64)
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole = pairs = 0
    u = c.tree
    while len(q):
        d = np.sqrt(squared(t.x[t.centre[q]], u.x[u.centre[r]]))
        pairs += len(q)
        most = np.full(len(t.lo), np.inf)
        np.minimum.at(most, q, d + t.radius[q])
        keep = d - t.radius[q] - u.radius[r] <= most[q] * (1 + 1e-9) + 1e-6
        q, r = q[keep], r[keep]
        one = u.fan[r] == 0
        alone = one & (np.bincount(q, minlength=len(t.lo))[q] == 1)
        n = (t.hi - t.lo)[q[alone]]
        label[_spans(t.lo[q[alone]], n)] = np.repeat(c.number[u.lo[r[alone]]], n)
        whole += int(n.sum())
        q, r, one = q[~alone], r[~alone], one[~alone]
        # Leaves whose centroids are all single are compared; all others go down in both trees.
        open_ = np.zeros(len(t.lo), bool)
        open_[q[~one]] = True
        done = (t.fan[q] == 0) & ~open_[q]
        a, b = q[done], r[done]
        n = t.hi[a] - t.lo[a]
        point, near = _spans(t.lo[a], n), np.repeat(u.lo[b], n)
        exact = squared(t.x[point], u.x[near])
        pairs += len(exact)
        best = np.full(len(t.x), np.iinfo(np.int64).max)
        np.minimum.at(best, point, exact)
        tie = exact == best[point]
        number = np.full(len(t.x), np.iinfo(np.int64).max)
        np.minimum.at(number, point[tie], c.number[near[tie]])
        label[point] = number[point]
        q, r = q[~done], r[~done]
        below_q, below_r = np.maximum(t.fan[q], 1), np.maximum(u.fan[r], 1)
        first_q, first_r = np.where(t.fan[q] > 0, t.first[q], q), np.where(u.fan[r] > 0, u.first[r], r)
        k = _spans(np.zeros(len(q), np.int64), below_q * below_r)
        each = np.repeat(np.arange(len(q)), below_q * below_r)
        q, r = first_q[each] + k // below_r[each], first_r[each] + k % below_r[each]
    if seen is not None:
        seen.update(whole=whole, pairs=pairs)
    return label


def sums(t: CoverTree, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of rows, sum of rows) of each label: runs of one label are differences of running sums."""
    total = np.concatenate((np.zeros((1, t.x.shape[1]), np.int64), np.cumsum(t.x, axis=0)))
    start = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    end = np.append(start[1:], len(label))
    n, s = np.zeros(k, np.int64), np.zeros((k, t.x.shape[1]), np.int64)
    np.add.at(n, label[start], end - start)
    np.add.at(s, label[start], total[end] - total[start])
    return n, s


def sound(rows: DataFrame, dims: int, vector_col: str) -> DataFrame:
    """The rows with ``dims`` components, none null or non-finite."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    return rows.where(F.coalesce((F.size(v) == dims) & fine, F.lit(False)))


def shards(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """Stored shards (ids, x, tree) of all rows, as they come."""
    kind = rows.schema[id_col].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0

        def shard() -> pa.RecordBatch:
            every, x = pa.concat_arrays(ids), np.concatenate(parts)
            t = CoverTree(x.astype(np.int64))
            every = every.take(pa.array(t.order))
            held = pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)
            return pa.RecordBatch.from_arrays([held, pa.array([t.x.astype(np.int32).tobytes()]), pa.array([t.dumped()])], names=["ids", "x", "tree"])

        for b in batches:
            for at in range(0, b.num_rows, SHARD):
                part = b.slice(at, SHARD)
                x = np.floor(part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if len(x) and np.abs(x).max() > LARGEST:
                    raise ValueError(f"scaled components beyond {LARGEST} have no exact distance in a long")
                ids.append(part.column("id"))
                parts.append(x.astype(np.int32).reshape(part.num_rows, -1))
                n += part.num_rows
                if n >= SHARD:
                    yield shard()
                    ids, parts, n = [], [], 0
        if n:
            yield shard()

    some = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return common.stored(some.mapInArrow(gather, f"ids array<{kind}>, x binary, tree binary"), "shards")


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, CoverTree]]:
    for b in batches:
        for k in range(b.num_rows):
            x = np.frombuffer(b.column("x")[k].as_py(), np.int32).reshape(-1, dims).astype(np.int64)
            yield b.column("ids")[k].values, CoverTree.loaded(x, b.column("tree")[k].as_py())


def next_centroids(held: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means of the vectors of each centroid; a centroid without vectors stays."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids(centroids)
        n, s = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, t in _trees(batches, dims):
            for total, part in zip((n, s), sums(t, assigned(t, c), k)):
                total += part
        some = np.flatnonzero(n)
        wide = np.concatenate((n[some, None], s[some]), 1)
        cols = [np.repeat(some, dims + 1), np.tile(np.arange(-1, dims), len(some)), wide.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["cluster", "place", "s"])

    got = held.select("ids", "x", "tree").mapInArrow(add, "cluster long, place long, s long").groupBy("cluster", "place").agg(F.sum("s").alias("s"))
    total = np.zeros((k, dims + 1), np.int64)
    for r in got.collect():  # k times the dimensions
        total[r["cluster"], r["place"] + 1] = r["s"]
    n = total[:, :1]
    return np.where(n > 0, total[:, 1:] // np.maximum(n, 1), centroids)


def clustered(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, cluster, distance, cluster_inertia, inertia and centroid (its components) of every vector that takes part.

    Components are floor(``scale`` * x).  The first centroids are the ``k`` vectors whose ids, after ``salt``, have the smallest SHA-256.
    """
    spark = rows.sparkSession
    if k * dims > CENTROID_NUMBERS:
        raise ValueError(f"the centroids may be {CENTROID_NUMBERS} numbers at most")
    rows = sound(rows, dims, vector_col).select(id_col, vector_col)
    kind = rows.schema[id_col].dataType.simpleString()
    held = shards(rows, scale, id_col, vector_col)
    v = F.col(vector_col).cast("array<double>")
    first = rows.where(F.col(id_col).isNotNull()).select(F.sha2(F.concat(F.lit(salt), F.col(id_col).cast("string")), 256).alias("o"), v.alias("v")).orderBy("o", "v").limit(k).collect()
    if not first and not common.at_most(held, 0):
        first = rows.select(v.alias("v")).orderBy("v").limit(1).collect()  # no vector has an id
    shape = f"`{id_col}` {kind}, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{shape}, cluster_inertia long, inertia long, centroid array<long>")
    centroids = np.floor(np.array([r["v"] for r in first], np.float64) * scale).astype(np.int64)
    for _ in range(rounds):
        centroids = next_centroids(held, centroids)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids(centroids)
        for ids, t in _trees(batches, dims):
            found = assigned(t, c)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.astype(np.int32)), pa.array(squared(t.x, centroids[found]))], names=[id_col, "cluster", "distance"])

    out = common.stored(held.select("ids", "x", "tree").mapInArrow(label, shape), "clusters", "distance")
    # One row a cluster.
    sizes = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    table = spark.createDataFrame([(j, s, out._total, centroids[j].tolist()) for j, s in sizes.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return out.join(F.broadcast(table), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: str) -> Column:
    """Lowercase hex SHA-256 of a centroid's components, as decimal integers with commas between."""
    return F.sha2(F.array_join(F.col(centroid).cast("array<string>"), ","), 256)
