"""What the operators share: tables in the shared folder, word hashing, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows in one Arrow batch; texts may be long, so far fewer than Spark's 10,000.
BATCH_ROWS = 512
#: Entries that a worker's token cache holds; later tokens are worked out each time.
CACHE_ENTRIES = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python in batches of BATCH_ROWS."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def local(spark: SparkSession, rows: list[tuple], shape: T.StructType | str) -> DataFrame:
    """A small table of ``rows``, by way of Arrow: executors start no second kind of Python workers, which would stay beside those of the operators."""
    shape = T.StructType.fromDDL(shape) if isinstance(shape, str) else shape
    kinds = to_arrow_schema(shape)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds), shape)


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only in local mode, as in tests, a temporary folder stands in for an unset one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="strandline-")
        found = _own[app]
    return f"{found.rstrip('/')}/strandline-{spark.sparkContext.applicationId}"


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, total: Column | str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: the lineage ends there.

    What the writing counted is kept: ``_rows``, and ``_total``, the sum of ``total``.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    figures = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias("s") for c in (total,) if c is not None]
    seen = Observation()
    df.observe(seen, *figures).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    try:
        got = seen.get
    except Py4JJavaError:  # a plan that turns out empty has nothing to observe
        got = out.agg(*figures).first().asDict()
    out._stored_at, out._rows, out._total = path, got["n"], got.get("s") or 0
    return out


def at_most(df: DataFrame, n: int) -> bool:
    """Whether ``df`` has no more than ``n`` rows; what a stored table's writing counted serves."""
    rows = getattr(df, "_rows", None)
    return (df.limit(n + 1).count() if rows is None else rows) <= n


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _discard_own() -> None:
    import shutil

    for d in _own.values():
        shutil.rmtree(d.removeprefix("file://"), ignore_errors=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that ``df`` doesn't have."""
    there = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in there:
            name = f"_{name}"
        there.add(name.lower())
        out.append(name)
    return out


#: What this worker keeps from task to task, for one operator's use.
kept: list[dict] = []


def released(*keep: dict) -> None:
    """Give memory that this worker has freed, and what it kept beside ``keep``, back to the system: the next stage's work starts with little."""
    for cache in kept:
        if not any(cache is k for k in keep):
            cache.clear()
    gc.collect()
    trimmed()


def trimmed() -> None:
    """Give freed memory alone back, which takes a millisecond or two: for the end of a group or a fold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; memory stays with the worker


def parts_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd multipliers, one for each place in a shingle.
_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words, from the words' hashes."""
    m = len(h) - n + 1
    out = h[:m] * _FACTORS[0]
    for k in range(1, n):
        out += h[k : k + m] * _FACTORS[k % 64] + np.uint64(k // 64)
    return mixed(out)


#: Bytes that are hashed at a time, and the powers that a byte's place there has.
_STEP = 1 << 20
_BYTES = mixed(np.arange(1001, 1257, dtype=np.uint64))
_FOLDED = _BYTES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C17
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(_STEP + 1, base, np.uint64)
            x[0] = 1
            _powers.append(np.cumprod(x, dtype=np.uint64))
    return _powers


def word_hashes(texts: list[bytes], fold_case: bool = False, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts in order, number of words of each text).

    A word is a run of bytes outside of ``gaps`` (256 truth values, that of the space among them;
    ASCII white space if not given); ``fold_case`` takes A-Z as a-z.
    A word's hash is a polynomial in its bytes' random values, modulo 2**64, so that
    differences of running sums give the hashes of all words of a buffer at once.
    """
    table = _FOLDED if fold_case else _BYTES
    counts = np.zeros(len(texts), np.int64)
    parts = []
    k = 0
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and (j == k or size + len(texts[j]) + 1 <= _STEP):
            size += len(texts[j]) + 1
            j += 1
        buffer = np.frombuffer(b" ".join(texts[k:j]) + b" ", np.uint8)
        space = gaps[buffer]
        before = np.concatenate(([True], space[:-1]))
        starts = np.flatnonzero(~space & before)
        ends = np.flatnonzero(space & ~before)
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[k:j]])))
        counts[k:j] = np.diff(np.searchsorted(starts, offsets))
        out = np.zeros(len(starts), np.uint64)
        # A single text may be longer than a step; words on a cut are summed over both sides.
        for at in range(0, len(buffer), _STEP):
            piece = buffer[at : at + _STEP]
            power, inverse = _power_tables()
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[piece] * power[: len(piece)], dtype=np.uint64)))
            lo, hi = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, at + len(piece), side="left")
            a, b = starts[lo:hi], ends[lo:hi]
            first, last = np.maximum(a, at) - at, np.minimum(b, at + len(piece)) - at
            value = (total[last] - total[first]) * inverse[first]
            # A word that began in an earlier piece goes on at a later power.
            cut = np.flatnonzero(a < at)
            for c in cut:
                value[c] *= np.uint64(pow(_BASE, int(at - a[c]), 1 << 64))
            out[lo:hi] += value
        parts.append(mixed(out + (ends - starts).astype(np.uint64)))
        k = j
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


#: Rows of ids that are broadcast at most (16 MB of numbers).
BROADCAST_ROWS = 1_000_000


def hinted(ids: DataFrame) -> DataFrame:
    """``ids``, narrow rows, to be broadcast if they are counted to be few enough."""
    return F.broadcast(ids) if at_most(ids, BROADCAST_ROWS) else ids


#: Rows of one key from which a join splits it, and into how many parts.
HOT_ROWS, SALTS = 2_000, 64


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``lookup`` on ``key``, where frequent keys of ``rows`` are split by ``spread``.

    At most 1,000 keys, the most frequent ones, are split; their rows of ``lookup`` are repeated for each part.
    ``rows`` should be a stored table: it is read twice.
    """
    if getattr(rows, "_rows", HOT_ROWS) < HOT_ROWS:
        return rows.join(lookup, key, how)
    top = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), key).limit(1000).where(F.col("_n") >= HOT_ROWS).collect()
    if not top:
        return rows.join(lookup, key, how)
    hot = F.broadcast(local(rows.sparkSession, [(r[0], True) for r in top], f"{key} long, _hot boolean"))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    parts = F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), SALTS - 1).otherwise(0)))
    left = rows.join(hot, key, "left").withColumn("_part", part).drop("_hot")
    right = lookup.join(hot, key, "left").withColumn("_part", parts).drop("_hot")
    return left.join(right, [key, "_part"], how).drop("_part")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: (node, root), root the smallest node.

    Alternates large-star and small-star steps until neither changes an edge; then every
    node has one edge, to a node without one.  The number of rounds grows with the logarithm of the longest
    chain.  Every round is a written table, and frequent nodes are split in its joins.
    Nodes without an edge to another node are left out.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Large star: a node's larger neighbours point to the smallest node around it.
        low = e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        met = salted_join(e, low, "b", "a", "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().cast("int").alias("moved"))
        met = stored(met.groupBy("a", "b").agg(F.max("moved").alias("moved")), "star", "moved")
        forget(e)
        # Small star: a node and its smaller neighbours point to the smallest of them.
        low = met.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(met, low, "a", "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(1).alias("moved"))
        small = small.union(low.select("a", F.col("m").alias("b"), F.lit(0)))
        e = stored(small.groupBy("a", "b").agg(F.max("moved").alias("moved")), "star", "moved")
        forget(met)
        if not met._total and not e._total:
            break
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
    out._stored_at = e._stored_at  # what forget() deletes
    return out
