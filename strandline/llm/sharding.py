"""Sharding by balanced label propagation, in DataFrame operations only.

Documents are linked through hubs (here: equal texts).  Documents of one hub in one
shard are interchangeable, so the state of the propagation is a table of cells (hub,
shard, rows).  In each round every hub names the shard that holds most of it among those
with room, or of all where none has (ties by hash, anew in each round); its cells
elsewhere ask to move there.  Requests are summed by (from, to, gain), a table of at
most SHARDS * SHARDS * 64 rows, and the driver grants them by falling gain: opposite ones
as swaps, others as far as the target shard's capacity allows; the cells then move by a
join.  Hubs that are still split after ROUNDS settle whole, in proportion to the room that
all others leave, so no request stays open.  Documents without a partner are ballast: they
fill what room the linked ones leave.

A hub of more than a quarter of a shard is cut into pieces beforehand, and its pieces
start side by side.  At the end documents are ranked by (shard, hub) and cut into equal
runs, so the row law is exact: shards differ by one row at most, and only groups on a
cut lie in two shards.  In each shard ballast stands at both ends, so cuts mostly meet
ballast.  Null texts equal empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

SHARDS, ROUNDS = 24, 4
#: Pieces that a shard's worth of one hub is cut into.
PIECES = 4


def _grants(asked: list, load: list[int], cap: int) -> list[tuple[int, int, int, float]]:
    """(from, to, gain, share granted): best gains first, as swaps, and while the target has room."""
    room = [cap - x for x in load]
    wanted: dict[tuple[int, int], int] = {}
    for r in asked:
        wanted[r["src"], r["dst"]] = wanted.get((r["src"], r["dst"]), 0) + r["rows"]
    swaps = {(a, b): min(n, wanted.get((b, a), 0)) for (a, b), n in wanted.items()}
    out = []
    for r in sorted(asked, key=lambda r: (-r["gain"], r["src"], r["dst"])):
        swapped = min(r["rows"], swaps[r["src"], r["dst"]])
        swaps[r["src"], r["dst"]] -= swapped
        n = max(0, min(r["rows"] - swapped, room[r["dst"]]))
        room[r["dst"]] -= n
        room[r["src"]] += n
        if swapped + n:
            out.append((r["src"], r["dst"], r["gain"], (swapped + n) / r["rows"]))
    return out


def _unit(*cols) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _by_room(room: list[int], unit: Column) -> Column:
    """A shard for each ``unit`` from 0 to 1, in proportion to ``room``."""
    bounds, acc = [], 0
    for x in room:
        acc += x
        bounds.append(acc / max(1, sum(room)))
    out = F.lit(len(room) - 1)
    for s in reversed(range(len(room) - 1)):
        out = F.when(unit < bounds[s], s).otherwise(out)
    return out


def _loads(cells: DataFrame, shards: int) -> list[int]:
    load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("rows").alias("n")).collect()}
    return [load.get(s, 0) for s in range(shards)]


def settled(cells: DataFrame, shards: int, cap: int) -> DataFrame:
    """``cells`` with each hub that lies in several shards in one, where those that lie in one leave room."""
    split = cells.groupBy("hub").agg((F.min("shard") < F.max("shard")).alias("split"))
    cells = common.stored(cells.join(split, "hub"), "cells")
    room = [max(0, cap - n) for n in _loads(cells.where("not split"), shards)]
    return cells.withColumn("shard", F.when(F.col("split"), _by_room(room, _unit("hub", F.lit(17)))).otherwise(F.col("shard"))).drop("split")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``rank``: its place, from 0, in ``order``; no partition holds more than a share of the rows."""
    spark = df.sparkSession
    df = df.repartitionByRange(common.parts_for(spark), *order).sortWithinPartitions(*order)
    df = common.stored(df.withColumn("_at", F.monotonically_increasing_id()), name)
    counts = df.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()
    # One row for each partition of the range partitioning.
    before, rows = 0, []
    for r in sorted(counts):
        rows.append((r["p"], before))
        before += r["count"]
    starts = spark.createDataFrame(rows, "_p long, _before long")
    df = df.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(starts), "_p")
    return df.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_before", "_at")


def propagate(cells: DataFrame, shards: int, cap: int, rounds: int = ROUNDS) -> DataFrame:
    """(hub, start, shard): where each cell (hub, start shard, rows) ends up; all cells of a hub in one shard."""
    spark = cells.sparkSession
    cells = common.stored(cells.select("hub", "start", F.col("start").alias("shard"), "rows"), "cells")
    for k in range(rounds):
        at = cells.groupBy("hub", "shard").agg(F.sum("rows").alias("n"))
        load = _loads(cells, shards)
        has_room = F.col("shard").isin([s for s in range(shards) if load[s] < cap])
        best = at.groupBy("hub").agg(F.max(F.struct(has_room.alias("has_room"), "n", _unit("hub", "shard", F.lit(k)).alias("tie"), "shard")).alias("top"))
        best = best.select("hub", F.col("top.shard").alias("dst"), F.col("top.n").alias("top"))
        wish = cells.join(best, "hub").withColumn("gain", F.least(F.lit(63), F.floor(F.log2(F.col("top").cast("double")) * 4)).cast("int"))
        moves = wish.where("shard <> dst")
        asked = moves.groupBy(F.col("shard").alias("src"), "dst", "gain").agg(F.sum("rows").alias("rows")).collect()
        if not asked:
            break
        granted = _grants(asked, load, cap)
        if not granted:
            continue  # ties fall otherwise in the next round
        granted = spark.createDataFrame(granted, "src int, dst int, gain int, share double")
        moved = wish.join(F.broadcast(granted), (F.col("shard") == granted["src"]) & (wish["dst"] == granted["dst"]) & (wish["gain"] == granted["gain"]), "left")
        go = F.coalesce(_unit("hub", F.lit(k)) < F.col("share"), F.lit(False))
        cells = common.stored(moved.select("hub", "start", F.when(go, wish["dst"]).otherwise(F.col("shard")).alias("shard"), "rows"), "cells")
    return settled(cells, shards, cap).select("hub", "start", "shard")


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size (bytes of the text and 8), text_crc32, hub, shard and slot; the law is ``rows``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("d"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.unhex(F.sha2(text, 256)).alias("hub"),
    )
    rows = common.stored(rows, "nodes")
    total = rows.count()
    if not total:
        return rows.select(F.col("d").alias(id_col), "size", F.col("crc").alias("text_crc32"), "hub", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = -(-total // shards)
    hubs = rows.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1")
    # Hubs of over a quarter of a shard: at most 4 * SHARDS of them, so they are broadcast.
    big = hubs.where(F.col("n") * PIECES > share).select("hub", F.ceil(F.col("n") * PIECES / share).cast("int").alias("pieces")).limit(PIECES * shards)
    rows = rows.join(F.broadcast(big), "hub", "left")
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("d"), F.col("pieces"))).otherwise(0).cast("int")
    rows = rows.withColumn("piece", piece)
    # Documents start by their own hashes; pieces of large hubs, four to a shard.
    start = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("hub") % shards + F.floor(F.col("piece") / PIECES), F.lit(shards)))
    start = F.coalesce(start, F.pmod(F.xxhash64("d", F.lit(5)), F.lit(shards))).cast("int")
    rows = rows.withColumn("start", start).drop("pieces")
    rows = rows.withColumn("node", F.xxhash64("hub", "piece"))
    cells = rows.groupBy(F.col("node").alias("hub"), "start").agg(F.count("*").alias("rows"))
    # A hub of one document is ballast; cells of the others take part.
    linked = cells.join(cells.groupBy("hub").agg(F.sum("rows").alias("n")).where("n > 1").select("hub"), "hub", "left_semi")
    placed = propagate(linked, shards, share)
    placed = common.stored(placed, "placed")
    room = [max(0, share - n) for n in _loads(placed.join(cells, ["hub", "start"]), shards)]
    ballast = _by_room(room, _unit("d", F.lit(11)))
    places = placed.select(F.col("hub").alias("node"), "start", "shard")
    rows = rows.join(places, ["node", "start"], "left").withColumn("alone", F.col("shard").isNull())
    rows = rows.withColumn("shard", F.coalesce("shard", ballast).cast("int"))
    zone = F.when(~F.col("alone"), 1).otherwise(F.when(_unit("d", F.lit(13)) < 0.5, 0).otherwise(2))
    order = [F.col("shard"), F.col("zone"), F.col("hub"), F.col("d")]
    rows = ranked(rows.select("d", "size", "crc", "hub", "shard", zone.alias("zone")), order, "ranked")
    # Rank r of N rows lies in run r * shards div N: runs differ by one row at most.
    run = F.expr(f"(rank * {shards}L) div {total}L").cast("int")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    rows = rows.withColumn("shard", run).withColumn("slot", F.col("rank") - first)
    return rows.select(F.col("d").alias(id_col), "size", F.col("crc").alias("text_crc32"), "hub", "shard", F.col("slot").cast("long"))
