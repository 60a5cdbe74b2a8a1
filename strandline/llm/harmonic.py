"""Harmonic packing of documents into sequences, with cuts that make lengths fit their classes.

A piece of length t is of class j = capacity div t, and a sequence of class j holds j pieces of
that class, whatever they are, so every worker fills its own sequences as pieces come:
nothing is shuffled and no lengths are counted first.  What a class wastes is known
beforehand: capacity - j * t at most.  Documents are cut into the fewest pieces of lengths
that waste no more than ``slack``; of several such cuts the one that wastes least is taken.

Each worker ends with one unfilled sequence a class, and their pieces are dealt to fewer
workers, which fill sequences in the same way, until one worker's share (``MERGE`` tokens) is
left.  What stays unfilled there, fewer tokens than one sequence a class, is laid end to end and
cut at the capacity, the last sequence at powers of two, which need no padding.

Every task fills sequences of its own, so a repeated task may meet its rows in any order.
Null texts are empty: their only id is the end id.  Rows that repeat an id are packed each;
an id may be null.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

CAPACITY = 2048
#: A class's sequences may waste one in so many tokens.
SLACK = 128
#: Tokens of unfilled sequences that one worker takes over, about.
MERGE = 4_000_000
#: Pre-tokens that a worker keeps, and characters that it encodes at a time, for it holds unfilled sequences as well.
CACHE_ENTRIES, CHARACTERS = 500_000, 1_000_000
#: Pieces in a batch that a worker hands on.
ROWS = 20_000


def cuts(capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, ...]]:
    """Of each length below ``capacity`` the lengths of its pieces, longest first."""
    t = np.arange(1, capacity)
    waste = capacity - capacity // t * t
    fits = waste * slack <= capacity
    share = np.where(fits, waste / (capacity // t), np.inf)  # what a piece of each length wastes
    pieces, padding, last = np.zeros(capacity, np.int64), np.zeros(capacity), np.zeros(capacity, np.int64)
    good = t[fits]
    for n in range(1, capacity):
        x = good[good <= n]
        cost = np.lexsort((-x, padding[n - x] + share[x - 1], pieces[n - x]))[0]
        last[n] = x[cost]
        pieces[n], padding[n] = pieces[n - last[n]] + 1, padding[n - last[n]] + share[last[n] - 1]
    out: list[tuple[int, ...]] = [()]
    for n in range(1, capacity):
        out.append(tuple(sorted((*out[n - last[n]], int(last[n])), reverse=True)))
    return out


class Bins:
    """One worker's sequences: an unfilled one for each class, closed when its class's number of pieces is there."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.open = capacity, first, {}

    def put(self, piece: tuple, length: int) -> list[tuple[tuple, int, int]]:
        """The pieces of the sequence that this one fills, with their sequence and place there."""
        j = self.capacity // length
        held = self.open.setdefault(j, [])
        held.append((piece, length))
        if len(held) < j:
            return []
        del self.open[j]
        return self.close(held)

    def close(self, held: list[tuple[tuple, int]]) -> list[tuple[tuple, int, int]]:
        out, at = [], 0
        for piece, length in held:
            out.append((piece, self.next, at))
            at += length
        self.next += 1
        return out

    def left(self) -> Iterator[tuple[tuple, int]]:
        for j in sorted(self.open):
            yield from self.open[j]


def laid_end_to_end(pieces: list[tuple], capacity: int) -> Iterator[list[tuple[tuple, int]]]:
    """Sequences of (d, start, ids, doc_tokens) pieces in their order, cut at ``capacity``, the last one at powers of two."""
    total = sum(len(p[2]) for p in pieces)
    sizes = [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length(), -1, -1) if total % capacity >> k & 1]
    at = used = 0
    for size in sizes:
        held, room = [], size
        while room:
            d, start, ids, n = pieces[at]
            part = ids[used : used + room]
            held.append(((d, start + used, part, n), len(part)))
            room -= len(part)
            used += len(part)
            if used == len(ids):
                at, used = at + 1, 0
        yield held


def _batches(rows: Iterator[tuple], kind: pa.DataType, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Batches of (piece, sequence, place); the ids stay where a piece has no sequence yet."""
    names = ["d", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [kind, *[pa.int64()] * 6, pa.binary()]
    out: list[list] = [[] for _ in names]

    def batch() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
        for c in out:
            c.clear()
        return got

    for (d, start, ids, n), sequence, at in rows:
        data = ids.astype("<u4").tobytes()
        for c, v in zip(out, (d, start, len(ids), zlib.crc32(data), n, sequence, at, data if with_ids or sequence is None else None)):
            c.append(v)
        if len(out[0]) >= ROWS:
            yield batch()
    if out[0]:
        yield batch()


def filled(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> list[DataFrame]:
    """Stored tables of pieces (d, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids), one of each level of workers."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("d"), F.coalesce(text_col, F.lit("")).alias("t"))
    shape = f"d {rows.schema['d'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    pattern = cuts(capacity, slack)

    def first_id(level: int) -> int:
        from pyspark import TaskContext

        return level << 56 | TaskContext.get().partitionId() << 32

    def cut(batches):
        from strandline.llm import tokens

        tokens.released()
        encoder, end, kinds = tokens.encoder(tokenizer_path, CACHE_ENTRIES), np.array([end_id]), []
        bins = Bins(capacity, first_id(0))

        def placed():
            for b in batches:
                kinds.append(b.column("d").type)
                ids_of, texts = b.column("d").to_pylist(), b.column("t").to_pylist()
                for at, some in tokens.chunks(texts, CHARACTERS):
                    for k, x in enumerate(encoder.encode(some)):
                        x = np.concatenate((x, end))
                        n, start = len(x), 0
                        for length in [capacity] * (n // capacity) + [*pattern[n % capacity]]:
                            yield from bins.put((ids_of[at + k], start, x[start : start + length], n), length)
                            start += length
            for piece, _ in bins.left():
                yield piece, None, None

        got = placed()
        some = next(got, None)
        if some is not None:
            yield from _batches((x for part in ([some], got) for x in part), kinds[0], with_ids)

    def merge(level: int, last: bool):
        def run(batches):
            bins, kinds = Bins(capacity, first_id(level)), []

            def placed():
                for b in batches:
                    kinds.append(b.column("d").type)
                    for d, start, ids, n in zip(*(b.column(c).to_pylist() for c in ("d", "start", "ids", "doc_tokens"))):
                        x = np.frombuffer(ids, "<u4")
                        yield from bins.put((d, start, x, n), len(x))
                left = [p for p, _ in bins.left()]
                if last:
                    for held in laid_end_to_end(left, capacity):
                        yield from bins.close(held)
                else:
                    for piece in left:
                        yield piece, None, None

            got = placed()
            some = next(got, None)
            if some is not None:
                yield from _batches((x for part in ([some], got) for x in part), kinds[0], with_ids)

        return run

    # Far more than workers leave: a sequence of each class.
    share = max(MERGE, 16 * capacity * len({capacity // t for c in pattern for t in c}))
    unfilled = F.when(F.col("sequence_id").isNull(), F.col("length")).otherwise(0)
    tables = [common.stored(rows.mapInArrow(cut, shape), "filled", unfilled)]
    while tables[-1]._total:
        # Each worker leaves fewer tokens than one sequence a class, so far fewer than it takes over.
        workers = -(-tables[-1]._total // share)
        left = tables[-1].where("sequence_id is null").repartition(workers)
        tables.append(common.stored(left.mapInArrow(merge(len(tables), workers == 1), shape), "filled", unfilled))
    return tables


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document, its sequence and its place there; with ``with_ids`` also its ids, as little-endian 32-bit numbers."""
    every = filled(docs, tokenizer_path, end_id, capacity, slack, id_col, text_col, with_ids)
    out = reduce(DataFrame.unionByName, [t.where("sequence_id is not null") for t in every]).withColumnRenamed("d", id_col)
    return out if with_ids else out.drop("ids")
