"""Best-fit packing of documents into sequences by bin completion.

Pieces are packed by their lengths alone, so the whole problem is the number of pieces
of each length: a table of at most ``capacity`` rows, whatever the corpus.

The search takes the largest length left and enumerates the undominated fillings of the
room beside it, least waste first: a filling is dominated if a piece that is left would
still fit, or would fit in the place of one or several of its pieces.  A filling is used as often as
the counts allow, later less often.  Best-fit decreasing gives the first incumbent; its
and later incumbents' numbers of bins bound the waste that a branch may have, and the
Martello-Toth bound on what is left cuts branches off.  The search ends at the lower
bound, when it is exhausted (then the plan is optimal), or after ``nodes`` fillings or ``steps`` sums that
its enumerations looked at, dominated ones among them; it always completes
one plan, which is preferred to best fit's if it needs no more bins.  An enumeration that finds nothing
undominated among the first ``LOOKS`` sums gives the least wasteful one of them.

Pieces then meet the plan by their rank within their length.  Ranks are counted in
blocks by hash, so one very frequent length isn't one task.

Null texts are empty: their only id is the end id.  Rows that repeat an id are packed
each.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import common

CAPACITY = 4096
#: Pre-tokens that a worker keeps, and characters that it encodes at a time.
CACHE_ENTRIES, CHARACTERS = 500_000, 1_000_000
#: Fillings that the search tries, beyond the one plan that it always completes.
NODES = 5_000
#: Sums that the search looks at, and those that one enumeration looks at before it gives one.
STEPS, LOOKS = 40_000, 200
#: Levels of the search that hold their enumerations.
LEVELS = 64
#: Pieces in a block of ranks, about.
RANKS = 20_000


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on counts: (bins, lengths in each), equal bins together."""
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] += n
    out: list[tuple[int, tuple[int, ...]]] = []
    for first in range(capacity, 0, -1):
        while left[first]:
            left[first] -= 1
            bin_, room, k = [first], capacity - first, min(first, capacity - first)
            while room:
                k = min(k, room)
                while k and not left[k]:
                    k -= 1
                if not k:
                    break
                left[k] -= 1
                bin_.append(k)
                room -= k
            # As often as the counts allow.
            need = Counter(bin_)
            m = min(left[x] // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= m * n
            out.append((int(m) + 1, tuple(bin_)))
    return out


def least_bins(left: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: pieces that can't share a bin, and what of the others can't go beside them."""
    size = np.arange(capacity + 1)
    n, s = np.cumsum(left), np.cumsum(left * size)
    half = capacity // 2
    a = np.arange(1, half + 1)
    alone = n[-1] - n[capacity - a]
    beside = n[capacity - a] - n[half]
    spare = beside * capacity - (s[capacity - a] - s[half])
    small = s[half] - s[a - 1]
    bound = alone + beside + np.maximum(0, -((spare - small) // capacity))
    return int(max(bound.max(initial=0), -(-int(s[-1]) // capacity), n[-1] - n[half]))


def _spread(bits: int, width: int) -> int:
    """Each bit, and the ``width`` bits above it."""
    done = 1
    while done <= width:
        step = min(done, width + 1 - done)
        bits |= bits << step
        done += step
    return bits


def dominated(filling: Counter, left: np.ndarray, waste: int, room: int) -> bool:
    """Whether a piece that is left fits into the waste, or into the place of some pieces of the filling."""
    there = left[: room + 1] > 0
    for x, n in filling.items():
        there[x] = left[x] > n
    there[0] = False
    free = int.from_bytes(np.packbits(there, bitorder="little").tobytes(), "little")
    if free & ((1 << (waste + 1)) - 1):
        return True
    one, some, several = 0, 0, 0  # single pieces; sums of one or more, of two or more
    for x, n in filling.items():
        one |= 1 << x
        for _ in range(n):
            several |= (several << x) | (some << x)
            some |= (some << x) | (1 << x)
    larger = _spread(one << 1, waste - 1) if waste else 0
    return bool(free & (larger | _spread(several, waste)))


class Budget:
    """Sums that may still be looked at; ``cut`` tells that an enumeration ended for want of them."""

    def __init__(self, steps: int):
        self.steps, self.cut = steps, False


def fillings(left: np.ndarray, room: int, most_waste: int, budget: Budget | None = None) -> Iterator[Counter]:
    """The undominated fillings of ``room``, least waste first, then larger pieces first; the empty one if no piece fits.

    When the budget runs out the enumeration ends, after one filling at least.
    """
    budget = budget or Budget(1 << 62)
    has = left[: room + 1] > 0
    has[0] = False
    size = np.flatnonzero(has)
    if not len(size):
        if room <= most_waste:
            yield Counter()
        return
    if has[room]:
        yield Counter({room: 1})  # which dominates all others
        return
    # Pairs without waste need no table of sums.
    a = size[2 * size >= room][::-1]
    a = a[has[room - a] & ((2 * a != room) | (left[a] > 1))]
    for x in a.tolist():
        yield Counter([x, room - x])
    # Sums that the lengths up to each can reach: they name the possible wastes and guide the way down.
    sizes, reach, sums = size.tolist(), [], 1
    full = (1 << (room + 1)) - 1
    for x in sizes:
        copies, step = min(int(left[x]), room // x), 1
        while copies:
            step = min(step, copies)
            sums |= (sums << (x * step)) & full
            copies -= step
            step *= 2
        # Once small lengths reach every sum, all larger ones share one table.
        sums = reach[-1] if reach and reach[-1] == sums else sums
        reach.append(sums)

    def down(j: int, rest: int, taken: list[tuple[int, int]]) -> Iterator[Counter]:
        for k in range(j, -1, -1):
            if not reach[k] >> rest & 1:
                return
            x = sizes[k]
            for n in range(min(int(left[x]), rest // x), 0, -1):
                r = rest - n * x
                if r == 0:
                    yield Counter(dict([*taken, (x, n)]))
                elif k and reach[k - 1] >> r & 1:
                    yield from down(k - 1, r, [*taken, (x, n)])

    given, looks, least = len(a) > 0, 0, None
    for waste in range(min(room - 1, most_waste) + 1):
        if sums >> (room - waste) & 1:
            for f in down(len(sizes) - 1, room - waste, []):
                budget.steps -= 1
                looks += 1
                least = least or f
                if (waste or f.total() > 2) and not dominated(f, left, waste, room):
                    given = True
                    yield f
                if budget.steps < 0 or (not given and looks >= LOOKS):
                    budget.cut = True
                    if not given:
                        yield least
                    return


def solve(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, report: dict | None = None, steps: int = STEPS) -> list[tuple[int, tuple[int, ...]]]:
    """(bins, lengths in each) that hold all pieces, in as few bins as the search finds; ``report`` gets its figures."""
    counts = {k: n for k, n in counts.items() if n}
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    incumbent = best_fit(counts, capacity)
    best = first_fit = sum(m for m, _ in incumbent)
    bound = least_bins(left, capacity)
    total = int((left * np.arange(capacity + 1)).sum())
    # The first way down is unbounded, so that one plan of the search's own is completed; a tie goes to it.
    limit, completed, seen = 1 << 60, False, set()
    plan: list[tuple[int, tuple[int, ...]]] = []
    bins = waste = tried = 0
    optimal, budget = not counts, Budget(steps)

    def choices() -> Iterator[tuple[int, Counter, int]]:
        """(pieces' multiplicity, whole bin, its waste): every filling as often as it goes, then all less often."""
        x = int(np.flatnonzero(left)[-1])
        less, more = 0, True
        while more:
            more = False
            left[x] -= 1
            # Every bin's waste counts: a plan of fewer than ``limit`` bins has so much to spare.
            spare = (limit - 1) * capacity - total - waste
            gen = fillings(left, capacity - x, spare, budget)
            left[x] += 1
            while True:
                left[x] -= 1
                f = next(gen, None)
                left[x] += 1
                if f is None:
                    break
                whole = f + Counter([x])
                m = int(min(left[k] // n for k, n in whole.items())) - less
                if m > 0:
                    more = True
                    yield m, whole, capacity - sum(k * n for k, n in whole.items())
            less += 1

    # Choices of one level and how many are used up; only the deepest levels hold what they enumerate, the
    # others begin again when the search comes back to them, so memory doesn't grow with the depth.
    stack: list[list] = [[choices(), 0]] if counts else []
    again = False
    done: list[tuple[int, Counter, int]] = []
    while stack:
        level = stack[-1]
        if level[0] is None:
            level[0], again = itertools.islice(choices(), level[1], None), True
        got = next(level[0], None)
        level[1] += 1
        if got is None:
            stack.pop()
            if done:
                m, whole, w = done.pop()
                for k, n in whole.items():
                    left[k] += m * n
                bins, waste = bins - m, waste - m * w
            optimal = not stack and not again and not budget.cut
            continue
        m, whole, w = got
        tried += 1
        for k, n in whole.items():
            left[k] -= m * n
        bins, waste = bins + m, waste + m * w
        done.append(got)
        open_ = left.any()
        if not open_ and bins < limit:
            if bins < best or (bins == best and not completed):
                best = bins
                incumbent = [(n, tuple(sorted(c.elements(), reverse=True))) for n, c, _ in done]
            limit, completed = best, True
        state = hashlib.blake2b(left.tobytes() + bins.to_bytes(8, "little"), digest_size=16).digest()
        if open_ and state not in seen and bins + least_bins(left, capacity) < limit and waste <= (limit - 1) * capacity - total:
            seen.add(state)
            stack.append([choices(), 0])
            if len(stack) > LEVELS:
                stack[-1 - LEVELS][0] = None
        else:
            m, whole, w = done.pop()
            for k, n in whole.items():
                left[k] += m * n
            bins, waste = bins - m, waste - m * w
        if best == bound and completed:
            optimal = True
            break
        if (tried >= nodes or budget.steps < 0) and completed:
            break
    if report is not None:
        report.update(bins=best, best_fit=first_fit, bound=bound, tried=tried, completed=completed, optimal=optimal)
    return incumbent


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``d`` and, of each piece of a document's ids: piece, start, length, ids_crc32 and, if asked for, ids."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("d"), F.coalesce(text_col, F.lit("")).alias("t"))
    kind = dict(rows.dtypes)["d"]
    shape = f"d {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches):
        from strandline.llm import tokens

        tokens.released()
        encoder = tokens.encoder(tokenizer_path, CACHE_ENTRIES)
        end = np.array([end_id], np.uint32)
        for b in batches:
            d, texts = b.column("d"), b.column("t").to_pylist()
            for at, some in tokens.chunks(texts, CHARACTERS):
                out: list[list] = [[], [], [], [], [], []]
                for k, x in enumerate(encoder.encode(some)):
                    x = np.concatenate((x.astype("<u4"), end.astype("<u4")))
                    for p, s in enumerate(range(0, len(x), capacity)):
                        part = x[s : s + capacity]
                        for column, v in zip(out, (at + k, p, s, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None)):
                            column.append(v)
                cols = [d.take(pa.array(out[0])), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5])]
                cols += [pa.array(out[5], pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(cols, names=["d", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])
        tokens.released()

    return rows.mapInArrow(cut, shape)


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (d, piece, start, length, ...) with sequence_id and offset.

    ``rows`` should be a stored table: it is read for the counts, the ranks and the result.
    """
    spark = rows.sparkSession
    counts = {int(r["length"]): r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # The plan: at most a few bins' patterns for each length, so a few tens of thousands of rows.
    plan, base = [], 0
    at: Counter = Counter()
    for m, lengths in solve(counts, capacity):
        offset = 0
        for x in lengths:
            plan.append((x, at[x], base, offset))
            at[x] += m
            offset += x
        base += m
    plan.sort()
    key = np.array([(p[0] << 44) | p[1] for p in plan], np.int64)
    first, begin, offsets = (np.array([p[k] for p in plan], np.int64) for k in (1, 2, 3))

    blocks = max(1, sum(counts.values()) // RANKS)
    b = F.pmod(F.xxhash64("d", "piece", "start"), F.lit(blocks)).cast("int")
    rows = rows.withColumn("_b", b)
    sums = rows.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_before", before).drop("_n")
    order = Window.partitionBy("length", "_b").orderBy("d", "piece", "ids_crc32")
    ranked = rows.withColumn("_r", F.row_number().over(order) - 1)
    ranked = ranked.join(sums, ["length", "_b"]).withColumn("_r", F.col("_r") + F.col("_before")).drop("_b", "_before")
    names = [c for c in ranked.columns if c != "_r"]
    shape = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "_r") + ", sequence_id long, offset long"

    def place(batches):
        for x in batches:
            length, rank = (x.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_r"))
            k = np.searchsorted(key, (length << 44) | rank, side="right") - 1
            cols = [x.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(begin[k] + rank - first[k], pa.int64()), pa.array(offsets[k], pa.int64())], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, shape)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut, encode and pack whole documents: a row for each piece."""
    rows = common.stored(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, with_ids), "pieces")
    return packed(rows, capacity).withColumnRenamed("d", id_col)
