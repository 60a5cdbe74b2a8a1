"""Local alignments of pairs of sequences, many at a time.

Pairs of about one length are aligned together: the recursion goes by anti-diagonals, whose cells
don't depend on each other, so a step is a few array operations for all pairs and all
cells of a diagonal.  Scores are whole tenths, so they are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of all pairs that are aligned together, and of one pair at most.
CELLS, MOST_CELLS = 8_000_000, 400_000_000
_STOP, _DIAGONAL, _LEFT, _UP, _LEFT_ON, _UP_ON = 0, 1, 2, 3, 4, 8
_SHAPE = "score double, identity double, a_start int, a_end int, b_start int, b_end int, aligned_a string, aligned_b string, blocks array<struct<a_start:int,a_end:int,b_start:int,b_end:int>>"


def _codes(texts: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), width), pad, np.int32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    return out


def align(a: list[str], b: list[str], reward: float = 2, mismatch: float = -1, gap_open: float = -1, gap_extend: float = -0.1) -> list[tuple[float, int, int, str, str]]:
    """Best local alignment of each pair: score, first places on a and b, and the aligned texts; a score of 0 has none.

    A gap of n columns costs ``gap_open + (n - 1) * gap_extend``.  Of equal ends the one that comes first on a, then on b,
    is taken; of equal ways back a match goes before a gap in a, and that before a gap in b.
    """
    tenth = [round(10 * x) for x in (reward, mismatch, gap_open, gap_extend)]
    n, m, p = max(map(len, a), default=0), max(map(len, b), default=0), len(a)
    if not n or not m:
        return [(0.0, 0, 0, "", "")] * p
    if n * m > MOST_CELLS:
        raise ValueError(f"a pair of {n} and {m} letters has more than {MOST_CELLS} cells")
    x, y = _codes(a, n, -1), _codes(b, m, -2)
    low = -(1 << 29)
    # H, E (gap in a) and F (gap in b) on the last two diagonals, by the place on a.
    h1, h2 = np.zeros((p, n + 1), np.int32), np.zeros((p, n + 1), np.int32)
    e1, f1 = np.full((p, n + 1), low, np.int32), np.full((p, n + 1), low, np.int32)
    back = np.zeros((n + m + 1, p, n + 1), np.uint8)
    best, end_i, end_j = np.zeros(p, np.int32), np.zeros(p, np.int64), np.zeros(p, np.int64)
    for d in range(2, n + m + 1):
        i0, i1 = max(1, d - m), min(n, d - 1)
        i = np.arange(i0, i1 + 1)
        same = x[:, i - 1] == y[:, d - i - 1]
        # E comes from (i, j - 1), F from (i - 1, j), both on the last diagonal.
        e_open, e_on = h1[:, i] + tenth[2], e1[:, i] + tenth[3]
        f_open, f_on = h1[:, i - 1] + tenth[2], f1[:, i - 1] + tenth[3]
        e, f = np.maximum(e_open, e_on), np.maximum(f_open, f_on)
        diagonal = h2[:, i - 1] + np.where(same, tenth[0], tenth[1])
        h = np.maximum(np.maximum(diagonal, 0), np.maximum(e, f))
        way = np.where(h == 0, _STOP, np.where(h == diagonal, _DIAGONAL, np.where(h == e, _LEFT, _UP)))
        back[d][:, i] = way + _LEFT_ON * (e_on > e_open) + _UP_ON * (f_on > f_open)
        top = np.argmax(h, axis=1)
        value = h[np.arange(p), top]
        at = i0 + top
        better = (value > best) | ((value == best) & (value > 0) & (at < end_i))
        best, end_i, end_j = np.where(better, value, best), np.where(better, at, end_i), np.where(better, d - at, end_j)
        h2 = h1
        h1, e1, f1 = np.zeros((p, n + 1), np.int32), np.full((p, n + 1), low, np.int32), np.full((p, n + 1), low, np.int32)
        h1[:, i], e1[:, i], f1[:, i] = h, e, f
    out = []
    for k in range(p):
        i, j, state, s, t = int(end_i[k]), int(end_j[k]), 0, [], []
        while True:
            bits = int(back[i + j, k, i])
            step = bits & 3 if state == 0 else state
            if step == _STOP:
                break
            if step == _DIAGONAL:
                i, j = i - 1, j - 1
                s.append(a[k][i])
                t.append(b[k][j])
            elif step == _LEFT:
                state = _LEFT if bits & _LEFT_ON else 0
                j -= 1
                s.append("-")
                t.append(b[k][j])
            else:
                state = _UP if bits & _UP_ON else 0
                i -= 1
                s.append(a[k][i])
                t.append("-")
        out.append((best[k] / 10, i, j, "".join(reversed(s)), "".join(reversed(t))))
    return out


def _figures(score: float, i: int, j: int, s: str, t: str) -> tuple:
    """Figures of one alignment; the last column of a local one is a match and isn't counted in its identity."""
    if not s:
        return (0.0, None, None, None, None, None, "", "", [])
    if s == t and "-" not in s:
        n = len(s)
        return (score, 100.0, i, i + n - 1, j, j + n - 1, s, t, [{"a_start": i, "a_end": i + n - 1, "b_start": j, "b_end": j + n - 1}])
    columns = len(s) - 1
    wrong = sum(x.upper() != y.upper() and x != "-" and y != "-" for x, y in zip(s[:-1], t[:-1]))
    blocks, p, q, run = [], i, j, 0
    for x, y in [*zip(s, t), ("-", "-")]:
        if x != "-" and y != "-":
            run += 1
        elif run:
            blocks.append({"a_start": p - run, "a_end": p - 1, "b_start": q - run, "b_end": q - 1})
            run = 0
        p, q = p + (x != "-"), q + (y != "-")
    return (score, 100.0 * (columns - wrong) / columns if columns else 100.0, i, i + len(s) - s.count("-") - 1, j, j + len(t) - t.count("-") - 1, s, t, blocks)


def contained(a: str, b: str, reward: float = 2, mismatch: float = -1, gap_open: float = -1, gap_extend: float = -0.1) -> tuple[float, int, int, str, str] | None:
    """What ``align`` gives for a pair of which one text is a part of the other, None for other pairs.

    No alignment scores more than all letters of the shorter text do, and only its occurrences score as much; the first one ends first.
    """
    if not a or not b or reward <= 0 or mismatch > 0 or round(10 * gap_open) >= 0 or gap_extend > 0:
        return None
    score = lambda text: round(10 * reward) * len(text) / 10
    if len(b) <= len(a):
        at = a.find(b)
        return None if at < 0 else (score(b), at, 0, b, b)
    at = b.find(a)
    return None if at < 0 else (score(a), 0, at, a, a)


def local_alignments(pairs: DataFrame, a: str, b: str, reward: float = 2, mismatch: float = -1, gap_open: float = -1, gap_extend: float = -0.1) -> DataFrame:
    """``pairs`` with the best local alignment of columns a and b: score, identity (percent), the aligned places, the gapped texts and the gapless blocks.

    Texts are compared as they are; a null or empty one has a score of 0 and no alignment.
    """
    names = _SHAPE.split(", ")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            first, second = part[a].fillna("").tolist(), part[b].fillna("").tolist()
            out: list = [None] * len(part)
            for k, (x, y) in enumerate(zip(first, second)):
                got = contained(x, y, reward, mismatch, gap_open, gap_extend)
                if got:
                    out[k] = _figures(*got)
            # Pairs of like lengths go together, as many as the cells allow.
            order = sorted((k for k in range(len(part)) if out[k] is None), key=lambda k: (len(first[k]) * len(second[k]), len(first[k])))
            group: list[int] = []
            n = m = 0
            for k in [*order, -1]:
                if k >= 0:
                    n, m = max(n, len(first[k])), max(m, len(second[k]))
                if group and (k < 0 or (len(group) + 1) * (n + m + 1) * (n + 1) > CELLS):
                    for q, got in zip(group, align([first[q] for q in group], [second[q] for q in group], reward, mismatch, gap_open, gap_extend)):
                        out[q] = _figures(*got)
                    group = []
                    n, m = (len(first[k]), len(second[k])) if k >= 0 else (0, 0)
                group.append(k)
            figures = pd.DataFrame(out, columns=[x.split(" ")[0] for x in names], index=part.index)
            for c in ("a_start", "a_end", "b_start", "b_end"):
                figures[c] = figures[c].astype("Int32")
            yield pd.concat([part, figures], axis=1)

    shape = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)
    return pairs.mapInPandas(run, f"{shape}, {_SHAPE}")


def place_in_frame(snvs: DataFrame, seq: str = "seq", frame: str = "dna", at: str = "position") -> DataFrame:
    """Where a place of ``seq`` lies in the open reading frame ``frame``, by their local alignment: location, codon_start and frame_position.

    location: orf where the place is aligned with the frame; else utr5 before the frame's first base, in utr3 behind its last one, and
    null between, or where the frame's ends aren't aligned.
    """
    out = local_alignments(snvs, seq, frame)
    p, n = F.col(at), F.length(frame)
    block = F.get(F.filter("blocks", lambda x: (p >= x["a_start"]) & (p <= x["a_end"])), F.lit(0))
    inside = block["b_start"] + p - block["a_start"]
    whole = (F.col("b_start") == 0) & (F.col("b_end") == n - 1)
    place = F.when(block.isNotNull(), "orf").when(whole & (p < F.col("a_start")), "utr5").when(whole & (p > F.col("a_end")), "in utr3")
    return out.select(*snvs.columns, place.alias("location"), (inside - inside % 3).cast("long").alias("codon_start"), inside.cast("long").alias("frame_position"))
