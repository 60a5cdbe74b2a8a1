"""Toxicity by weak supervision.

Voters: a fixed lexicon of insults, fixed patterns, and mined lexicons (word
beginnings that occur in far more toxic than other labelled texts).  A generative
label model gives every voter its own rate of firing on either class and estimates, from the
same posteriors, which voters fire together within a class; a voter's evidence is
divided by how much of it others repeat.  The model is fitted by EM to the votes on
labelled and unlabelled texts alike: no row's class is given to it.  The labelled rows
tell which class is which (they give the rates that EM begins with and that weigh as a prior of
``ANCHOR`` texts), and how far posteriors and labels agree.  A linear classifier is then trained on
the posterior labels and scores whole texts in one pass.

The fit uses bounded samples: at most ``SAMPLE_ROWS`` labelled rows and
``SAMPLE_BYTES`` bytes of their text, and ``MORE_ROWS`` and ``MORE_BYTES`` of unlabelled ones, those with
the smallest hashes of their ids.  Only text enters a score.  Null texts count as empty; repeated
label rows of one id count once (toxic if any says so); with no labelled rows at all, or one class only, the
fixed voters decide.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

#: Labelled rows, and bytes of their texts, that a fit uses at most.
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 48_000_000
#: Unlabelled rows, and bytes of their texts, that a fit uses at most; texts that the given rates weigh as.
MORE_ROWS, MORE_BYTES, ANCHOR = 3_000, 16_000_000, 200.0
#: Correlation within a class from which voters share their evidence.
TOGETHER = 0.7
#: Mined word beginnings that become voters at most, and their lengths in letters.
MINED, LENGTHS = 160, (3, 4, 5, 6, 7)
#: From this score on a document counts as toxic.
THRESHOLD = 0.3

INSULTS = (
    "asshole", "bastard", "bitch", "clown", "coward", "creep", "crap", "cretin", "cunt", "degenerate", "dickhead",
    "disgusting", "dumb", "dumbass", "failure", "fool", "freak", "garbage", "idiot", "idiotic", "imbecile", "jerk",
    "loser", "lowlife", "maggot", "moron", "parasite", "pathetic", "pig", "pissed", "prick", "repulsive", "scum",
    "shit", "shut", "slut", "stupid", "subhuman", "trash", "twat", "ugly", "vermin", "vile", "whore", "worthless",
    "arschloch", "abschaum", "dummkopf", "drecksau", "hurensohn", "schlampe", "versager", "wichser", "missgeburt",
    "connard", "connasse", "salaud", "salope", "ordure", "abruti", "crétin", "enculé", "minable", "pourriture",
    "cabrón", "gilipollas", "imbécil", "mierda", "puta", "basura", "estúpido", "escoria", "pendejo", "idiota",
)

#: Patterns on lower-case text, each with substrings of which one is in every match.
PATTERNS = (
    (r"\b(?:you|they|he|she)(?:'re| are| is)? (?:all |just |such )?(?:an? )?(?:disgusting|stupid|worthless|pathetic|ugly)\b", ("disgusting", "stupid", "worthless", "pathetic", "ugly")),
    (r"\bi (?:will|'ll|am going to|wanna) (?:kill|hurt|find|beat|destroy)\b", (" kill", " hurt", " find", " beat", " destroy")),
    (r"\b(?:go|should|deserve to) (?:die|kill yourself|rot)\b", (" die", " kill yourself", " rot")),
    (r"\b(?:hate|despise) (?:you|them|those|these)\b", ("hate ", "despise ")),
    (r"\bf+[u*@#]+c*k+\w*|\bs+h+[i1!*]+t+\b|\bb[i1!*]tch\w*", ("fu", "f*", "f@", "f#", "sh", "tch")),
    (r"[!?]{3,}", ("!!", "??", "!?", "?!")),
)

_LETTERS = re.compile(r"[^\W\d_]+")


class _Index(dict):
    """A token to the numbers of the voters that its words fire."""

    def __init__(self, starts: dict[str, int], insults: int):
        super().__init__()
        self.starts, self.insults, self.fixed = starts, insults, frozenset(INSULTS)
        least = min(LENGTHS)
        self.gate = {p[:least] for p in (*starts, *INSULTS)}
        self.least = least

    def __missing__(self, token: str) -> tuple[int, ...]:
        low = token.lower()
        words = (low,) if low.isalpha() else _LETTERS.findall(low)
        out: tuple[int, ...] = ()
        for w in words:
            if w[: self.least] in self.gate:
                out += tuple(self.starts[p] for k in LENGTHS if len(w) >= k and (p := w[:k]) in self.starts)
                if w in self.fixed:
                    out += (self.insults,)
        if len(self) < common.CACHE_ENTRIES:
            self[token] = out
        return out


class _Starts(dict):
    """A token to the beginnings of its words."""

    def __missing__(self, token: str) -> tuple[str, ...]:
        out = tuple(w[:k] for w in _LETTERS.findall(token.lower()) for k in LENGTHS if len(w) >= k)
        if len(self) < common.CACHE_ENTRIES:
            self[token] = out
        return out


@dataclass
class Model:
    """Voters, their background rates, the label model and the linear classifier."""

    starts: list[str] = field(default_factory=list)
    rates: np.ndarray = field(default_factory=lambda: np.full(1, 1e-4))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    accuracies: dict = field(default_factory=dict)
    index: _Index | None = None

    def voters(self) -> int:
        return len(self.starts) + 1 + len(PATTERNS)

    def __getstate__(self):
        return self.__dict__ | {"index": None}

    def features(self, text: str | None) -> np.ndarray:
        """How far each voter's hits exceed its background, for the text's length."""
        n = len(self.starts)
        if self.index is None:
            self.index = _Index({p: k for k, p in enumerate(self.starts)}, n)
        text = text or ""
        words = text.split()
        counts = np.zeros(n + 1)
        hits = [k for hit in filter(None, map(self.index.__getitem__, words)) for k in hit]
        if hits:
            counts += np.bincount(hits, minlength=n + 1)
        expected = (len(words) + 1) * self.rates
        x = np.clip((counts - expected) / np.sqrt(expected + 0.3), -1.5, 6.0)
        low = text.lower()
        p = [min(3.0, math.log1p(sum(1 for _ in r.finditer(low)))) if any(k in low for k in keys) else 0.0 for r, keys in _patterns()]
        top = np.sort(x)[::-1][:3]
        return np.concatenate((x, p, [top[0], top.sum() / 3, math.log1p(counts[n])], [1.0]))

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            hits = self.features(text)[-2]
            return 1 / (1 + math.exp(3.0 - 4.0 * float(hits)))
        return 1 / (1 + math.exp(-float(np.clip(self.features(text) @ self.weights, -30, 30))))


_compiled: list = []


def _patterns() -> list:
    if not _compiled:
        _compiled.extend((re.compile(p), keys) for p, keys in PATTERNS)
    return _compiled


def _mine(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Word beginnings with the largest excess of toxic texts among those that hold them."""
    seen, bad = Counter(), Counter()
    known = _Starts()
    for text, y in zip(texts, toxic):
        starts = set().union(*map(known.__getitem__, set(text.split())))
        seen.update(starts)
        if y:
            bad.update(starts)
    base = min(0.9, max(1e-3, toxic.mean()))
    # A single text's accidents aren't evidence: what occurs in few toxic texts is left out.
    least = max(3, int(0.004 * toxic.sum()))
    score = {}
    for p, b in bad.items():
        n = seen[p]
        if b >= least and b / n >= 1.8 * base:
            score[p] = (b - n * base) / math.sqrt(n * base * (1 - base))
    best = sorted(score, key=lambda p: (-score[p], len(p), p))[: 6 * MINED]
    # A longer beginning stays only if it says more than the shorter one it extends.
    kept: list[str] = []
    for p in best:
        if any(p.startswith(q) and score[q] >= score[p] and seen[p] >= 0.8 * seen[q] for q in kept):
            continue
        if score[p] >= 3.5:
            kept.append(p)
        if len(kept) == MINED:
            break
    return kept


def label_model(votes: np.ndarray, fire1: np.ndarray, fire0: np.ndarray, prior: float, anchor: float = ANCHOR, rounds: int = 50) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 from 0/1 votes (texts x voters); ``fire1``, ``fire0`` and ``prior`` say which class is which.

    Every voter fires at its own rate on either class.  Voters that fire together
    within a class, beyond chance, share their evidence: a voter's log odds are
    divided by one plus the sum of its positive within-class correlations.  The given rates
    are where EM begins, and count as ``anchor`` texts.
    """
    first1, first0, first = np.clip(fire1, 1e-4, 1 - 1e-4), np.clip(fire0, 1e-4, 1 - 1e-4), float(np.clip(prior, 1e-3, 0.999))
    fire1, fire0, prior, share = first1, first0, first, np.ones(votes.shape[1])
    q = np.full(len(votes), first)
    for step in range(rounds):
        logit = math.log(prior / (1 - prior)) + votes @ (share * np.log(fire1 / fire0)) + (1 - votes) @ (share * np.log((1 - fire1) / (1 - fire0)))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved, q = np.abs(new - q).max(initial=0), new
        resid1, resid0 = votes - fire1, votes - fire0
        cov = (resid1 * q[:, None]).T @ resid1 + (resid0 * (1 - q)[:, None]).T @ resid0
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        rho = np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(rho, 0)
        share = 1 / (1 + np.where(rho > TOGETHER, rho, 0).sum(1))
        w1, w0 = anchor * first, anchor * (1 - first)
        fire1 = np.clip((q @ votes + w1 * first1) / (q.sum() + w1), 1e-4, 1 - 1e-4)
        fire0 = np.clip(((1 - q) @ votes + w0 * first0) / ((1 - q).sum() + w0), 1e-4, 1 - 1e-4)
        prior = float(np.clip((q.sum() + w1) / (len(q) + anchor), 1e-3, 0.999))
        if step and moved < 1e-4:
            break
    return q, {"fires_on_toxic": fire1, "fires_on_other": fire0, "share": share, "correlations": rho, "prior": prior}


def linear(x: np.ndarray, q: np.ndarray, ridge: float = 2.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels, by Newton's method; the last column is the constant."""
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - q) + pull * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit_texts(texts: list[str], toxic: list[int], more: list[str] | None = None) -> Model:
    """Fit on labelled ``texts`` and unlabelled ``more``."""
    y = np.array(toxic, dtype=np.int64)
    model = Model()
    if not len(y) or y.min() == y.max():
        return model
    model.starts = _mine(texts, y)
    # Background rates: hits per word of the texts that aren't labelled toxic.
    index = _Index({p: k for k, p in enumerate(model.starts)}, len(model.starts))
    counts, words = np.zeros(len(model.starts) + 1), 0
    for text, label in zip(texts, y):
        if not label:
            tokens = text.split()
            words += len(tokens)
            for hit in map(index.__getitem__, tokens):
                for k in hit:
                    counts[k] += 1
    model.rates = (counts + 0.5) / (words + 1000)
    x = np.array([model.features(t) for t in [*texts, *(more or [])]])
    # A voter fires above the cut that parts the labelled classes best.
    lex = x[:, : model.voters()]
    known = lex[: len(y)]
    cuts = np.zeros(lex.shape[1])
    for k in range(lex.shape[1]):
        # Only hits above the background count, or short texts without any would fire all voters.
        tries = np.unique(np.maximum(np.quantile(known[:, k], (0.5, 0.7, 0.8, 0.9, 0.95, 0.98)), 0.0))
        gain = [(known[y == 1, k] > c).mean() - (known[y == 0, k] > c).mean() for c in tries]
        cuts[k] = tries[int(np.argmax(gain))]
    model.cuts = cuts
    votes = (lex > cuts).astype(float)
    given = votes[: len(y)]
    fire1, fire0 = (y @ given + 0.5) / (y.sum() + 1), ((1 - y) @ given + 0.5) / ((1 - y).sum() + 1)
    q, model.accuracies = label_model(votes, fire1, fire0, float(y.mean()))
    model.accuracies["agreement"] = float(((q[: len(y)] >= 0.5) == (y == 1)).mean())
    model.weights = linear(x, q)
    return model


def _bounded(rows: list, sizes: dict, most: int) -> list:
    """The first of ``rows`` whose texts fit into ``most`` bytes together."""
    taken, total = [], 0
    for r in rows:
        if r[0] in sizes and total + sizes[r[0]] <= most:
            total += sizes[r[0]]
            taken.append(r)
    return taken


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the bounded samples of ``labels`` (id, 0/1 label) and of ``docs`` without one, in one task; the sampled ids, at most SAMPLE_ROWS + MORE_ROWS, are broadcast."""
    spark = docs.sparkSession
    common.small_batches(spark)
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    gold = [(r[0], r[1]) for r in one.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS).collect()]
    if not gold:
        return Model()
    free = docs.where(F.col(id_col).isNotNull()).select(id_col).join(labels.select(id_col).distinct(), id_col, "left_anti").distinct()
    free = [(r[0], -1) for r in free.orderBy(F.xxhash64(id_col), id_col).limit(MORE_ROWS).collect()]
    ids = common.local(spark, gold + free, one.schema)
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    sizes = texts.join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.min(F.octet_length("t")).alias("size")).collect()
    sizes = {r[0]: r[1] for r in sizes}
    taken = _bounded(gold, sizes, SAMPLE_BYTES) + _bounded(free, sizes, MORE_BYTES)
    ids = common.local(spark, taken, one.schema)
    got = texts.join(F.broadcast(ids), id_col).groupBy(id_col, "y").agg(F.min("t").alias("t")).select(F.col(id_col).alias("d"), "t", "y")

    def fitted(batches):
        common.released()
        found = {d: (t, y) for b in batches for d, t, y in zip(*(b.column(c).to_pylist() for c in ("d", "t", "y")))}
        order = sorted(found)
        known = [found[k] for k in order if found[k][1] >= 0]
        model = fit_texts([t for t, _ in known], [y for _, y in known], [found[k][0] for k in order if found[k][1] < 0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        common.released()

    # The driver gets the model alone: texts and counts of the sample stay with a task.
    row = got.coalesce(1).mapInArrow(fitted, "model binary").first()
    return pickle.loads(row[0]) if row else Model()  # no partition: none of the labelled documents is there


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the toxicity of each whole text in ``out``; the text's nulls count as empty."""
    from pyspark.sql import types as T

    common.small_batches(docs.sparkSession)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != out), T.StructField(out, T.DoubleType())])
    kept = docs.drop(out)

    def score(batches):
        common.released()
        for b in batches:
            s = pa.array([model.score(t) for t in b.column(text_col).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, out])
        model.index = None  # its tokens, up to CACHE_ENTRIES
        common.released()

    return kept.mapInArrow(score, schema)
