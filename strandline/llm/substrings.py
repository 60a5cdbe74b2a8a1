"""Removal of repeated passages: windows of words that occurred before.

A window (``LENGTH`` consecutive words of one document) is removed where its words also
start earlier: in a document with a smaller id, or earlier in the same one.  Windows
are judged on the input; words that any removed window covers go.  A document is an id
with a text: different texts of one id, or without an id, are different documents, in
the order of their texts' hashes, and each loses words for its own windows only.

Shards.  A window's key is the least hash among its runs of ``GRAM`` words, so equal
windows have equal keys, and neighbouring windows mostly share one.  Windows of a key
that very many places have are dealt one by one, by their own hash, so that no key fills a shard.  A first pass finds
the keys that occur twice; a bitmap of them, of a fixed size at most, is broadcast.  A
second pass sends only stretches of windows with such keys, and by key, so that all
equal windows meet in one shard, whatever the corpus.  Stretches that repeat within a
task are sent once, with the places where they occur, so a common passage costs a
shard little.

In a shard the stretches are indexed in an FM-index and streamed against it; matching
statistics at the threshold give each window's rows, and the earliest of their places
decides.  A full bitmap only lets more stretches through: results stay whole.  Words
travel as 48-bit hashes beside the key.

Words are runs without ASCII white space, unchanged.  Null texts have none.  Rows that
repeat an id and its text (or have no id and one text) are one document, thus not earlier
than each other.  Rows without an id stand before all others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import common
from strandline.llm.fmindex import FMIndex

LENGTH, GRAM = 20, 8
#: Bytes of the broadcast bitmap at most, and its bits for each key below that.
BITMAP_BYTES, BITS_PER_KEY = 64 << 20, 16
#: Text bytes that a task folds before it sends.
FOLD = 8_000_000
#: Places from which a key's windows are dealt by their own hashes, and how many keys of a bucket are.
HOT_PLACES, HOT_KEYS = 20_000, 64
#: Bytes of text whose keys meet in one bucket, and whose stretches, were all sent, would meet in one shard.
BUCKET, SHARD = 16_000_000, 4_000_000
_NONE = -(1 << 63)
_MASK = np.uint64((1 << 48) - 1)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    k, out = 1, x
    while 2 * k <= width:
        out = pick(out[:-k], out[k:])
        k *= 2
    return pick(out[: len(out) - (width - k)], out[width - k :]) if k < width else out


class Fold:
    """Documents folded together: their words' hashes and their windows' keys."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.h, self.counts = common.word_hashes(texts)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)[:-1])).astype(np.int64)
        n = len(self.h)
        self.keys = self.valid = None
        if n < length:
            self.grams = self.keys = np.zeros(0, np.uint64)
            self.doc = self.valid = np.zeros(0, np.int64)
            return
        self.grams = common.grams(self.h, gram) | np.uint64(1)
        self.keys = _slide(self.grams, length - gram + 1, np.minimum)
        doc = np.repeat(np.arange(len(texts)), self.counts)
        self.doc = doc[: n - length + 1]
        self.valid = self.doc == doc[length - 1 :]

    def postings(self, width: int) -> np.ndarray:
        """Keys, once for each place that has the key of some window."""
        if not len(self.keys):
            return np.zeros(0, np.uint64)
        least = np.where(self.valid, self.keys, np.uint64(0))
        pad = np.zeros(width - 1, np.uint64)
        around = _slide(np.concatenate((pad, least, pad)), width, np.maximum)
        return self.grams[around == self.grams]

    def stretches(self, wanted, hot: np.ndarray) -> np.ndarray:
        """(document, first window, windows) of maximal runs of windows with one wanted key, or of one window with a hot key; windows count from the fold's beginning."""
        at = np.flatnonzero(self.valid)
        if len(at):
            at = at[wanted(self.keys[at])]
        if not len(at):
            return np.zeros((0, 3), np.int64)
        key, doc = self.keys[at], self.doc[at]
        cut = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)))
        if len(hot):
            cut |= np.isin(key, hot)
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, len(at)))
        return np.stack((doc[first], at[first], size), 1)


class Wanted:
    """The keys that occur twice, as one bitmap for each bucket; others may pass now and then."""

    def __init__(self, maps: dict[int, bytes], buckets: int, hot: np.ndarray):
        self.buckets, self.hot = buckets, np.sort(hot)
        self.size = np.zeros(buckets, np.int64)
        parts = []
        for k in range(buckets):
            m = np.frombuffer(maps.get(k, b"\0"), np.uint8)
            parts.append(m)
            self.size[k] = len(m)
        self.base = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.bits = np.concatenate(parts)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        b = (keys % np.uint64(self.buckets)).astype(np.int64)
        bit = (common.mixed(keys) % (self.size[b].astype(np.uint64) * np.uint64(8))).astype(np.int64)
        return (self.bits[self.base[b] + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _bitmap(keys: np.ndarray, most: int) -> bytes:
    size = max(1, min(most, len(keys) * BITS_PER_KEY // 8))
    bit = (common.mixed(keys) % np.uint64(8 * size)).astype(np.int64)
    out = np.zeros(8 * size, np.uint8)
    out[bit] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """Order and name of a document: its id, and its text's hash."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)), F.xxhash64(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d, h = _row_key(id_col, text_col)
    return docs.select(d.alias("d"), h.alias("h"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))


def _folds(batches, size: int = FOLD):
    keys, texts, held = [], [], 0
    for b in batches:
        for d, h, t in zip(b.column("d").to_pylist(), b.column("h").to_pylist(), b.column("t").to_pylist()):
            keys.append((d, h))
            texts.append(t)
            held += len(t)
            if held >= size:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def repeated_keys(docs: DataFrame, length: int, gram: int, id_col: str, text_col: str, buckets: int) -> Wanted:
    """The first pass: which keys occur at two places of the corpus or more."""
    most = max(1, BITMAP_BYTES // buckets)

    def send(batches):
        common.released()
        for _, texts in _folds(batches):
            key, count = np.unique(Fold(texts, length, gram).postings(length - gram + 1), return_counts=True)
            by = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(by, kind="stable")
            by, key, count = by[order], key[order], np.minimum(count[order], 65_535).astype(np.uint16)
            cut = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))) if len(by) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(by))
            yield pa.RecordBatch.from_arrays(
                [pa.array(by[cut].astype(np.int32)), pa.array([key[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary()), pa.array([count[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())],
                names=["bucket", "keys", "counts"],
            )
        common.released()

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.frombuffer(v, np.uint64) for v in part["keys"]])
        count = np.concatenate([np.frombuffer(v, np.uint16) for v in part["counts"]])
        key, inverse = np.unique(key, return_inverse=True)
        places = np.bincount(inverse.reshape(-1), weights=count, minlength=len(key))
        hot = np.flatnonzero(places >= HOT_PLACES)
        hot = hot[np.argsort(-places[hot], kind="stable")][:HOT_KEYS]
        out = pd.DataFrame({"bucket": [part["bucket"].iloc[0]], "bitmap": [_bitmap(key[places > 1], most)], "hot": [key[hot].tobytes()]})
        del key, count, inverse, places
        common.trimmed()
        return out

    dealt = _rows(docs, id_col, text_col).mapInArrow(send, "bucket int, keys binary, counts binary")
    maps = dealt.groupBy("bucket").applyInPandas(pick, "bucket int, bitmap binary, hot binary").collect()
    return Wanted({r["bucket"]: bytes(r["bitmap"]) for r in maps}, buckets, np.frombuffer(b"".join(r["hot"] for r in maps), np.uint64))


def earlier_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word spans (d, h, lo, hi) of the documents (id, text hash) that removed windows cover, from the shards; spans of one document may overlap."""
    spark = docs.sparkSession
    common.small_batches(spark)
    gram = min(gram, length)
    # What one task sorts or indexes is bounded by bytes of text, however many there are.
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets, shards = max(2 * common.parts_for(spark), -(-size // BUCKET)), max(8 * common.parts_for(spark), -(-size // SHARD))
    wanted = spark.sparkContext.broadcast(repeated_keys(docs, length, gram, id_col, text_col, buckets))

    def send(batches):
        common.released()
        for docs_, texts in _folds(batches):
            fold = Fold(texts, length, gram)
            hot = wanted.value.hot
            runs = fold.stretches(wanted.value, hot)
            # A stretch's shard is told by its key, that of a hot key's window by all its words.
            sent = common.mixed(fold.keys[runs[:, 1]]) if len(runs) else fold.keys[:0]
            if len(hot) and len(runs):
                alone = np.isin(fold.keys[runs[:, 1]], hot)
                sent[alone] = common.grams(fold.h, length)[runs[alone, 1]]
            sent = (sent % np.uint64(shards)).astype(np.int64).tolist()
            contents: dict[bytes, list[tuple[int, int]]] = {}
            words = fold.h & _MASK
            for (doc, at, size), shard in zip(runs.tolist(), sent):
                content = words[at : at + size + length - 1].tobytes()
                place = (*docs_[doc], at - int(fold.starts[doc]))
                if (known := contents.get(content)) is None:
                    contents[content] = [place]
                else:
                    known.append(place)
                if known is None:
                    contents[content].append(shard)
            by: dict[int, list] = {}
            for content, places in contents.items():
                shard = places.pop(1)
                by.setdefault(shard, []).append((content, places))
            for shard, some in sorted(by.items()):
                raw = np.frombuffer(b"".join(c for c, _ in some), np.uint8).reshape(-1, 8)[:, :6]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int32()), pa.array([raw.tobytes()], pa.binary()), pa.array([np.array([len(c) // 8 for c, _ in some], np.int32).tobytes()], pa.binary()),
                        pa.array([np.array([len(p) for _, p in some], np.int32).tobytes()], pa.binary()), pa.array([np.array([x for _, p in some for x in p], np.int64).tobytes()], pa.binary()),
                    ],
                    names=["shard", "words", "sizes", "times", "places"],
                )
        common.released()

    def search(part: pd.DataFrame) -> pd.DataFrame:
        def whole(column, kind):
            return np.concatenate([np.frombuffer(v, kind) for v in part[column]])

        six = whole("words", np.uint8).reshape(-1, 6)
        words = np.zeros((len(six), 8), np.uint8)
        words[:, :6] = six
        d, h, lo, hi = spans(words.view("<u8").ravel(), whole("sizes", np.int32).astype(np.int64), whole("times", np.int32).astype(np.int64), whole("places", np.int64).reshape(-1, 3), length)
        del six, words
        common.trimmed()
        return pd.DataFrame({"d": d, "h": h, "lo": lo, "hi": hi})

    dealt = _rows(docs, id_col, text_col).mapInArrow(send, "shard int, words binary, sizes binary, times binary, places binary")
    return dealt.groupBy("shard").applyInPandas(search, "d long, h long, lo int, hi int")


def spans(words: np.ndarray, sizes: np.ndarray, times: np.ndarray, places: np.ndarray, length: int):
    """One shard: contents (``sizes`` words each) with their places (id, text hash, first word), ``times`` each."""
    n = len(sizes)
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    symbols = np.unique(words, return_inverse=True)[1].reshape(-1) + 1
    # A zero after each content.
    begin = start + np.arange(n)
    text = np.zeros(len(words) + n, np.int64)
    text[np.arange(len(words)) + np.repeat(np.arange(n), sizes)] = symbols
    index = FMIndex(text, length)
    # A place is a number in the order of (document, word).
    by = np.lexsort((places[:, 1], places[:, 0]))
    document = np.zeros(len(places), np.int64)
    document[by[1:]] = np.cumsum((places[by[1:], :2] != places[by[:-1], :2]).any(1))
    place = (document << 32) + places[:, 2]
    of = np.repeat(np.arange(n), times)
    head = np.concatenate(([0], np.cumsum(times)[:-1]))
    first = np.minimum.reduceat(place, head)
    # The earliest place of the words that each group of rows begins with.
    offset = np.arange(len(text)) - np.repeat(begin, sizes + 1)
    earliest = np.repeat(first, sizes + 1) + offset
    earliest = np.minimum.reduceat(earliest[index.suffixes], index.group_start)
    # Streamed: windows of the first place that start earlier elsewhere.
    found_c, found_o = [], []
    for c, o, row, _ in index.matches(text, begin, sizes):
        late = earliest[index.group[row]] < first[c] + o
        found_c.append(c[late])
        found_o.append(o[late])
    c = np.concatenate(found_c) if found_c else np.zeros(0, np.int64)
    o = np.concatenate(found_o) if found_o else np.zeros(0, np.int64)
    order = np.lexsort((o, c))
    c, o = c[order], o[order]
    cut = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (o[1:] != o[:-1] + 1)))) if len(c) else np.zeros(0, np.int64)
    last = np.append(cut[1:], len(c)) - 1 if len(c) else cut
    # The places with that smallest number, and all others, whose windows all start earlier there.
    primary = place == first[of]
    lead = np.full(n, -1, np.int64)
    where = np.flatnonzero(primary)
    name, lo, hi = [], [], []
    rest = np.flatnonzero(~primary)
    name.append(places[rest, :2])
    lo.append(places[rest, 2])
    hi.append(places[rest, 2] + sizes[of[rest]])
    if len(cut):
        # Rows that repeat id and text share a place; each span goes to one of them, for it names both.
        lead[of[where]] = where
        p = lead[c[cut]]
        name.append(places[p, :2])
        lo.append(places[p, 2] + o[cut])
        hi.append(places[p, 2] + o[last] + length)
    name = np.concatenate(name)
    return name[:, 0], name[:, 1], np.concatenate(lo).astype(np.int32), np.concatenate(hi).astype(np.int32)


def kept_words(words: list[bytes], spans_: list) -> list[bytes]:
    """``words`` without those that any (lo, hi) covers."""
    out, at = [], 0
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans_):
        if lo > at:
            out += words[at:lo]
        at = max(at, hi)
    return out + words[at:]


def deduplicated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", out: tuple[str, str, str] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """``docs`` with n_words, n_removed, and kept: the words left, joined by one space; ``out`` names them, and columns of those names are replaced."""
    spans_ = common.stored(earlier_spans(docs, length, GRAM, id_col, text_col), "spans")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in map(str.lower, out)])
    names = docs.columns
    sd, sh, key, hash_, found = common.fresh(docs, "_sd", "_sh", "_key", "_hash", "_spans")
    # Rows that repeat id and text give the same spans.
    spans_ = spans_.groupBy(F.col("d").alias(sd), F.col("h").alias(sh)).agg(F.collect_set(F.struct("lo", "hi")).alias(found))
    d, h = _row_key(id_col, text_col)
    own = docs.withColumn(key, d).withColumn(hash_, h)
    both = own.join(spans_, (F.col(key) == F.col(sd)) & (F.col(hash_) == F.col(sh)), "left").drop(sd, sh, key, hash_)
    shape = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(out, (T.LongType(), T.LongType(), T.StringType())))])

    def cut(batches):
        for b in batches:
            n, removed, kept = [], [], []
            for t, s in zip(b.column(text_col).to_pylist(), b.column(found).to_pylist()):
                words = (t or "").encode().split()
                left = kept_words(words, s) if s else words
                n.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, *out])
        common.released()

    return both.mapInArrow(cut, shape)
