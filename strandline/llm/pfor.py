"""Token ids in files of patched frame-of-reference blocks.

A block holds ``BLOCK`` ids: their minimum is subtracted, the differences are packed at
the width that ``PERCENTILE`` percent of them fit in, and the rest keep their low bits
there and their high bits in the block's exception list.  Of a file:

    blocks      each: minimum u32, width u8, exceptions u8, packed low bits (BLOCK * width
                bits, least first), exceptions' places u8 each, their high bits u32 each
    documents   validity u8 each, id i64 each, number of ids u64 each
    block index start of each block and the end of the last, u64 each
    trailer     documents u64, ids u64, places of the documents and of the block index
                u64, crc32 of all before u32, BLOCK u32, MAGIC

The last block is filled up with its last id.  All numbers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common

BLOCK, PERCENTILE, MAGIC = 128, 90, b"PFORIDS1"
_TRAILER = struct.Struct("<QQQQII8s")
#: Ids that are encoded or decoded at a time.
STEP = BLOCK * 4096
#: Bytes of text in a part, about; a reader holds one part's encoded ids.
PART_BYTES = 48_000_000


def _bits(d: np.ndarray) -> np.ndarray:
    return np.frexp(d.astype(np.float64))[1].astype(np.uint8)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the blocks of ``ids`` and each block's length in bytes."""
    if not len(ids):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    n = -(-len(ids) // BLOCK)
    x = np.full(n * BLOCK, ids[-1], dtype=np.uint32)
    x[: len(ids)] = ids
    x = x.reshape(n, BLOCK)
    low = x.min(1)
    d = x - low[:, None]
    bits = _bits(d)
    at = -(-BLOCK * PERCENTILE // 100) - 1
    width = np.partition(bits, at, axis=1)[:, at]
    beyond = bits > width[:, None]
    n_exc = beyond.sum(1)
    body = width.astype(np.int64) * (BLOCK // 8)
    size = 6 + body + 5 * n_exc
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    out = np.zeros(int(size.sum()), np.uint8)
    out[start[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[start + 4] = width
    out[start + 5] = n_exc
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            part = d[rows] & np.uint32((1 << int(w)) - 1)
            part = part.astype(np.uint16) if w <= 16 else part
            b = ((part[:, :, None] >> np.arange(w, dtype=part.dtype)) & 1).astype(np.uint8)
            packed = np.packbits(b.reshape(len(rows), -1), axis=1, bitorder="little")
            out[(start[rows] + 6)[:, None] + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(beyond)
    if len(row):
        first = np.concatenate(([0], np.cumsum(n_exc)[:-1]))
        rank = np.arange(len(row)) - first[row]
        base = start[row] + 6 + body[row]
        out[base + rank] = place
        high = (d[row, place].astype(np.uint64) >> width[row].astype(np.uint64)).astype("<u4")
        out[(base + n_exc[row] + 4 * rank)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    return out, size


def decode_blocks(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``start`` in ``data`` (uint8), all of BLOCK ids."""
    n = len(start)
    if not n:
        return np.zeros(0, np.uint32)
    low = np.ascontiguousarray(data[start[:, None] + np.arange(4)]).view("<u4").ravel()
    width, n_exc = data[start + 4], data[start + 5].astype(np.int64)
    d = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows, size = np.flatnonzero(width == w), int(w) * (BLOCK // 8)
            packed = data[(start[rows] + 6)[:, None] + np.arange(size)]
            b = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
            got = np.zeros((len(rows), BLOCK), np.uint32)
            for k in range(int(w)):
                got |= b[:, :, k].astype(np.uint32) << np.uint32(k)
            d[rows] = got
    if n_exc.any():
        row = np.repeat(np.arange(n), n_exc)
        rank = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(n_exc)[:-1])), n_exc)
        base = start[row] + 6 + width[row].astype(np.int64) * (BLOCK // 8)
        place = data[base + rank]
        high = np.ascontiguousarray(data[(base + n_exc[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
        d[row, place] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    return (d + low[:, None]).ravel()


class Writer:
    """Writes one file, a document after another, a few thousand blocks at a time."""

    def __init__(self, sink):
        self.sink, self.crc, self.at = sink, 0, 0
        self.ids: list[np.ndarray] = []
        self.held = self.total = 0
        self.docs, self.counts, self.sizes = [], [], []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.crc = zlib.crc32(data, self.crc)
        self.at += len(data)

    def _flush(self, last: bool) -> None:
        x = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        cut = len(x) if last else len(x) // BLOCK * BLOCK
        for i in range(0, cut, STEP):
            out, size = encode_blocks(x[i : min(cut, i + STEP)])
            self._put(out.tobytes())
            self.sizes.append(size)
        self.ids, self.held = [x[cut:]], len(x) - cut

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.ids.append(ids.astype(np.uint32))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= STEP:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        docs_at = self.at
        self._put(bytes(d is not None for d in self.docs))
        self._put(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self._put(np.array(self.counts, "<u8").tobytes())
        index_at = self.at
        size = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        self._put(np.concatenate(([0], np.cumsum(size))).astype("<u8").tobytes())
        self.sink.write(_TRAILER.pack(len(self.docs), self.total, docs_at, index_at, self.crc, BLOCK, MAGIC))


class Reader:
    """One file's documents; ``ids(lo, hi)`` decodes only the blocks that hold those."""

    def __init__(self, data: bytes):
        n, self.total, docs_at, index_at, crc, block, magic = _TRAILER.unpack(data[-_TRAILER.size :])
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a file of id blocks")
        if zlib.crc32(memoryview(data)[: -_TRAILER.size]) != crc:
            raise ValueError("the file's checksum doesn't match")
        self.data = np.frombuffer(data, np.uint8)
        self.valid = self.data[docs_at : docs_at + n]
        self.docs = np.frombuffer(data, "<i8", n, docs_at + n)
        self.counts = np.frombuffer(data, "<u8", n, docs_at + 9 * n).astype(np.int64)
        self.index = np.frombuffer(data, "<u8", -(-self.total // BLOCK) + 1, index_at).astype(np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        hi = min(hi, self.total)
        if lo >= hi:
            return np.zeros(0, np.uint32)
        a = lo // BLOCK
        return decode_blocks(self.data, self.index[a : -(-hi // BLOCK)])[lo - a * BLOCK : hi - a * BLOCK]

    def documents(self):
        """(id or None, start in this file, ids) of each document, in order."""
        ends = np.cumsum(self.counts)
        k = 0
        while k < len(ends):
            begin = int(ends[k] - self.counts[k])
            last = max(k + 1, int(np.searchsorted(ends, begin + STEP, side="right")))
            got = self.ids(begin, int(ends[last - 1]))
            for j in range(k, last):
                s = int(ends[j] - self.counts[j])
                yield (int(self.docs[j]) if self.valid[j] else None), s, got[s - begin : s - begin + int(self.counts[j])]
            k = last


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write part files under ``path``, in ascending id order; returns the manifest.

    Null texts are empty: their ids are the end id alone.  Null ids come first; rows of
    one id are ordered by text.  ``path`` must be reachable from every executor
    (``pyarrow.fs`` opens its URI).  Every attempt of a task writes a file of its own name,
    and the manifest lists those of the attempts that ended well, so a lost and repeated
    task does no harm.  There are as many parts as keep a part near ``PART_BYTES`` of text. The manifest, one row
    for each part, holds each part's first place in the stream of all ids.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n = max(common.parts_for(spark), -(-total // PART_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(text_col, F.lit("")).alias("t"))
    rows = rows.repartitionByRange(n, "d").sortWithinPartitions("d", "t")

    def part(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        from strandline.llm import tokens

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        number = TaskContext.get().partitionId()
        file = f"part-{number:06d}-{uuid.uuid4().hex}.pfor"
        encoder = tokens.encoder(tokenizer_path)
        end = np.array([end_id], np.uint32)
        with store.open_output_stream(f"{base}/{file}", compression=None) as sink:
            w = Writer(sink)
            for b in batches:
                ids, texts = b.column("d").to_pylist(), b.column("t").to_pylist()
                for at, some in tokens.chunks(texts):
                    for k, x in enumerate(encoder.encode(some)):
                        w.add(ids[at + k], np.concatenate((x.astype(np.uint32), end)))
            w.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "file": [file], "docs": pa.array([len(w.docs)], pa.int64()), "ids": pa.array([w.total], pa.int64())})

    got = rows.mapInArrow(part, "part int, file string, docs long, ids long").collect()
    at, parts = 0, []
    for r in sorted(got):
        parts.append((r["part"], f"{path}/{r['file']}", r["docs"], r["ids"], at))
        at += r["ids"]
    manifest = spark.createDataFrame(parts, "part int, file string, docs long, ids long, first long").coalesce(1)
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of the files under ``path``: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    manifest = spark.read.parquet(f"{path}/manifest")
    n = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def decode(batches):
        from pyarrow import fs

        for b in batches:
            for file, first in zip(b.column("file").to_pylist(), b.column("first").to_pylist()):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_stream(name, compression=None) as f:
                    reader = Reader(f.read())
                rows, held = [], 0
                for d, start, ids in reader.documents():
                    rows.append((d, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int64)] * with_ids)))
                    held += len(ids) if with_ids else 1
                    if held >= 100_000:
                        yield _batch(rows, with_ids)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, with_ids)

    return manifest.select("file", "first").repartitionByRange(n, "file").mapInArrow(decode, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)
