"""Archives of one Zstandard frame per record, with the dictionary in a leading skippable frame.

Layout of a file: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then
for every record one frame compressed with it.  The reader loads the dictionary,
decodes one frame at a time with a bounded window, and checks of every record: the
version line, the mandatory headers, Content-Length against the block, the frame's
content size, and of responses the payload's length and SHA-1.

Of equal payloads of at least ``least`` bytes, that of the smallest page is a response
and the others are revisits, which carry headers only; smaller payloads are all
responses.  Null payloads and URIs are empty.  Rows that repeat a page id are a record
each, and each is a response where that id is the smallest.  Rows without a page id are
<urn:page:null> and read back as null; each is a response, and no revisit refers to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common

DICT_MAGIC = 0x184D2A5D
#: The dictionary is trained on at most so many payloads and bytes at a file's beginning.
TRAIN_RECORDS, TRAIN_BYTES, DICT_BYTES = 200, 2_000_000, 16_384
#: Decoded bytes of one record, at most; larger ones are refused.
MOST = 1 << 31
_VERSION = b"WARC/1.1"
_EPOCH = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(urn: str | None) -> int | None:
    name = urn.strip("<>").rpartition(":")[2] if urn else "null"
    return None if name == "null" else int(name)


def _record(kind: str, page: int | None, uri: str, payload: bytes, sha: str, first: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {_EPOCH}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_urn(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """A record's headers (lower-case names), block and payload; ValueError where anything is wrong."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"a header without a colon: {line[:80]!r}")
        fields[name.strip().lower().decode()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {size}, but {len(rest) - 4} bytes")
    block = rest[:size]
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    if fields["warc-type"] == "response" and (sha := fields.get("warc-payload-digest")):
        if f"sha1:{digest(payload)}" != sha:
            raise ValueError("the payload's digest doesn't match")
        if int(fields.get("x-payload-length", len(payload))) != len(payload):
            raise ValueError("the payload's length doesn't match")
    return {"headers": fields, "block": block, "payload": payload}


class Writer:
    """Writes one archive; payloads are held only until the dictionary is trained."""

    def __init__(self, sink):
        self.sink, self.held, self.size, self.compressor = sink, [], 0, None
        self.records = 0

    def _begin(self) -> None:
        import zstandard

        samples = [r for r in self.held if r]
        try:
            trained = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too few or too small records: raw content serves
            trained = b"".join(samples[:8])[:DICT_BYTES] or b"WARC/1.1\r\n"
        self.sink.write(struct.pack("<II", DICT_MAGIC, len(trained)) + trained)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True, write_checksum=True)
        for r in self.held:
            self.sink.write(self.compressor.compress(r))
        self.held = []

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor:
            self.sink.write(self.compressor.compress(record))
            return
        self.held.append(record)
        self.size += len(record)
        if len(self.held) >= TRAIN_RECORDS or self.size >= TRAIN_BYTES:
            self._begin()

    def close(self) -> None:
        if not self.compressor:
            self._begin()


def records(stream, step: int = 1 << 20):
    """Every record of an archive, decoded frame by frame from a readable stream."""
    import zstandard

    head = stream.read(8)
    if len(head) != 8:
        raise ValueError("the archive ends in its first frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    trained = b""
    while len(trained) < size:
        if not (more := stream.read(size - len(trained))):
            raise ValueError("the archive ends in its dictionary")
        trained += more
    if trained[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
        trained = zstandard.ZstdDecompressor().decompress(trained, max_output_size=1 << 27)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    data = b""
    while True:
        if not data and not (data := stream.read(step)):
            return
        frame, out, total = decoder.decompressobj(), [], 0
        while not frame.eof:
            if not data and not (data := stream.read(step)):
                raise ValueError("the archive ends in a frame")
            piece = frame.decompress(data)
            total += len(piece)
            if total > MOST:
                raise ValueError("a record is too large")
            out.append(piece)
            data = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def write(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write archives under ``path``, one for each partition; returns their list (file, records).

    Payloads are compared by SHA-256 and length, in narrow rows; the payloads themselves
    are dealt once, by page id, so that no frequent payload meets in one task.
    ``path`` must be reachable from every executor.
    """
    spark = pages.sparkSession
    common.small_batches(spark)
    body = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("d"), F.coalesce(uri_col, F.lit("")).alias("uri"), body.alias("body"))
    rows = rows.withColumn("key", F.unhex(F.sha2("body", 256)))
    firsts = rows.where(F.octet_length("body") >= least).groupBy("key").agg(F.min("d").alias("first"), F.count("*").alias("n"))
    # Pages that repeat another's payload; the rest need no partner.
    firsts = firsts.where("n > 1").select("key", "first")
    later = rows.select("d", "key").join(firsts, "key").where("d > first").distinct()
    # One row for each page that repeats, so that payloads are dealt by page id alone, or not at all.
    later = later.groupBy(F.col("d").alias("later")).agg(F.map_from_entries(F.collect_list(F.struct("key", "first"))).alias("firsts"))
    # Rows without a page id have no partner and are dealt by their content.
    rows = rows.join(later, (F.coalesce(F.col("d"), F.xxhash64("key", "uri")) == F.col("later")) & F.col("d").isNotNull(), "left")
    rows = rows.select("d", "uri", "body", F.col("firsts")[F.col("key")].alias("first")).sortWithinPartitions("d")

    def archive(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        number = TaskContext.get().partitionId()
        # Every attempt writes a file of its own; the list names those of the attempts that ended well.
        name = f"part-{number:06d}-{uuid.uuid4().hex}.warc.zst"
        with store.open_output_stream(f"{base}/{name}", compression=None) as sink:
            w = Writer(sink)
            for b in batches:
                for d, uri, payload, first in zip(*(b.column(c).to_pylist() for c in ("d", "uri", "body", "first"))):
                    if len(payload) > MOST - 65_536:
                        raise ValueError(f"page {d}: a payload of {len(payload)} bytes is more than a reader takes")
                    w.add(_record("response" if first is None else "revisit", d, " ".join(uri.split()), payload, digest(payload), first))
            w.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([w.records], pa.int64())})

    got = rows.mapInArrow(archive, "file string, records long").collect()
    listed = spark.createDataFrame([(f"{path}/{r['file']}", r["records"]) for r in sorted(got)], "file string, records long")
    listed.coalesce(1).write.parquet(f"{path}/files")
    return spark.read.parquet(f"{path}/files")


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``, each validated."""
    listed = spark.read.parquet(f"{path}/files")
    n = max(1, listed.count())
    shape = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def decode(batches):
        from pyarrow import fs

        for b in batches:
            for file, count in zip(b.column("file").to_pylist(), b.column("records").to_pylist()):
                store, name = fs.FileSystem.from_uri(file)
                rows, held, seen = [], 0, 0
                with store.open_input_stream(name, compression=None) as f:
                    for record in records(f):
                        seen += 1
                        r = parse(record)
                        h = r["headers"]
                        kept = r["payload"] if with_payload else None
                        rows.append((_page(h["warc-record-id"]), h.get("warc-target-uri"), int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], _page(h.get("warc-refers-to")), kept))
                        held += 200 + len(kept or b"")
                        if held > 4_000_000:
                            yield _batch(rows, with_payload)
                            rows, held = [], 0
                if seen != count:
                    raise ValueError(f"{file} has {seen} records instead of {count}")
                if rows:
                    yield _batch(rows, with_payload)

    return listed.repartitionByRange(n, "file").mapInArrow(decode, shape)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    names = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + with_payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*rows))[: len(names)], kinds)], names=names)
