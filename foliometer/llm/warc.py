"""WARC archives in dictionary-compressed Zstandard files (.warc.zst).

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a
Zstandard dictionary, built from the first records of that archive (trained, or made of their
bytes where there are too few to train on); then each
record is a frame of its own, compressed with it. So records can be read one by
one, and an archive needs nothing beside it.

Payloads are told apart by the SHA-1 of all their bytes. Of equal payloads of at
least `least_bytes` the record with the largest page_id is a response, and the
others are revisits that refer to it and carry no payload; shorter payloads are
all responses. The largest id is a map-side maximum for each digest. Digests that
several ids have go to sorted files, which the writers map and ask; so the html
follows no shuffle and no join, and a payload that a third of all pages share is
one entry.

Each task writes its archives under names of its own attempt and returns their
manifest, so a task that runs again leaves at most files that nothing names.
Records are held until `train_bytes` of them have been seen (or one is larger),
then they stream.

Nulls and ties: a null html is an empty payload; a null page_id counts as smaller than
any other, and a revisit of it has no refers_to. Rows that share both the payload and its
largest page_id are all responses. A null url is empty. Empty tables write no archives.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SortedFiles, mapped_dir, parts, table, written
from .words import slices

SKIPPABLE = 0x184D2A5D


def _head(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def record(page_id: int | None, place: str, url: str, payload: bytes | None, size: int, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record; its block is an HTTP response, without a body for a revisit."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    url = "".join(c for c in url if c >= " ")
    fields = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {place}')}>"), ("WARC-Page-ID", name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response")]
    if is_revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
        return _head("revisit", fields, http)
    return _head("response", fields, http + payload)


class Writer:
    """One archive. The dictionary is trained on the first records or, if they are too few or too small to learn from, is what they hold."""

    def __init__(self, path: str, level: int, dictionary_bytes: int, train_bytes: int) -> None:
        self.path, self.level, self.dictionary_bytes, self.train_bytes = path, level, dictionary_bytes, train_bytes
        self.held: list[bytes] = []
        self.size = self.records = self.written = 0
        self.file = None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.file is None:
            self.held.append(data)
            self.size += len(data)
            if self.size >= self.train_bytes:
                self._begin()
        else:
            self._put(data)

    def _begin(self) -> None:
        sample = [x[:131072] for x in self.held]
        try:
            trained = zstandard.train_dictionary(self.dictionary_bytes, sample, level=self.level).as_bytes()
        except zstandard.ZstdError:  # too little to learn from: the records' own bytes, the last of them nearest
            trained = b"".join(sample)[-self.dictionary_bytes :]
        self.file = open(self.path, "wb")
        self.file.write(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
        for data in self.held:
            self._put(data)
        self.held = []

    def _put(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.file.write(frame)
        self.written += len(frame)

    def close(self) -> tuple[str, int, int]:
        if self.file is None:
            self._begin()
        self.file.close()
        return self.path, self.records, os.path.getsize(self.path)


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (WARC-Type among them) and block of each record, frame by frame."""
    with open(path, "rb") as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path}: no dictionary frame")
        trained = f.read(size)
        make = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
        data = b""
        while True:
            out, one = [], make.decompressobj()
            while not one.eof:
                data = data or f.read(1 << 20)
                if not data:
                    if out:
                        raise ValueError(f"{path}: cut off within a record")
                    return
                out.append(one.decompress(data))
                data = one.unused_data if one.eof else b""
            whole = b"".join(out)
            head, _, rest = whole.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


_NONE = np.iinfo(np.int64).min


def _halves(digest: bytes) -> tuple[int, int]:
    return struct.unpack(">Qq", digest[:16])


def index_repeats(pages: DataFrame, least_bytes: int, folder: str) -> SortedFiles:
    """Files of the payloads that several page_ids have: 128 bits of SHA-1 and the largest page_id."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"), F.coalesce(F.col("page_id").cast("long"), F.lit(int(_NONE))).alias("id"))
    groups = written(own.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("id").alias("best"), F.min("id").alias("low")).where("best != low").select("digest", "best"), "repeats")
    bits = min(24, max(3, (groups.count() // 500_000).bit_length()))
    files = SortedFiles(folder, "repeats", 1 << bits, ["key", "check", "best"])

    def store(group: pa.Table) -> pa.Table:
        halves = [_halves(bytes.fromhex(x)) for x in group.column("digest").to_pylist()]
        key, check = np.array([h[0] for h in halves], np.uint64), np.array([h[1] for h in halves], np.int64)
        order = np.argsort(key)
        files.write(group.column("bucket")[0].as_py(), key=key[order], check=check[order], best=group.column("best").to_numpy()[order])
        return pa.table({"bucket": group.column("bucket").slice(0, 1).cast(pa.int64())})

    dealt = groups.withColumn("bucket", F.shiftright(F.conv(F.substring("digest", 1, 6), 16, 10).cast("long"), 24 - bits))
    files.seal([r[0] for r in dealt.groupBy("bucket").applyInArrow(store, "bucket long").collect()])
    return files


def write_archives(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 256 << 20, level: int = 3, dictionary_bytes: int = 64 << 10, train_bytes: int = 4 << 20) -> DataFrame:
    """Archives of all rows of pages(page_id, url, html) in the shared folder; returns path, records, bytes of each."""
    folder = mapped_dir(pages.sparkSession, "warc")
    repeats = index_repeats(pages, least_bytes, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, number, out = uuid.uuid4().hex[:12], 0, None
        task = TaskContext.get().partitionId()
        for batch in slices(batches, "html"):
            payloads = [(x or "").encode() for x in batch.column("html").to_pylist()]
            shas = [hashlib.sha1(x).digest() for x in payloads]
            halves = [_halves(x) for x in shas]
            key, check = np.array([h[0] for h in halves], np.uint64), np.array([h[1] for h in halves], np.int64)
            order, back = np.argsort(key), np.empty(len(key), np.int64)
            back[order] = np.arange(len(key))
            repeated, _, best = (x[back] for x in repeats.find(key[order], (0, 0), check[order]))
            for i, (page, url, payload) in enumerate(zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), payloads, strict=True)):
                revisit = bool(repeated[i]) and len(payload) >= least_bytes and (_NONE if page is None else page) != best[i]
                refers = int(best[i]) if revisit and best[i] != _NONE else None
                digest = base64.b32encode(shas[i]).decode()
                if out is None:
                    out = Writer(f"{folder}/pages-{task:06d}-{attempt}-{number:04d}.warc.zst", level, dictionary_bytes, train_bytes)
                    number += 1
                out.add(record(page, f"{task} {number} {out.records}", url or "", payload, len(payload), digest, refers, revisit))
                if out.written >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out.close()], ["path", "records", "bytes"])
                    out = None
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out.close()], ["path", "records", "bytes"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return written(source.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload, one row for each record."""
    count = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if keep_payload else [])]
        number = lambda x: int(x[10:-1]) if x and len(x) > 11 else None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                for fields, block in read_archive(path):
                    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
                    body = payload_of(block)
                    if kind == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise ValueError(f"{path}: the payload of {fields['WARC-Page-ID']} has changed")
                    rows.append((number(fields["WARC-Page-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To")), *([body if kind == "response" else None] if keep_payload else [])))
                    if len(rows) >= (256 if keep_payload else 4096):
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if keep_payload else "")
    return manifest.select("path").repartition(parts(count, 1)).mapInArrow(run, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages")))


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, b::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM q
"""
