"""Sorted-string-table shards of token ids.

A shard holds documents in ascending order of their key (doc_id, order-preserving big-endian, and
a running number where a doc_id repeats).  File layout:

    block*   prefix-compressed entries, the whole block zstd-compressed
    index    first key, offset and length of each block (sparse: one entry a block)
    bloom    Bloom filter over the doc_ids
    footer   fixed size: places of index and Bloom filter, counts, magic

Entry: uint16 shared key bytes, uint16 new key bytes, uint32 value bytes, the new key bytes, the
value (ids as little-endian uint16 where all fit, else uint32; the first byte says which).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import fresh_path, ids_of, materialise, only, slices, text_buffers, texts
from tidewater.llm.tokens import SLICE, default_path, encoder

MAGIC = b"TWSST001"
FOOTER = struct.Struct("<QQQQQQII8s")  # index at, its size, Bloom at, its size, documents, ids, Bloom hashes, 0, magic
BLOCK_BYTES = 256 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: About the most text bytes and documents in a shard, whatever the input's size.
SHARD_BYTES, SHARD_DOCS = 256 << 20, 1 << 20


def key_of(doc_id: int, number: int) -> bytes:
    return struct.pack(">QI", doc_id + (1 << 63), number)


def doc_of(key: bytes) -> int:
    return struct.unpack(">QI", key)[0] - (1 << 63)


def _probes(doc_id: int, bits: int, hashes: int) -> list[int]:
    raw = struct.pack("<q", doc_id)
    a, b = zlib.crc32(raw), zlib.crc32(raw, 0x9E3779B9) | 1
    return [((a << 16) + i * ((b << 8) | 1)) % bits for i in range(hashes)]


class Writer:
    """Writes one shard through a binary stream; keys must come in ascending order."""

    def __init__(self, out):
        self.out, self.at, self.block, self.size = out, 0, [], 0
        self.first = self.last = b""
        self.index: list[tuple[bytes, int, int]] = []
        self.docs: list[int] = []
        self.ids = 0
        self.press = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int, number: int, ids: np.ndarray) -> None:
        key = key_of(doc_id, number)
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = next((i for i in range(len(key)) if key[i] != self.last[i]), len(key))
        small = not len(ids) or int(ids.max()) < 65536
        value = b"\x02" + ids.astype("<u2").tobytes() if small else b"\x04" + ids.astype("<u4").tobytes()
        self.block += [struct.pack("<HHI", shared, len(key) - shared, len(value)), key[shared:], value]
        self.size += len(value) + len(key)
        self.last = key
        self.docs.append(doc_id)
        self.ids += len(ids)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.first, *self._put(self.press.compress(b"".join(self.block)))))
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<HQQ", len(k), a, n) + k for k, a, n in self.index)
        i_at, i_size = self._put(index)
        bits = max(64, -(-len(set(self.docs)) * BLOOM_BITS // 8) * 8)
        bloom = bytearray(bits // 8)
        for d in set(self.docs):
            for p in _probes(d, bits, BLOOM_HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        b_at, b_size = self._put(bytes(bloom))
        self._put(FOOTER.pack(i_at, i_size, b_at, b_size, len(self.docs), self.ids, BLOOM_HASHES, 0, MAGIC))


class Reader:
    """Reads a shard: all entries in order, or one document by Bloom filter and binary search."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        self.i_at, i_size, b_at, b_size, self.documents, self.ids, self.hashes, _, magic = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw, self.index, at = self._get(self.i_at, i_size), [], 0
        while at < len(raw):
            n, a, z = struct.unpack_from("<HQQ", raw, at)
            self.index.append((raw[at + 18 : at + 18 + n], a, z))
            at += 18 + n
        self.bloom = self._get(b_at, b_size)
        self.press = zstandard.ZstdDecompressor()

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size = self.index[i]
        raw, p, key = self.press.decompress(self._get(at, size)), 0, b""
        while p < len(raw):
            shared, new, n = struct.unpack_from("<HHI", raw, p)
            p += 8
            key = key[:shared] + raw[p : p + new]
            p += new
            yield key, np.frombuffer(raw, "<u2" if raw[p] == 2 else "<u4", (n - 1) // raw[p], p + 1).astype("<u4")
            p += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every row with this doc_id (none: an empty list)."""
        bits = len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(doc_id, bits, self.hashes)):
            return []
        low, out = key_of(doc_id, 0), []
        for i in range(max(0, bisect_right([k for k, _, _ in self.index], low) - 1), len(self.index)):
            for key, ids in self._block(i):
                if doc_of(key) > doc_id:
                    return out
                if doc_of(key) == doc_id:
                    out.append(ids)
        return out


def _write(folder: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens", "powers")
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        writer = out = None
        last, number, low = None, 0, None
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, _ = ids_of(part.column("doc_id"))
                flat, offs = encoder(tokenizer).encode(*text_buffers(part.column("text")))
                if writer is None:
                    files, root = fs.FileSystem.from_uri(folder)
                    files.create_dir(root, recursive=True)
                    # A task that runs again writes a file of its own; the rows returned name the one that counts.
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                    out = files.open_output_stream(f"{root}/{name}")
                    writer, low = Writer(out), int(ids[0])
                for doc, a, b in zip(ids.tolist(), offs.tolist(), offs[1:].tolist()):
                    number = number + 1 if doc == last else 0
                    last = doc
                    writer.add(doc, number, flat[a:b])
        if writer is not None:
            writer.close()
            out.close()
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([name]), pa.array([low], pa.int64()), pa.array([writer.ids], pa.int64()), pa.array([len(writer.docs)], pa.int64())], ["shard", "name", "low", "n_ids", "n_docs"])

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text; other columns are ignored) as shards in ``folder``, a URI all executors reach.

    Returns the manifest, a row per shard: shard (ascending with doc_id), name, low (first doc_id),
    n_ids, n_docs.  A null text counts as empty; rows with a null doc_id have no key and are not
    written; rows that repeat a doc_id are all written, ordered by a hash of their text.
    """
    rows = texts(docs).where("doc_id is not null")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size.bytes or 0) // SHARD_BYTES), -(-size.n // SHARD_DOCS))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return materialise(rows.mapInArrow(_write(folder, tokenizer or default_path()), "shard long, name string, low long, n_ids long, n_docs long"), "manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens", "powers")
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                with files.open_input_file(f"{root}/{name}") as source:
                    rows = []
                    for key, ids in Reader(source):
                        rows.append((doc_of(key), start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) >= 20_000:
                            yield _digests(rows)
                            rows = []
                    yield _digests(rows)

    return run


def _digests(rows: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards named in the manifest."""
    spark = manifest.sparkSession
    rows = sorted(manifest.select("shard", "name", "n_ids").collect())  # a row per shard, not per document
    plan, start = [], 0
    for _, name, n in rows:
        plan.append((name, start))
        start += n
    plan = spark.createDataFrame(plan, "name string, start long").repartition(max(1, len(plan)))
    return plan.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes shards to the shared folder and returns what the files hold."""
    folder = fresh_path(docs.sparkSession, "shards")
    manifest = write_shards(docs, folder, tokenizer)
    return read_digests(manifest, folder)
