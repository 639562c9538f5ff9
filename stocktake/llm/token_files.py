"""Token-id shards in fixed-width bit packing.

A shard holds documents in ascending doc_id order. Ids are cut into blocks of BLOCK ids; each block
stores every id in the minimum number of bits of the vocabulary, little-endian bit order, from a
byte border. Layout: MAGIC | blocks | doc ids (int64) | null flags (uint8) | document starts
(uint64, one more than documents) | block offsets (uint64, one more than blocks) | trailer.
A reader seeks to the trailer and the tables and then to any block: any id range can be read alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stocktake.llm.shared import open_fs, scratch, shuffle_width, written
from stocktake.llm.tokens import encoder

MAGIC = b"STKIDS1\n"
BLOCK = 1 << 16
TRAILER = struct.Struct("<QQQQI8s")  # documents, ids, blocks, where the tables begin, bits, MAGIC
READ_IDS = 1 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (uint32) in ``bits`` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    full = np.zeros((count, 32), np.uint8)
    full[:, :bits] = flat
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    """Writes a shard as documents come; the file appears under its name only when it is closed."""

    def __init__(self, uri: str, bits: int):
        self.system, self.path = open_fs(uri)
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.partial, self.bits = self.path + ".partial", bits
        self.out = self.system.open_output_stream(self.partial)
        self.out.write(MAGIC)
        self.doc_ids, self.starts, self.blocks, self.pending, self.waiting = [], [0], [len(MAGIC)], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids) // 4)
        self.pending.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            block = pack(ids[k:min(k + BLOCK, whole)], self.bits)
            self.out.write(block)
            self.blocks.append(self.blocks[-1] + len(block))
        self.pending, self.waiting = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        nulls = np.array([d is None for d in self.doc_ids], np.uint8)
        for table in (np.array([d or 0 for d in self.doc_ids], "<i8"), nulls, np.array(self.starts, "<u8"), np.array(self.blocks, "<u8")):
            self.out.write(table.tobytes())
        self.out.write(TRAILER.pack(len(self.doc_ids), self.starts[-1], len(self.blocks) - 1, self.blocks[-1], self.bits, MAGIC))
        self.out.close()
        self.system.move(self.partial, self.path)


class ShardReader:
    """Random access to a shard."""

    def __init__(self, uri: str):
        system, path = open_fs(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        docs, self.n_ids, blocks, tables, self.bits, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token-id shard")
        data = self.file.read_at(size - TRAILER.size - tables, tables)
        self.doc_ids = np.frombuffer(data, "<i8", docs)
        self.nulls = np.frombuffer(data, np.uint8, docs, 8 * docs)
        self.starts = np.frombuffer(data, "<u8", docs + 1, 9 * docs).astype(np.int64)
        self.blocks = np.frombuffer(data, "<u8", blocks + 1, 9 * docs + 8 * (docs + 1)).astype(np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi-1 of the shard; only their blocks are read."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // BLOCK, (hi - 1) // BLOCK
        data = self.file.read_at(int(self.blocks[last + 1] - self.blocks[first]), int(self.blocks[first]))
        parts = []
        for b in range(first, last + 1):
            count = min(BLOCK, self.n_ids - b * BLOCK)
            at = int(self.blocks[b] - self.blocks[first])
            parts.append(unpack(data[at:at + int(self.blocks[b + 1] - self.blocks[b])], count, self.bits))
        return np.concatenate(parts)[lo - first * BLOCK:hi - first * BLOCK]

    def documents(self):
        """(doc_id, start, ids) in file order, READ_IDS ids or one document at a time."""
        k, n = 0, len(self.doc_ids)
        while k < n:
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + READ_IDS, side="right")) - 1)
            end = min(end, n)
            ids = self.ids(int(self.starts[k]), int(self.starts[end]))
            for d in range(k, end):
                lo = int(self.starts[d] - self.starts[k])
                yield (None if self.nulls[d] else int(self.doc_ids[d])), int(self.starts[d]), ids[lo:lo + int(self.starts[d + 1] - self.starts[d])]
            k = end


def write_token_files(docs: DataFrame, path: str, spaced: bool, end_id: int | None = 0, folder: str | None = None) -> DataFrame:
    """Encode ``text`` and write shards in ascending doc_id order; returns the manifest.

    Manifest: shard, file, n_docs, n_ids, start (ids in all shards before). Null texts are empty,
    so a document has at least its end id (if there is one); null doc_ids come first and stay null;
    equal ids stay next to each other; an empty table gives an empty manifest; other columns are
    ignored. A task that is run again writes another file, and the manifest names the one that counts.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-ids")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def shard(batches):
        writer, number = None, TaskContext.get().partitionId()
        uri = f"{folder}/shard-{number:06d}-{uuid.uuid4().hex}.ids"
        enc = encoder(path, spaced)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer = writer or ShardWriter(uri, bits_for(enc.vocabulary))
                writer.add(doc_id, enc.encode(text.as_py() or "") + end)
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([number]), pa.array([uri]), pa.array([len(writer.doc_ids)]), pa.array([writer.starts[-1]])], names=["shard", "file", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text"))
    shards = max(shuffle_width(spark), rows.rdd.getNumPartitions())  # no fewer than input splits, which go by bytes
    ordered = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = written(ordered.mapInArrow(shard, "shard bigint, file string, n_docs bigint, n_ids bigint"), "token-manifest")
    return manifest.withColumn("start", F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids"))  # one row a shard


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the shards; each shard is one task's work.

    One row for each document written, in whatever order; null doc_ids and repeated ones as written; an empty manifest gives an empty result.
    """
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc_id, start, ids in ShardReader(uri).documents():
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int64)] * with_ids)))
                    if len(rows) == 5000:
                        yield _batch(rows, with_ids)
                        rows = []
                yield _batch(rows, with_ids)

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("file", "start").repartition(max(n, shuffle_width(manifest.sparkSession)), "file").mapInArrow(read, schema)


def _batch(rows, with_ids):
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)
