"""Token ids in sorted-string-table shards: prefix-compressed blocks, sparse index, Bloom filter, footer."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, open_shared, write_shared
from weftline.llm.token_ids import default_tokenizer, encoder

MAGIC = b"WFSST\x00\x01\n"
_FOOTER = struct.Struct("<QQQQQQB7x8s")  # index at, its bytes; Bloom at, its bytes; documents, ids; bytes an id, magic
_BLOCK, _BITS, _HASHES = 1 << 16, 10, 7


def key_of(doc_id) -> bytes:
    """Keys sort as ids do: null first, then integers, then text."""
    if doc_id is None:
        return b"\x00"
    if isinstance(doc_id, int):
        return b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")
    return b"\x02" + str(doc_id).encode()


def id_of(key: bytes):
    if key[0] == 0:
        return None
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] == 1 else key[1:].decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = data[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _places(key: bytes, bits: int) -> Iterator[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, (h >> 64) | 1
    return ((a + i * b) % bits for i in range(_HASHES))


def shard_parts(entries: Iterable[tuple[bytes, bytes]], width: int, totals: list[int]) -> Iterator[bytes]:
    """The bytes of one shard, from (key, ids of width bytes each) in key order; totals gets [documents, ids].

    Only the open block, the index and 8 bytes a key are held.
    """
    yield MAGIC
    at, docs, ids = len(MAGIC), 0, 0
    index, hashes = bytearray(), []
    block, first, last, held = bytearray(), b"", b"", 0

    def closed() -> bytes:
        nonlocal at
        data = bytes(block) + struct.pack("<I", zlib.crc32(block))
        index.extend(_varint(len(first)) + first + _varint(at) + _varint(len(data)) + _varint(held))
        at += len(data)
        block.clear()
        return data

    for key, value in entries:
        if not held:
            first, shared = key, 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, last, strict=False)) if x != y), min(len(key), len(last)))
        n = len(value) // width
        block += _varint(shared) + _varint(len(key) - shared) + _varint(n) + key[shared:] + value
        last, held, docs, ids = key, held + 1, docs + 1, ids + n
        hashes.append(key)
        if len(block) >= _BLOCK:
            yield closed()
            held = 0
    if held:
        yield closed()
    bits = max(64, docs * _BITS)
    bloom = bytearray((bits + 7) // 8)
    for key in hashes:
        for p in _places(key, bits):
            bloom[p >> 3] |= 1 << (p & 7)
    bloom = struct.pack("<Q", bits) + bytes(bloom)
    yield bytes(index)
    yield bloom
    yield _FOOTER.pack(at, len(index), at + len(index), len(bloom), docs, ids, width, MAGIC)
    totals[:] = [docs, ids]


class Shard:
    """A shard opened for reading; blocks are read as they are needed."""

    def __init__(self, path: str):
        system, path = open_shared(path)
        self._file = system.open_input_file(path)
        size = self._file.size()
        i_at, i_n, b_at, b_n, self.documents, self.ids, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        index, at = self._read(i_at, i_n), 0
        self._keys, self._blocks = [], []
        while at < len(index):
            n, at = _read_varint(index, at)
            self._keys.append(index[at : at + n])
            place, at = _read_varint(index, at + n)
            size, at = _read_varint(index, at)
            held, at = _read_varint(index, at)
            self._blocks.append((place, size, held))
        bloom = self._read(b_at, b_n)
        self._bits, self._bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]

    def _read(self, at: int, n: int) -> bytes:
        return self._file.read_at(n, at)

    def close(self) -> None:
        self._file.close()

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, size, held = self._blocks[i]
        data = self._read(at, size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        at, key = 0, b""
        for _ in range(held):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + n * self.width]
            at += n * self.width

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        """(key, ids in the shard's width) in key order."""
        for i in range(len(self._blocks)):
            yield from self._block(i)

    def get(self, doc_id) -> bytes | None:
        """The ids of a document (the first, if its id repeats), by Bloom filter and binary search; None if absent."""
        key = key_of(doc_id)
        if not all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _places(key, self._bits)):
            return None
        i = max(bisect_right(self._keys, key) - 1, 0)
        while i and self._keys[i] == key:  # a repeated id may have begun in a block before
            i -= 1
        for j in range(i, len(self._blocks)):
            if self._keys[j] > key:
                return None
            for k, value in self._block(j):
                if k == key:
                    return value
        return None


def write_shards(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write df's token ids into folder, a shared one; return (shard, path, documents, ids), to be evaluated once.

    Shards are ranges of ids, in order. Each is written under a name of the attempt's own and then renamed, so a task
    that runs again or twice leaves the same file.
    """
    tokenizer = tokenizer or default_tokenizer()

    def write(batches):
        import pyarrow as pa

        enc = encoder(tokenizer)
        width = 2 if max(enc.vocabulary, end_id + 1) <= 1 << 16 else 4
        shard, totals = TaskContext.get().partitionId(), [0, 0]

        def encoded():
            for b in batches:
                docs = iter(b.column(0).to_pylist())
                for flat, begins in enc.encode_batch(b.column(1), end_id):
                    data, begins = flat.astype(f"<u{width}").tobytes(), (begins * width).tolist()
                    for i in range(len(begins) - 1):
                        yield key_of(next(docs)), data[begins[i] : begins[i + 1]]

        entries = encoded()
        path = f"{folder}/ids-{shard:06d}.sst"
        head = next(entries, None)
        if head is None:
            return
        write_shared(path, shard_parts((x for part in ([head], entries) for x in part), width, totals))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "documents": [totals[0]], "ids": [totals[1]]})

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    return rows.mapInArrow(write, "shard long, path string, documents long, ids long")


def read_shards(shards: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document in the files of shards."""

    def read(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.string() if id_type == "string" else pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard, rows, size = Shard(path), [], 0
                for key, value in shard.scan():
                    if shard.width == 2:
                        value = np.frombuffer(value, "<u2").astype("<u4").tobytes()
                    rows.append((id_of(key), start, len(value) // 4, value))
                    start, size = start + len(value) // 4, size + len(value)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                shard.close()

    n = max(shards.count(), 1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    return starts.repartition(n, "shard").select("path", "start").mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def token_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write shards to the shared folder and read them back: doc_id, start, n_tokens, ids.

    A null text counts as empty and has only the end id. Null ids come first; rows that repeat an id stand in order of
    their texts. Very long texts are encoded whole. An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "sst")
    shards = scratch.table(write_shards(df, scratch.folder("files"), id_col, text_col, tokenizer, end_id), "shards")
    kind = df.select(id_col).dtypes[0][1]
    return read_shards(shards, "string" if kind == "string" else "bigint")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
