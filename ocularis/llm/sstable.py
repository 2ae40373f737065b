"""Token ids as sorted-string-table shards.

Spark deals the documents by ranges of doc_id, so that each task writes one shard and the shards
are in order. A shard is a sequence of blocks of entries sorted by key, a sparse index with the
first key of each block, a Bloom filter over the keys, and a footer:

    block   zstd of entries: shared u8, unshared u8, value bytes u32, the unshared key bytes, the value
    index   JSON list of [first key (hex), offset, bytes, entries]
    bloom   bits, BITS for each key, HASHES probes by double hashing
    footer  JSON: n_docs, n_tokens, id_bytes, places of index and Bloom filter
    tail    u64 offset of the footer, u32 its bytes, u32 its crc32, MAGIC

Keys are 9 bytes that sort as doc_id does (null first); keys share prefixes within a block. A value
is a document's ids, in 2 bytes each where the vocabulary allows it. A shard appears under its name
by a rename once it is whole, so that a task can run again. ``lookup`` reads the footer, asks the
Bloom filter, and searches the index by halves for the one block that it then reads; ``ShardSet`` first
searches the shards by halves.

Defined cases: a null text has no ids but the end id; rows with one doc_id are kept as entries with
equal keys; a null doc_id sorts before all others; an empty table gives no shards; other columns
are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import mapped, rows, scratch

MAGIC = b"OCSST001"
BLOCK, BITS, HASHES = 64 * 1024, 10, 7
_HEAD, _TAIL = struct.Struct("<BBI"), struct.Struct("<QII8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + (doc_id + 2**63).to_bytes(8, "big")


def doc_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - 2**63 if key[0] else None


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places in a Bloom filter of keys (unsigned 64-bit), HASHES a key."""
    a = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    b = ((a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


def _u64(key: bytes) -> int:
    return int.from_bytes(key[1:], "big") if key[0] else 0


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes a shard block by block; entries come in key order."""

    def __init__(self, path: str, id_bytes: int):
        import zstandard

        self.store, self.path = _open(path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(self.temporary)
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.id_bytes, self.at, self.n_docs, self.n_tokens = id_bytes, 0, 0, 0
        self.index: list[list] = []
        self.keys: list[np.ndarray] = []
        self._begin()

    def _begin(self) -> None:
        self.block, self.bytes, self.first, self.last, self.own = [], 0, b"", b"", []

    def add(self, key: bytes, value: bytes, n_tokens: int) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += [_HEAD.pack(shared, len(key) - shared, len(value)), key[shared:], value]
        self.bytes += len(value) + _HEAD.size + len(key) - shared
        self.last = key
        self.own.append(_u64(key))
        self.n_docs += 1
        self.n_tokens += n_tokens
        if self.bytes >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.pack(b"".join(self.block))
            self.out.write(data)
            self.index.append([self.first.hex(), self.at, len(data), len(self.own)])
            self.at += len(data)
            self.keys.append(np.array(self.own, dtype=np.uint64))
            self._begin()

    def close(self) -> None:
        self._flush()
        bits = max(64, -(-self.n_docs * BITS // 64) * 64)
        bloom = np.zeros(bits // 8, dtype=np.uint8)
        for keys in self.keys:
            places = _probes(keys, bits).ravel()
            np.bitwise_or.at(bloom, (places >> np.uint64(3)).astype(np.int64), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))
        index = json.dumps(self.index).encode()
        footer = json.dumps({"n_docs": self.n_docs, "n_tokens": self.n_tokens, "id_bytes": self.id_bytes, "index": [self.at, len(index)], "bloom": [self.at + len(index), len(bloom)]}).encode()
        end = self.at + len(index) + len(bloom)
        for x in (index, bloom.tobytes(), footer, _TAIL.pack(end, len(footer), zlib.crc32(footer), MAGIC)):
            self.out.write(x)
        self.out.close()
        self.store.move(self.temporary, self.path)


class Shard:
    """Reads a shard: all entries in order, or those of one key."""

    def __init__(self, path: str):
        store, at = _open(path)
        self.file = store.open_input_file(at)
        size = self.file.size()
        end, n, crc, magic = _TAIL.unpack(self._read(size - _TAIL.size, _TAIL.size))
        footer = self._read(end, n)
        if magic != MAGIC or zlib.crc32(footer) != crc:
            raise ValueError(f"{path} is no whole shard")
        self.about = json.loads(footer)
        self.index = json.loads(self._read(*self.about["index"]))
        self.firsts = [bytes.fromhex(x[0]) for x in self.index]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        """Keys and ids (little-endian unsigned 32-bit) of a block."""
        import zstandard

        data, at, key = zstandard.ZstdDecompressor().decompress(self._read(*self.index[k][1:3])), 0, b""
        while at < len(data):
            shared, own, n = _HEAD.unpack_from(data, at)
            at += _HEAD.size
            key = key[:shared] + data[at : at + own]
            value = data[at + own : at + own + n]
            at += own + n
            yield key, value if self.about["id_bytes"] == 4 else np.frombuffer(value, dtype="<u2").astype("<u4").tobytes()

    def entries(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        at, n = self.about["bloom"]
        bloom = np.frombuffer(self._read(at, n), dtype=np.uint8)
        places = _probes(np.array([_u64(key)], dtype=np.uint64), n * 8).ravel()
        return bool(np.all(bloom[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8) & 1))

    def lookup(self, doc_id: int | None) -> list[bytes]:
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        found, k = [], max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.index) and self.firsts[k] <= key:
            found += [v for x, v in self.block(k) if x == key]
            k += 1
        return found


class ShardSet:
    """Lookups over all shards of a table, in key order: halves over the shards' first keys open the footers of as many shards as the search touches, and no others."""

    def __init__(self, paths: list[str]):
        self.paths, self.opened = list(paths), {}

    def shard(self, k: int) -> Shard:
        if k not in self.opened:
            self.opened[k] = Shard(self.paths[k])
        return self.opened[k]

    def lookup(self, doc_id: int | None) -> list[bytes]:
        """The ids of every document with this doc_id, which neighbouring shards may share; none if there is none."""
        key = key_of(doc_id)
        at = bisect.bisect_left(range(len(self.paths)), key, key=lambda k: self.shard(k).firsts[0])
        found, k = [], max(0, at - 1)
        while k < len(self.paths) and self.shard(k).firsts[0] <= key:
            found += self.shard(k).lookup(doc_id)
            k += 1
        return found


def write(docs: DataFrame, tokenizer: str, end_id: int = 2) -> list[tuple[int, str, int, int]]:
    """Encodes every text and writes the shards; the list has (shard, path, documents, ids) of each, in key order.

    The list holds a row a shard, so it grows with the number of files only."""
    to = scratch(docs.sparkSession, "sstable")

    def shard(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, out = encoder(tokenizer), None
        wide = len(enc.tokens) > 65_536 or end_id > 65_535
        number = TaskContext.get().partitionId()
        path = f"{to}/shard-{number:08d}.sst"
        for part in rows(batches, "doc_id", "text"):
            out = out or ShardWriter(path, 4 if wide else 2)
            for doc_id, text in part:
                ids = np.append(np.frombuffer(enc.encode(text), dtype="<u4"), np.uint32(end_id))
                out.add(key_of(doc_id), ids.astype("<u4" if wide else "<u2").tobytes(), len(ids))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([path]), pa.array([out.n_docs], pa.int64()), pa.array([out.n_tokens], pa.int64())], names=["shard", "path", "n_docs", "n_tokens"])

    # rows with one doc_id have an order too, so that a task that runs again writes the same
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    made = mapped(ranged, shard, "shard long, path string, n_docs long, n_tokens long")
    return sorted(tuple(r) for r in made.collect())


def read(spark, shards: list[tuple[int, str, int, int]], result: str, make) -> DataFrame:
    """Rows of ``result`` that make(doc_id, start, ids) gives for each entry of the shards, a shard a task.

    start counts the ids of all documents before this one, over all shards."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    before = itertools.accumulate([0, *(n for *_, n in shards)])
    listed = [(path, start) for (_, path, *_), start in zip(shards, before, strict=False)]
    kinds, names = to_arrow_schema(StructType.fromDDL(result)), StructType.fromDDL(result).names

    def entries(batches):
        import pyarrow as pa

        for part in rows(batches, "path", "start"):
            for path, start in part:
                made = []
                for key, ids in Shard(path).entries():
                    made.append(dict(zip(names, make(doc_of(key), start, ids), strict=True)))
                    start += len(ids) // 4
                    if len(made) == 1024:
                        yield pa.RecordBatch.from_pylist(made, schema=kinds)
                        made = []
                yield pa.RecordBatch.from_pylist(made, schema=kinds)

    files = spark.createDataFrame(listed, "path string, start long")
    return mapped(files.repartition(max(1, len(listed))), entries, result)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id, start and ids (array of long) of every document, from the shards written for it."""
    return read(docs.sparkSession, write(docs, tokenizer, end_id), "doc_id long, start long, ids array<long>", lambda d, s, ids: (d, s, np.frombuffer(ids, dtype="<u4").astype("int64").tolist()))


def digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """token_table with each document's ids as count and crc32."""
    return read(docs.sparkSession, write(docs, tokenizer, end_id), "doc_id long, start long, n_tokens long, ids_crc32 long", lambda d, s, ids: (d, s, len(ids) // 4, zlib.crc32(ids)))
