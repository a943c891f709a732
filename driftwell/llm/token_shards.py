"""Token ids in sorted-string-table shards: written in key order, found again by binary search.

Shard format.  Data blocks hold entries sorted by key; a key is stored as the length it shares with the key
before it and the rest, its value as the ids in 16 or 32 bits.  Blocks are deflated with zstandard and
carry a CRC-32.  After them come a sparse index (first key and place of each block), a Bloom filter over
keys and a footer of fixed size.  A key is the document's id as eight bytes whose order is the ids' order;
a null id is the empty key and sorts first.

Documents are dealt to tasks by ranges of ids, so shards follow each other in id order.  A task writes under
names of its own attempt; the driver renames what successful attempts report, so a task that runs again never
meets a name that is taken.  ``_MANIFEST.json`` is written last: the shards in key order, each with its first
and last key and the number of ids before it.  A search bisects the manifest, then the shard's index.

Defined cases: null text is an empty text (the end id alone); texts may be as long as a string can be, as an
entry may exceed its block's target size; rows that repeat an id are all kept, ordered by text hash (a tie of
both is a repeated row); a null id sorts first; an empty table writes a manifest without shards; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm._util import commit, frugal, shared_dir, table, texts
from driftwell.llm.tokens import encoder, public_vocabulary

MAGIC = b"DWSST001"
BLOCK_BYTES = 1 << 18
SHARD_BYTES = 1 << 27
#: Pieces of text whose ids a worker keeps: 20 MB of documents have 320,000, and merging one again takes about as long as finding ten.
PIECES = 400_000
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQI8s")  # index at, size; filter at, size; entries; ids; checksum; magic


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while data[at] > 127:
        n |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
    return n | data[at] << shift, at + 1


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(keys: list[bytes], size: int) -> np.ndarray:
        h = np.array([(zlib.crc32(k), zlib.crc32(k, 0x9E3779B9) | 1) for k in keys], np.uint64).reshape(-1, 2)
        return (h[:, :1] + np.arange(BLOOM_HASHES, dtype=np.uint64) * h[:, 1:]) % np.uint64(size)

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        size = max(64, -(-len(keys) * BLOOM_BITS // 8) * 8)
        flags = np.zeros(size, bool)
        flags[cls._places(keys, size).ravel().astype(np.int64)] = True
        return cls(np.packbits(flags))

    def may_hold(self, key: bytes) -> bool:
        at = self._places([key], len(self.bits) * 8)[0].astype(np.int64)
        return bool((self.bits[at >> 3] & (128 >> (at & 7)) > 0).all())


class ShardWriter:
    """Streams sorted entries to a file; holds one block, the index and the keys' filter input."""

    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes, self.at = out, id_bytes, 0
        self.squeeze = zstandard.ZstdCompressor(level=1).compress
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.ids = self.entries = 0
        self._open()

    def _open(self) -> None:
        self.block, self.size, self.first, self.last = [], 0, None, b""

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        head = _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(ids))
        self.block += [head, ids]
        self.size += len(head) + len(ids)
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.ids += len(ids) // self.id_bytes
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            body = self.squeeze(b"".join(self.block))
            self._write(body + struct.pack("<I", zlib.crc32(body)))
            self.index.append((self.first, self.at - len(body) - 4, len(body) + 4))
            self._open()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def finish(self) -> None:
        self.flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(size) for k, at, size in self.index)
        bloom = Bloom.of(self.keys).bits.tobytes()
        at = self.at
        self._write(index + bloom)
        self._write(_FOOTER.pack(at, len(index), at + len(index), len(bloom), self.entries, self.ids, zlib.crc32(index + bloom), MAGIC))


class Shard:
    """A finished shard; ``get`` reads the footer, the filter and one block."""

    def __init__(self, files: pafs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        foot = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if foot[7] != MAGIC:
            raise ValueError(f"not a shard: {path}")
        tail = self.file.read_at(foot[1] + foot[3], foot[0])
        if zlib.crc32(tail) != foot[6]:
            raise ValueError(f"index of {path}")
        self.entries, self.ids = foot[4:6]
        self.bloom = Bloom(np.frombuffer(tail[foot[1] :], np.uint8))
        self.index, at = [], 0
        while at < foot[1]:
            n, at = _read_varint(tail, at)
            key, at = tail[at : at + n], at + n
            start, at = _read_varint(tail, at)
            length, at = _read_varint(tail, at)
            self.index.append((key, start, length))

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, start, length = self.index[i]
        raw = self.file.read_at(length, start)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("checksum of a block")
        data, at, key = zstandard.ZstdDecompressor().decompress(raw[:-4]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + n], at + n
            n, at = _read_varint(data, at)
            yield key, data[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of this id: none if it is absent, several if rows repeat it."""
        key = key_of(doc_id)
        if not self.bloom.may_hold(key):
            return []
        firsts = [k for k, _, _ in self.index]
        i, found = max(0, bisect_right(firsts, key) - 1), []
        while i > 0 and firsts[i] == key:  # equal keys may begin in an earlier block
            i -= 1
        while i < len(firsts) and firsts[i] <= key:
            found += [v for k, v in self.block(i) if k == key]
            i += 1
        return found


@dataclass(frozen=True)
class Spec:
    """What to write: vocabulary file by public name or path, the id that ends a document, bytes an id (2 or 4)."""

    vocabulary: str
    end_id: int
    id_bytes: int = 2

    def encode(self, text: str) -> bytes:
        path = self.vocabulary if "/" in self.vocabulary else public_vocabulary(self.vocabulary)
        known = encoder(path, PIECES)
        if known.dtype.itemsize > self.id_bytes:
            raise ValueError("ids of this vocabulary need id_bytes=4")
        ids = known.encode(text) + np.array([self.end_id], known.dtype).tobytes()
        return ids if known.dtype.itemsize == self.id_bytes else np.frombuffer(ids, known.dtype).astype(f"<u{self.id_bytes}").tobytes()


def write_shards(docs: DataFrame, folder: str, spec: Spec) -> list[dict]:
    """Write ``docs`` to ``folder``; the manifest's rows, in id order, each with the number of ids before it.

    The rows collected are one for each shard.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        rows, out, n = [], None, 0

        def close() -> None:
            nonlocal out, n
            writer.finish()
            out.close()
            rows.append((task.partitionId(), n, temporary, writer.entries, writer.ids, writer.at, writer.keys[0].hex(), writer.keys[-1].hex()))
            out, n = None, n + 1

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    temporary = f"_tmp-{task.partitionId()}-{n}-{task.taskAttemptId()}"
                    out = files.open_output_stream(f"{root}/{temporary}")
                    writer = ShardWriter(out, spec.id_bytes)
                writer.add(key_of(doc_id), spec.encode(text))
                if writer.at >= SHARD_BYTES:
                    close()
        if out is not None:
            close()
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if i in (2, 6, 7) else pa.int64()) for i, c in enumerate(cols)],
            ["part", "n", "temporary", "entries", "ids", "bytes", "first", "last"],
        )

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = texts(docs).withColumn("_h", F.xxhash64("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "_h")
    found = (
        ranged.select("doc_id", "text")
        .mapInArrow(run, "part long, n long, temporary string, entries long, ids long, bytes long, first string, last string")
        .collect()
    )
    manifest, moves, before = [], {}, 0
    for r in sorted(found, key=lambda r: (r.part, r.n)):
        name = f"shard-{r.part:06d}-{r.n:04d}.sst"
        moves[r.temporary] = name
        manifest.append({"name": name, "entries": r.entries, "ids": r.ids, "bytes": r.bytes, "ids_before": before, "first": r.first, "last": r.last})
        before += r.ids
    commit(folder, moves, {"id_bytes": spec.id_bytes, "shards": manifest})
    return manifest


def read_manifest(folder: str) -> dict:
    files, root = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{root}/_MANIFEST.json") as f:
        return json.loads(f.read())


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` read from the shards, one task a shard."""
    manifest = read_manifest(folder)
    width = manifest["id_bytes"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for key, value in Shard(files, f"{root}/{name}"):
                    ids = np.frombuffer(value, f"<u{width}")
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(s["name"], s["ids_before"]) for s in manifest["shards"]]
    shards = spark.createDataFrame(rows, "name string, ids_before long").repartition(max(1, len(rows)), "name")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(folder: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of one document: bisects the manifest for its shards, then each one's index behind the filter."""
    manifest = read_manifest(folder)
    files, root = pafs.FileSystem.from_uri(folder)
    key, shards = key_of(doc_id), manifest["shards"]
    i = bisect_left(shards, key, key=lambda s: bytes.fromhex(s["last"]))
    found = []
    while i < len(shards) and bytes.fromhex(shards[i]["first"]) <= key:
        found += Shard(files, f"{root}/{shards[i]['name']}").get(doc_id)
        i += 1
    return [np.frombuffer(v, f"<u{manifest['id_bytes']}") for v in found]


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), folder, Spec("byte_bpe_50k.json", end_id=0))
    return read_shards(spark, folder)
