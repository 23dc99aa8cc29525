"""Token ids in sorted-string-table shards.

A shard file holds, in this order:

* blocks, zstandard-compressed: entries in key order, each the varints (bytes shared with the previous
  key, bytes of the rest, bytes of the value), the rest of the key, and the value, the document's ids as little-endian integers;
* the sparse index: per block its first key, place, size, entry count and the ids before it;
* a Bloom filter over all keys;
* a footer of fixed size: places of index and filter, counts, id width, hash count, magic.

A key is the document's id as 8 big-endian bytes with the sign bit flipped, so bytes sort as ids do; a null
id has the empty key and sorts first. Shards are ranges of ids in ascending order.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from .common import new_path, readers, stage, text_batches
from .tokens import encoder

FOOTER = struct.Struct("<QQQQQQII8s")
MAGIC = b"SILVASST"
#: Bytes of a block before compression, and of a file, beyond which a new one begins.
BLOCK_BYTES, FILE_BYTES = 256 << 10, 64 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
END_ID = 2


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


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
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_bits(key: bytes, size: int, hashes: int) -> list[int]:
    one, two = zlib.crc32(key), zlib.adler32(key[::-1] + b"#") * 0x9E3779B1 & 0xFFFFFFFF | 1
    return [(one * 0x85EBCA6B + i * two + i * i) % size for i in range(hashes)]


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out: pa.NativeFile, width: int):
        self.out, self.width, self.at = out, width, 0
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.ids = self.block_ids = self.entries = 0
        self.block, self.last, self.first = bytearray(), b"", b""
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.entries:
            self.first, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.entries += 1
        self.keys.append(key)
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            data = self.packer.compress(bytes(self.block))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data), self.entries, self.block_ids))
            self.at += len(data)
            self.block, self.entries, self.block_ids = bytearray(), 0, self.ids

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QIIQ", *rest) for k, *rest in self.index)
        size = max(64, BLOOM_BITS * len(self.keys))
        bits = np.zeros(size, dtype=np.uint8)
        for key in self.keys:
            bits[_bloom_bits(key, size, BLOOM_HASHES)] = 1
        bloom = np.packbits(bits).tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), size, len(self.keys), self.ids, self.width, BLOOM_HASHES, MAGIC))
        self.out.close()


class Reader:
    """Reads one shard: all of it in order, or one key by filter, index and block."""

    def __init__(self, uri: str):
        self.file = files.open_input(uri)
        end = self.file.size()
        self.file.seek(end - FOOTER.size)
        place, index_len, bloom_at, self.bits, self.count, self.ids, self.width, self.hashes, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.file.seek(place)
        raw, at = self.file.read(index_len), 0
        self.index = []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QIIQ", raw, at + n)))
            at += n + 24
        self.file.seek(bloom_at)
        self.bloom = self.file.read((self.bits + 7) // 8)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, size, entries, _ = self.index[i]
        self.file.seek(place)
        data, at, key = zstandard.ZstdDecompressor().decompress(self.file.read(size)), 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, dtype=f"<u{self.width}", count=size // self.width, offset=at)
            at += size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first entry of ``doc_id``; None if the shard has none."""
        key = key_of(doc_id)
        if not all(self.bloom[b >> 3] >> (7 - (b & 7)) & 1 for b in _bloom_bits(key, self.bits, self.hashes)):
            return None
        firsts = [x[0] for x in self.index]
        i = max(0, bisect.bisect_left(firsts, key) - 1)
        while i < len(firsts) and firsts[i] <= key:
            for k, ids in self.block(i):
                if k == key:
                    return ids
            i += 1
        return None


def write_shards(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Encode every whole text, write shards under ``folder``, and return their manifest.

    Manifest: shard (order), part, path, docs, ids, first_id, last_id. A null or empty text is the end id
    alone. Rows that share an id are all stored, in the order of a hash of their texts. Null ids come
    first. An empty table has an empty manifest. Ids must fit ``width`` bytes. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, made, writer, uri = encoder(tokenizer), [], None, ""
        lo = hi = None

        def close() -> None:
            writer.close()
            made.append((part, len(made), uri, len(writer.keys), writer.ids, lo, hi))

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for rows, texts in text_batches(batches):
            flat, counts = words.encode(texts, end_id)
            if len(flat) and int(flat.max()) >> (8 * width):
                raise ValueError(f"a token id needs more than {width} bytes")
            at = 0
            for doc_id, n in zip(rows.column(0).to_pylist(), counts.tolist()):
                if writer is None:
                    uri, out = files.create(folder, f"shard-{len(made):04d}", ".sst")
                    writer, lo = Writer(out, width), doc_id
                writer.add(key_of(doc_id), flat[at : at + n])
                at, hi = at + n, doc_id
                if writer.at > FILE_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        columns = list(zip(*made)) or [[] for _ in range(7)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["part", "file", "path", "docs", "ids", "first_id", "last_id"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    order = ["_id", "_hash", "_row"]  # rows that share an id, even all that is in them, may be many: ranges part them too
    rows = rows.withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    made = rows.mapInArrow(run, "part long, file long, path string, docs long, ids long, first_id long, last_id long")
    return stage(made, "manifest").withColumn("shard", F.row_number().over(Window.orderBy("part", "file")) - 1)  # a row per file: few


def read_shards(manifest: DataFrame) -> DataFrame:
    """All documents of the shards, read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for key, ids in Reader(path).scan():
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    placed = manifest.withColumn("before", before).select("path", "before", "shard")
    spread = placed.repartition(readers(manifest.sparkSession, manifest.count()), F.col("shard")).select("path", "before")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer: str, **columns: str) -> DataFrame:
    """Write shards to the shared folder and return what they hold, read back from the files."""
    spark: SparkSession = docs.sparkSession
    return read_shards(write_shards(docs, new_path(spark, "shards"), tokenizer, **columns))
