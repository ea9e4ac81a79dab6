"""Token ids in sorted-string-table shards (numbered operator 9).

A shard is one file:

    block*            entries in key order
    index             per block: its first key, offset and length
    Bloom filter      over all keys
    footer            fixed size: offsets and lengths of index and filter, counts, magic

A key is nine bytes that sort as doc_ids do: 0 and zeros for a null id, or 1 and the id, big-endian, with its sign flipped. An
entry stores how many bytes it shares with the key before it in the block (the first shares none), the rest of the key, the
number of ids and the ids as little-endian unsigned 32-bit integers; a block is compressed by zlib. A lookup reads the footer,
asks the filter, finds the block in the index by binary search and reads that block alone.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, byte_classes, materialise, new_dir, prefix_hashes, range_hashes, text_chunks, tokens
from .tokencount import byte_letters

_SPELL = byte_letters()
MAGIC = b"GLSST001"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES = 1 << 16
END_ID = 1
#: Pieces of more bytes are told apart by a cryptographic hash: polynomial ones modulo 2**64 meet for known pairs of long words.
LONG = 64

# ---------------------------------------------------------------------------------------------------------------------
# Keys and files


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _bloom_bits(key: bytes, n_bits: int, n_hashes: int = 7) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key[::-1], 0x5BD1E995) | 1
    return [(a + k * b) % n_bits for k in range(n_hashes)]


class ShardWriter:
    """Writes entries given in key order to a binary file."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES):
        self.out, self.block_bytes = out, block_bytes
        self.at, self.block, self.size, self.last = 0, [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.first = b""

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        if not self.block:
            self.first = key
        self.block.append(struct.pack("<BBI", shared, len(key) - shared, len(ids)) + key[shared:] + ids.astype("<u4").tobytes())
        self.size += len(self.block[-1])
        self.last = key
        self.keys.append(key)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = zlib.compress(b"".join(self.block), 1)
            self.index.append((self.first, self._put(data), len(data)))
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        bits = max(64, 10 * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for i in _bloom_bits(key, bits):
                bloom[i >> 3] |= 1 << (i & 7)
        index_at, bloom_at = self._put(index), self._put(bytes(bloom))
        self._put(FOOTER.pack(index_at, len(index), bloom_at, bits, len(self.index), len(self.keys), MAGIC))


class ShardReader:
    """Reads a shard from a seekable binary file."""

    def __init__(self, source, size: int):
        self.source = source
        index_at, index_n, bloom_at, self.bits, blocks, self.count, magic = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.bloom = self._get(bloom_at, -(-self.bits // 8))
        raw, p, self.index = self._get(index_at, index_n), 0, []
        for _ in range(blocks):
            n = raw[p]
            self.index.append((raw[p + 1 : p + 1 + n], *struct.unpack_from("<QQ", raw, p + 1 + n)))
            p += 17 + n

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n = self.index[block]
        raw, p, key = zlib.decompress(self._get(at, n)), 0, b""
        while p < len(raw):
            shared, rest, count = struct.unpack_from("<BBI", raw, p)
            key = key[:shared] + raw[p + 6 : p + 6 + rest]
            p += 6 + rest
            yield key, np.frombuffer(raw, "<u4", count, p)
            p += 4 * count

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.index)):
            yield from self._entries(block)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this doc_id (several for a repeated id)."""
        key = key_of(doc_id)
        if not all(self.bloom[i >> 3] >> (i & 7) & 1 for i in _bloom_bits(key, self.bits)):
            return []
        low, high = 0, len(self.index)
        while low < high:  # the first block whose first key isn't below
            mid = (low + high) // 2
            if self.index[mid][0] < key:
                low = mid + 1
            else:
                high = mid
        out = []
        for block in range(max(0, low - 1), len(self.index)):
            if self.index[block][0] > key:
                break
            out += [ids for k, ids in self._entries(block) if k == key]
        return out


# ---------------------------------------------------------------------------------------------------------------------
# Encoding


#: 0 white space, 1 letters and bytes of longer UTF-8 sequences, 2 digits, 3 other ASCII.
_KINDS = byte_classes(space=SPACE, letter=bytes(c for c in range(256) if c > 127 or chr(c).isalpha()), digit=b"0123456789")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that make a word go to the tokenizer whole: contractions and special tokens cross the pieces, and outside
#: Latin-1's letters (lead byte C3; not the signs C3 97 and C3 B7) normalisation and letter classes need the whole word.
_WHOLE = np.zeros(256, bool)
_WHOLE[[*b"'<", *range(0xC4, 0x100), 0xC2]] = True


class CachedEncoder:
    """Encodes texts to ids exactly as the tokenizer does, each distinct piece of a word once.

    For tokenizers that drop white space, lower-case, and split words to runs of letters, single digits and runs of other
    characters. A piece's ids stay in a cache of at most `most` pieces; beyond that the cache starts anew.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.start, self.length, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: list[int], pieces: list[str], plain: list[bool]) -> None:
        """plain: pieces that only need merging; the others pass all of the tokenizer's steps."""
        merge = self.tokenizer.model.tokenize
        odd = iter(self.tokenizer.encode_batch_fast([p for p, ok in zip(pieces, plain) if not ok], add_special_tokens=False))
        found = [[t.id for t in merge(p.lower().encode().decode("latin-1").translate(_SPELL))] if ok else next(odd).ids for p, ok in zip(pieces, plain)]
        n, total = len(self.known) + len(found), self.used + sum(map(len, found))
        if n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.start, self.length))
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(total, np.uint32)])
        for h, ids in zip(hashes, found):
            k = self.known[h] = len(self.known)
            self.start[k], self.length[k] = self.used, len(ids)
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents, and the number of ids of each document."""
        docs = len(offsets) - 1
        starts, ends, doc = tokens(data, offsets, _KINDS)
        words, word_ends, word_doc = tokens(data, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(docs, np.int64)
        odd = _WHOLE[data]
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        before = np.concatenate([[0], np.cumsum(odd)])
        whole = before[word_ends] > before[words]
        inside = whole[np.searchsorted(words, starts, side="right") - 1]
        digits = ~inside & (_KINDS[data[starts]] == 2) & (ends - starts > 1)
        if digits.any():  # each digit is a piece
            at = np.repeat(starts[digits], (ends - starts)[digits])
            first = np.cumsum((ends - starts)[digits]) - (ends - starts)[digits]
            at = at + np.arange(len(at)) - np.repeat(first, (ends - starts)[digits])
            more = at, at + 1, np.repeat(doc[digits], (ends - starts)[digits])
        else:
            more = (np.empty(0, np.int64),) * 3
        keep = ~inside & ~digits
        starts, ends, doc = (np.concatenate(x) for x in zip((starts[keep], ends[keep], doc[keep]), (words[whole], word_ends[whole], word_doc[whole]), more))
        order = np.argsort(starts, kind="stable")
        plain = np.ones(len(starts), bool)
        plain[int(keep.sum()) : int(keep.sum()) + int(whole.sum())] = False
        starts, ends, doc, plain = starts[order], ends[order], doc[order], plain[order]
        low = _LOWER[data]
        h = range_hashes(prefix_hashes(low), starts, ends)
        for k in np.flatnonzero(ends - starts > LONG).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(low[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        h, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(h) > self.most:
            self._clear()
        keys = h.tolist()
        new = [k for k, x in enumerate(keys) if x not in self.known]
        if new:
            raw = data.tobytes()
            self._learn([keys[k] for k in new], [raw[starts[first[k]] : ends[first[k]]].decode() for k in new], plain[first[new]].tolist())
        entry = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[which]
        n = self.length[entry]
        before = np.cumsum(n) - n
        ids = self.pool[np.repeat(self.start[entry] - before, n) + np.arange(int(n.sum()))]
        return ids, np.bincount(doc, n, minlength=docs).astype(np.int64)


@lru_cache(maxsize=1)
def encoder(path: str) -> CachedEncoder:
    """One encoder for each Python worker, so that its cache serves all tasks that the worker runs."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return CachedEncoder(path)


# ---------------------------------------------------------------------------------------------------------------------
# Spark


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shards(docs: DataFrame, tokenizer: str, out: str, shard_bytes: int = 32 << 20) -> DataFrame:
    """Encodes docs (doc_id, text) and writes shards below `out`, a folder that driver and executors share.

    Shards hold doc_ids in ascending order, shard after shard; every document's ids end with the id 1. Null text counts as
    empty, null doc_ids come first, and repeated rows are all written. Returns the manifest, a small table on storage:
    shard int, path, entries, ids, first_key, last_key. A task that runs twice writes the same shard again under a new name;
    the manifest names the one that counts.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    dealt = texts.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                shard, key = b.column(2)[0].as_py(), None
                fs, base = filesystem(out)
                fs.create_dir(base, recursive=True)
                name = f"shard-{shard:06d}-{os.urandom(6).hex()}.sst"
                sink = fs.open_output_stream(f"{base}/{name}")
                writer, total_ids = ShardWriter(sink), 0
            ids_of = b.column(0).to_pylist()
            for first, end, data, offsets in text_chunks(b.column(1), 4 << 20):
                ids, n = encoder(tokenizer).encode(data, offsets)
                cuts = np.concatenate([[0], np.cumsum(n)])
                for k in range(end - first):
                    key = key_of(ids_of[first + k])
                    own = np.append(ids[cuts[k] : cuts[k + 1]], np.uint32(END_ID))
                    writer.add(key, own)
                    total_ids += len(own)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (f"{out}/{name}", pa.string()), (len(writer.keys), pa.int64()), (total_ids, pa.int64()), (writer.keys[0], pa.binary()), (key, pa.binary()))], names=["shard", "path", "entries", "ids", "first_key", "last_key"])

    return materialise(dealt.mapInArrow(write, "shard int, path string, entries long, ids long, first_key binary, last_key binary"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per entry of the shards, from the files: doc_id, start (ids of all entries before it), n_tokens, ids_crc32."""
    shards = sorted(manifest.select("shard", "path", "ids").collect())  # one small row for each shard
    before, rows = 0, []
    for s in shards:
        rows.append((s.path, before))
        before += s.ids
    spark = manifest.sparkSession
    frame = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, name = filesystem(path)
                rows = []
                with fs.open_input_file(name) as source:
                    for key, ids in ShardReader(source, source.size()):
                        rows.append((id_of(key), at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)

    return frame.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of one document: the manifest names the shard, the shard's filter and index the block."""
    key = key_of(doc_id)
    out = []
    for s in manifest.where((F.col("first_key") <= F.lit(bytearray(key))) & (F.col("last_key") >= F.lit(bytearray(key)))).orderBy("shard").select("path").collect():
        fs, name = filesystem(s.path)
        with fs.open_input_file(name) as source:
            out += ShardReader(source, source.size()).get(doc_id)
    return out


def encode_to_shards(docs: DataFrame, tokenizer: str, out: str | None = None, shard_bytes: int = 32 << 20) -> DataFrame:
    """Writes docs to shards and reads them back: see `write_shards` and `read_shards`. An empty table gives no rows."""
    manifest = write_shards(docs, tokenizer, out or new_dir(docs.sparkSession, "shards"), shard_bytes)
    return read_shards(manifest)


__all__: Iterable[str] = ["CachedEncoder", "ShardReader", "ShardWriter", "encode_to_shards", "lookup", "read_shards", "write_shards"]
