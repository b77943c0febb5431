"""Token ids in sorted-string-table shards.

File format (little-endian), one file per shard:

    magic "RSST0001"
    blocks      entries in ascending key order, ENTRIES a block at most
    index       per block: offset u64, length u32, first key
    filter      Bloom filter over the keys: number of hashes u32, then the bits
    footer      offsets and lengths of index and filter (u64 each), entries u64, ids u64, magic

An entry is: bytes shared with the previous key of the block u16, other key bytes u16, ids u32, those key bytes, the
ids. The first key of a block shares nothing. Ids are u16 or u32 as the header of the block says (u8 width first). A
key is the identifier in big-endian order-preserving form, so that byte order is the order of identifiers: null first.
Keys need not be unique. A lookup asks the filter, then the block index by bisection, then reads one block.

Documents are range-partitioned by identifier and every task writes its range in order as shards of a bounded size
through the filesystem of the shared folder. A shard's name holds a fresh id; only the names that a successful task returned
reach the manifest, so what a lost executor left behind is never read.

Nulls and edge cases: null and empty texts are the end id alone; a null identifier sorts first; repeated rows are entries
of their own, in no particular order among equal keys; an empty table gives an empty manifest and result; other columns
are ignored.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowsieve.llm._common import fresh_path, materialize, read_table
from rowsieve.shipping import ship

MAGIC = b"RSST0001"
ENTRIES = 64
#: A shard is closed once it holds this many ids.
SHARD_IDS = 16_000_000
#: Bits of the Bloom filter for each key, and its hashes.
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Distinct words whose ids a worker remembers.
CACHED_WORDS = 400_000
_FOOTER = struct.Struct("<QQQQQQ8s")


def pack_key(key: int | None) -> bytes:
    return b"\0" if key is None else b"\1" + ((key + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def unpack_key(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if ":/" in uri else (pa.fs.LocalFileSystem(), uri)


class Bloom:
    def __init__(self, bits: np.ndarray, hashes: int):
        self.bits, self.hashes = bits, hashes

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        size = max(64, len(keys) * BLOOM_BITS + 7 & ~7)
        places = (cls._seeds(keys)[:, 0][:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * cls._seeds(keys)[:, 1][:, None]) % np.uint64(size)
        bits = np.zeros(size, dtype=np.uint8)
        bits[places.ravel().astype(np.int64)] = 1
        return cls(np.packbits(bits), BLOOM_HASHES)

    @staticmethod
    def _seeds(keys: list[bytes]) -> np.ndarray:
        return np.array([(zlib.crc32(k), zlib.crc32(k, 0x9747B28C) | 1) for k in keys], dtype=np.uint64).reshape(-1, 2)

    def __contains__(self, key: bytes) -> bool:
        a, b = (int(x) for x in self._seeds([key])[0])
        size = len(self.bits) * 8
        places = [(a + i * b) % size for i in range(self.hashes)]
        return all(self.bits[p >> 3] & (128 >> (p & 7)) for p in places)


class Writer:
    """Writes one shard; add() takes keys in ascending order."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.out, self.at = fs.open_output_stream(path), 0
        self.index, self.keys, self.block, self.ids = [], [], [], 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        self.block.append((key, ids))
        self.keys.append(key)
        self.ids += len(ids)
        if len(self.block) == ENTRIES:
            self._flush()

    def _flush(self) -> None:
        if not self.block:
            return
        width = 4 if any(len(x) and int(x.max()) > 0xFFFF for _, x in self.block) else 2
        parts, before = [bytes([width])], b""
        for key, ids in self.block:
            shared = next((i for i, (a, b) in enumerate(zip(before, key)) if a != b), min(len(before), len(key)))
            parts += [struct.pack("<HHI", shared, len(key) - shared, len(ids)), key[shared:], ids.astype(f"<u{width}").tobytes()]
            before = key
        data = b"".join(parts)
        self.index.append((self.at, len(data), self.block[0][0]))
        self._write(data)
        self.block = []

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<QIH", at, n, len(key)) + key for at, n, key in self.index)
        bloom = Bloom.of(self.keys)
        filtered = struct.pack("<I", bloom.hashes) + bloom.bits.tobytes()
        at = self.at
        self._write(index + filtered)
        self._write(_FOOTER.pack(at, len(index), at + len(index), len(filtered), len(self.keys), self.ids, MAGIC))
        self.out.close()


class Reader:
    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        *places, self.entries, self.ids, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        index, at, self.index = self._read(*places[:2]), 0, []
        while at < len(index):
            offset, n, k = struct.unpack_from("<QIH", index, at)
            self.index.append((index[at + 14 : at + 14 + k], offset, n))
            at += 14 + k
        bloom = self._read(*places[2:])
        self.bloom = Bloom(np.frombuffer(bloom, dtype=np.uint8, offset=4), struct.unpack_from("<I", bloom)[0])

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, n = self.index[i]
        data, at, key = self._read(offset, n), 1, b""
        width = data[0]
        while at < n:
            shared, more, count = struct.unpack_from("<HHI", data, at)
            key = key[:shared] + data[at + 8 : at + 8 + more]
            at += 8 + more
            yield key, np.frombuffer(data, dtype=f"<u{width}", count=count, offset=at)
            at += count * width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry with this key."""
        if key not in self.bloom:
            return []
        firsts, found = [x[0] for x in self.index], []
        # Entries with this key may begin in the block before the first one whose first key isn't smaller.
        i = max(0, bisect.bisect_left(firsts, key) - 1)
        while i < len(firsts) and firsts[i] <= key:
            found += [ids for k, ids in self._block(i) if k == key]
            i += 1
        return found


class WordEncoder:
    """Encodes as a tokenizer that drops white space and case does, special tokens in the text included, and remembers the ids of words.

    Neither a match of its pattern nor a special token spans a blank, so words between blanks are encoded on their own. A word of Latin-1
    letters with ASCII symbols behind it is two matches, which the normalizer leaves as they are but for the case,
    so they can go to the tokenizer's BPE model directly."""

    PARTS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        # The model's character for each byte: itself if printable, else one from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.byte_chars = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(128, 256)}

    def encode(self, text: str) -> np.ndarray:
        words = text.replace("\n", " ").split(" ")
        ids = list(map(self.words.get, words))
        if None in ids:
            made = self._encode(dict.fromkeys(w for w, x in zip(words, ids) if x is None))
            ids = [made[w] if x is None else x for w, x in zip(words, ids)]
        return np.frombuffer(b"".join(ids), dtype="<u4")

    def _encode(self, words: dict[str, None]) -> dict[str, bytes]:
        parts = {w: (m[1].lower(), m[2]) if (m := self.PARTS.fullmatch(w)) else (w,) for w in words}
        needed = dict.fromkeys(x for xs in parts.values() for x in xs)
        new = [x for x in needed if x not in self.words]
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words, new = {}, list(needed)
        whole = {xs[0] for xs in parts.values() if len(xs) == 1}
        encode, merge, known = self.tokenizer.encode, self.tokenizer.model.tokenize, self.words
        for x in new:
            ids = encode(x, add_special_tokens=False).ids if x in whole else [t.id for t in merge(x.translate(self.byte_chars))] if x else []
            known[x] = array("I", ids).tobytes()
        made = {w: b"".join([known[x] for x in xs]) for w, xs in parts.items()}
        known.update((w, x) for w, x in made.items() if len(w) <= 6)
        return made


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Encode and write docs; the manifest has a row per shard: path, first_key, last_key, entries, n_ids.

    Task order is key order. A key of very many rows is dealt over several tasks by a hash of the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, row, end = word_encoder(tokenizer), None, None, np.array([end_id], dtype="<u4")
        done: list[tuple] = []
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value, packed = value.as_py(), pack_key(k)
                if writer and writer.ids >= SHARD_IDS:
                    writer.close()
                    done.append((*row, writer.keys[-1], len(writer.keys), writer.ids))
                    writer = None
                if writer is None:
                    row = (f"{folder}/{uuid.uuid4().hex}.sst", packed)
                    writer = Writer(row[0])
                writer.add(packed, np.concatenate([encoder.encode(value), end]) if value else end)
        if writer:
            writer.close()
            done.append((*row, writer.keys[-1], len(writer.keys), writer.ids))
        types = {"path": pa.string(), "first_key": pa.binary(), "last_key": pa.binary(), "entries": pa.int64(), "n_ids": pa.int64()}
        columns = list(zip(*done)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types.values())], names=list(types))

    ship(docs.sparkSession)
    local = folder.removeprefix("file:")
    if local != folder or ":/" not in folder:  # a local or mounted folder; object stores have none to make
        pa.fs.LocalFileSystem().create_dir("/" + local.lstrip("/"))
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    first = rows["key"].asc_nulls_first()
    rows = rows.repartitionByRange(first, F.xxhash64(rows["text"])).sortWithinPartitions(first)
    return rows.mapInArrow(work, "path string, first_key binary, last_key binary, entries bigint, n_ids bigint")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Add start, the ids of all shards before. One row a shard, so this window is over metadata only; shards of one key
    alone (that fills several) are in the order of their names, before one that goes on to other keys."""
    before = Window.partitionBy(F.lit(0)).orderBy("first_key", "last_key", "path").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Read the shards back: doc_id, start, n_tokens, ids_crc32 of every entry."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, starts, counts, sums = [], [], [], []
                for key, ids in Reader(path):
                    keys.append(unpack_key(key))
                    starts.append(start)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (keys, starts, counts, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    ship(manifest.sparkSession)
    shards = with_starts(manifest).select("path", "start")
    # One task a shard or so: paths are dealt by a hash of their random names.
    return shards.repartition("path").mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    manifest = write_shards(docs, fresh_path(spark, "sst"), public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(materialize(manifest, "sst-manifest"))
