"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their keys (8 bytes, big-endian, sign flipped, so that byte order
is number order; a null id is the empty key and comes first). File layout:

    blocks    entries: varint shared prefix, varint rest of key, varint value bytes, rest of key, value;
              the first entry of a block shares nothing. A block ends at BLOCK bytes or more.
    index     for each block: varint key length, last key, varint offset, varint length
    bloom     bits of a Bloom filter over the keys
    footer    fixed size: offsets and lengths of index and bloom, hashes, counts, width of an id, magic

A value is the document's ids, little-endian, 2 or 4 bytes each as the vocabulary needs. A reader finds a key by
the filter, a binary search of the sparse index and one block.

Encoding: a byte-level BPE splits a text into pieces before it merges. Texts of ASCII and Latin-1 letters are split by the
pattern here; each distinct piece goes to the library's model once, and pieces met lately come from a bounded table.
Other texts go to the library whole. The ids equal those of the whole text (tested). A text that holds the string of an
added token, such as ``<|endoftext|>``, is encoded whole, as the library does it: by default to that token's id; with
``plain`` it is ordinary text.

Writing: documents are encoded where they are read, dealt to shards by ranges of the key, sorted and written by
one task each, under a temporary name that is then renamed; a repeated task writes the same bytes again. There are as
many shards as shuffle partitions, and more where a shard would hold over SHARD bytes of text; an id that fills
several shards is dealt to them by a hash of its documents' ids. Memory holds a block, the index, the filter and 8
bytes a key of one shard.

Defined results: a null text is empty (only the end id); repeated ids are separate entries; an empty table has no
shards; extra columns are not stored.
"""

from __future__ import annotations

import bisect
import posixpath
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_folder, table

BLOCK = 64 * 1024
BITS_PER_KEY, HASHES = 10, 7
MAGIC = b"SLMSST01"
FOOTER = struct.Struct("<QQQQQQIII8s")
END_ID = 0
MEMO = 150_000
SHARD = 512 * 1024 * 1024
MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("entries", pa.int64()), ("ids", pa.int64())])
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{LETTERS}]*")
PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
#: How a byte-level model writes bytes: printable ones as they are, the others as further characters.
BYTES = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b != 173}
BYTES |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in BYTES)}


@lru_cache(1)
def _encoder(path: str, plain: bool = False) -> Encoder:
    return Encoder(path, plain)


class Memo:
    """A table of the ids of some pieces met lately: of two generations, the older goes when the newer is full."""

    def __init__(self, most: int | None = None) -> None:
        self.most = most or MEMO
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def unknown(self, cuts: set[str]) -> list[str]:
        """Those of the cuts that are in neither; the others are now in the newer."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for c in cuts.difference(new):
            if c in old:
                new[c] = old[c]
            else:
                out.append(c)
        return out


class Encoder:
    """Ids of whole texts as bytes."""

    def __init__(self, path: str, plain: bool = False) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        split = self.tokenizer.pre_tokenizer
        known = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space and self.tokenizer.normalizer is None
        self.model = self.tokenizer.model if known else None
        self.pieces = Memo()

    def _piece(self, piece: str) -> bytes:
        written = (piece if piece.isascii() else piece.encode().decode("latin-1")).translate(BYTES)
        return b"".join([t.id.to_bytes(self.kind.itemsize, "little") for t in self.model.tokenize(written)])

    def _some(self, texts: list[str], tail: bytes) -> list[bytes]:
        cut = [PIECE.findall(t) if self.model and PLAIN.fullmatch(t) and not any(x in t for x in self.added) else None for t in texts]
        for p in self.pieces.unknown(set().union(*filter(None, cut))):
            self.pieces.new[p] = self._piece(p)
        whole = [t for t, c in zip(texts, cut, strict=True) if c is None]
        rest = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else ())
        of = self.pieces.new.__getitem__
        return [(np.array(next(rest).ids, self.kind).tobytes() if c is None else b"".join(map(of, c))) + tail for c in cut]

    def __call__(self, texts: list[str], end: int = END_ID) -> list[bytes]:
        tail, out = np.array([end], self.kind).tobytes(), []
        for i in range(0, len(texts), 32):
            out += self._some(texts[i : i + 32], tail)
        return out


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _bloom_hashes(key: bytes) -> tuple[int, int]:
    return zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = _bloom_hashes(key)
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Streams sorted (key, value) entries into an open binary file."""

    def __init__(self, out, width: int, block: int = BLOCK) -> None:
        self.out, self.width, self.most = out, width, block
        self.at, self.block, self.last, self.index = 0, bytearray(), None, []
        self.one, self.two = array("I"), array("I")  # the distinct keys' hashes, for the filter
        self.entries = self.ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        if key != self.last:
            a, b = _bloom_hashes(key)
            self.one.append(a)
            self.two.append(b)
        shared = 0
        if self.block:
            top = min(len(key), len(self.last))
            while shared < top and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.entries += 1
        self.ids += len(value) // self.width
        if len(self.block) >= self.most:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.out.write(self.block)
            self.index.append((self.last, self.at, len(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def finish(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index)
        bits = max(64, BITS_PER_KEY * len(self.one))
        held = np.zeros((bits + 7) // 8 * 8, np.uint8)
        one, two = np.array(self.one, np.uint64), np.array(self.two, np.uint64)
        for i in range(HASHES):
            held[((one + np.uint64(i) * two) % np.uint64(bits)).astype(np.int64)] = 1
        bloom = np.packbits(held, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.ids, bits, HASHES, self.width, MAGIC))


class Reader:
    """Reads a shard through a random-access file; holds its index and filter, and a block at a time."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        *self.places, bits, hashes, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        index_at, index_len, bloom_at, bloom_len, self.entries, self.ids = self.places
        self.bits, self.hashes, self.bloom = bits, hashes, self._read(bloom_at, bloom_len)
        data, at, self.index = self._read(index_at, index_len), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            self.index.append((key, offset, length))
        self.lasts = [k for k, _, _ in self.index]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length = self.index[i]
        data, at, key = self._read(offset, length), 0, b""
        while at < length:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] & 1 << (p & 7) for p in _bloom_places(key, self.bits, self.hashes))

    def get(self, key: bytes) -> list[bytes]:
        """All values of the key."""
        if not self.index or not self.may_hold(key):
            return []
        found = []
        for i in range(bisect.bisect_left(self.lasts, key), len(self.index)):
            for k, v in self._block(i):
                if k == key:
                    found.append(v)
                elif k > key:
                    return found
        return found


def _open(path: str):
    fs, inside = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs, inside


def read_shard(path: str) -> Reader:
    fs, inside = _open(path)
    file = fs.open_input_file(inside)
    return Reader(file, file.size())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, shards: int | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, plain: bool = False) -> DataFrame:
    """Encodes docs and writes the shards into folder (a path that all executors reach). Returns the manifest, a
    row a shard: shard, path, entries, ids, start (ids of all shards before). Ranges of doc_id come from its
    quantiles."""
    spark, vocabulary = docs.sparkSession, tokenizer or default_tokenizer()
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if shards is None:
        n = max(n, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD))
    seen = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000), F.count("*"), F.count("doc_id")).first()
    cuts = np.array(seen[0] or [], "int64")  # an id that stands here k times fills k shards
    nulls = -(-(seen[1] - seen[2]) * n // max(1, seen[1]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, plain)
        for b in batches:
            ids = encoder([t or "" for t in b["text"].to_pylist()], end_id)
            null, key = np.asarray(b["doc_id"].is_null()), np.asarray(b["doc_id"].fill_null(0))
            low = np.where(null, 0, nulls + np.searchsorted(cuts, key, side="left"))
            wide = np.maximum(np.where(null, nulls, np.searchsorted(cuts, key, side="right") - np.searchsorted(cuts, key, side="left")), 1)
            for i in np.flatnonzero(wide > 1):
                low[i] += zlib.crc32(ids[i]) % int(wide[i])
            yield pa.record_batch([pa.array(low, pa.int32()), b["doc_id"], pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"])

    width = np.dtype("<u2" if _vocabulary_size(vocabulary) <= 1 << 16 else "<u4").itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, out, made = None, None, None, []
        fs, inside = _open(folder)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"

        def close() -> None:
            writer.finish()
            out.close()
            name = f"part-{shard:06d}.sst"
            fs.move(posixpath.join(inside, f".{name}.{attempt}"), posixpath.join(inside, name))
            made.append((shard, f"{folder}/{name}", writer.entries, writer.ids))

        for b in batches:
            for s, d, v in zip(b["shard"].to_pylist(), b["doc_id"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if s != shard:
                    if writer:
                        close()
                    shard = s
                    fs.create_dir(inside, recursive=True)
                    out = fs.open_output_stream(posixpath.join(inside, f".part-{s:06d}.sst.{attempt}"))
                    writer = Writer(out, width)
                writer.add(key_of(d), v)
        if writer:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(MANIFEST.names, m, strict=True)) for m in made], schema=MANIFEST)

    encoded = rows.mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = encoded.repartitionById(int(nulls) + len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
    listing = new_folder(spark, "manifest")
    dealt.mapInArrow(write, "shard int, path string, entries long, ids long").write.parquet(listing)
    made = sorted(spark.read.schema("shard int, path string, entries long, ids long").parquet(listing).collect())  # a row a shard
    starts = np.concatenate([[0], np.cumsum([r.ids for r in made])])[:-1] if made else []
    return spark.createDataFrame([(r.shard, r.path, r.entries, r.ids, int(s)) for r, s in zip(made, starts, strict=True)], "shard int, path string, entries long, ids long, start long")


def _vocabulary_size(path: str) -> int:
    return _encoder(path).tokenizer.get_vocab_size()


def read_documents(spark: SparkSession, manifest: DataFrame, values: bool = False) -> DataFrame:
    """All documents of the shards, from the files: doc_id, start, n_tokens, ids_crc32 and, if asked, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * values

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, start in zip(b["path"], b["start"], strict=True):
                reader, at, rows = read_shard(path), int(start), []
                kind = np.dtype(f"<u{reader.width}")
                for key, value in reader:
                    ids = np.frombuffer(value, kind).astype("<u4")
                    rows.append((id_of(key), at, len(ids), zlib.crc32(ids.tobytes()), *([ids.astype("int32")] * values)))
                    at += len(ids)
                    if len(rows) >= (256 if values else 8192):
                        yield _frame(rows, values)
                        rows = []
                if rows:
                    yield _frame(rows, values)

    n = max(1, manifest.count())
    return manifest.select("shard", "path", "start").repartitionById(n, F.col("shard") % n).mapInPandas(read, schema)


def _frame(rows: list, values: bool) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * values])
    df["doc_id"] = df["doc_id"].astype("Int64")
    return df


def look_up(manifest: DataFrame, doc_ids: list[int | None]) -> DataFrame:
    """The documents of a stated list of ids: doc_id, ids. Each shard is asked by filter and binary search."""
    keys = [key_of(d) for d in doc_ids]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                reader = read_shard(path)
                rows = [(id_of(k), np.frombuffer(v, f"<u{reader.width}").astype("int32")) for k in keys for v in reader.get(k)]
                out = pd.DataFrame(rows, columns=["doc_id", "ids"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return manifest.select("path").mapInPandas(find, "doc_id long, ids array<int>")


def op1_token_shards(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_documents(spark, write_shards(docs, new_folder(spark, "tokens")))
