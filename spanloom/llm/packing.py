"""Best-fit packing of tokenized documents into sequences of a fixed size, planned over a histogram of lengths.

A document is its ids and an end id; one longer than a sequence is cut into pieces of its size, and the last piece may
be shorter. Pieces are encoded where documents are read and written as a narrow table. The plan sees lengths only:
counts of pieces by length, ``size`` rows at most whatever the input, are packed longest first, each into the
sequences with the least space that holds it. Equal lengths are placed together: sequences with equal space stand in
the plan as one range of numbers with their count, and take space // length pieces each, as one by one they would. A
range's space at least halves each time it is used up, and each length splits one range at most, so the plan is
bounded by the size, not by the documents (some 12 rows a range, 3 ranges a length). Pieces then take their planned
places by a join on rank within length with the broadcast plan.

The rank needs no task that sees all pieces of a length: pieces are numbered within (length, task that wrote them), and
the counts of those groups, summed in order, give each group its first rank. So a length that a third of all pieces
have is spread over as many tasks as the table has files.

Encoding: where a tokenizer drops white space and splits by the known pattern below, texts of ASCII and Latin-1 letters
are split by the pattern here, and each distinct piece goes to the library's model once; pieces met lately come from a
bounded table. Other texts, texts with the string of an added token, and any other tokenizer's go to the library whole.
The ids equal those of the whole text (tested).

Defined results: a null or empty text is the end id alone; repeated rows and ids are documents of their own; a null id
stays null; an empty table has no pieces; extra columns are not carried.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table
from .sstable import BYTES, Memo

SIZE, END_ID = 4096, 1
#: Fixed value: the split of the tokenizer whose words may be encoded on their own.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "a-zß-öø-ÿ"
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{LETTERS}À-ÖØ-Þ]*")
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
PIECES = 300_000


class Encoder:
    """Ids of whole texts as little-endian bytes, two or four an id."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        says = json.loads(Path(path).read_text())
        steps = [s["type"] for s in (says["normalizer"] or {}).get("normalizers", [])]
        split = ((says["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        bare = all(a[:1] == "<" for a in self.added)
        self.by_piece = bare and steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": SPLIT} and split.get("invert") and split.get("behavior") == "Removed"
        self.pieces = Memo(PIECES)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTES)
        return b"".join([t.id.to_bytes(self.kind.itemsize, "little") for t in self.tokenizer.model.tokenize(written)])

    def _plain(self, text: str) -> bool:
        """Plain letters, and no added token's string in either case."""
        return self.by_piece and bool(PLAIN.fullmatch(text)) and not ("<" in text and any(a in text.lower() for a in self.added))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 32):
            some = texts[at : at + 32]
            cut = [PIECE.findall(t.lower()) if self._plain(t) else None for t in some]
            for p in self.pieces.unknown(set().union(*filter(None, cut))):
                self.pieces.new[p] = self._piece(p)
            whole = iter(self._library([t for t, c in zip(some, cut, strict=True) if c is None]))
            of = self.pieces.new.__getitem__
            for c in cut:
                yield next(whole) if c is None else b"".join(map(of, c))


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, ids (binary, little-endian, 4 bytes each) of all pieces."""
    path = tokenizer or default_tokenizer()
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * ids]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            rows = []
            for d, found in zip(b["doc_id"].to_pylist(), encoder([t or "" for t in b["text"].to_pylist()]), strict=True):
                whole = np.append(np.frombuffer(found, encoder.kind).astype("<u4"), np.uint32(end_id))
                for k, at in enumerate(range(0, len(whole), size)):
                    part = whole[at : at + size]
                    data = part.tobytes()
                    rows.append((d, k, at, len(part), zlib.crc32(data), *([data] * ids)))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from_rank, to_rank, first_sequence, per_sequence, offset): pieces of a length with these ranks go in
    order of rank, per_sequence each, to the sequences from first_sequence on, from offset on."""
    ranges: dict[int, list[tuple[int, int]]] = {}  # space left: (first sequence, how many)
    spaces: list[int] = []
    made, out = 0, []

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in ranges:
                ranges[space] = []
                insort(spaces, space)
            ranges[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = ranges[space].pop()
                if not ranges[space]:
                    del ranges[space], spaces[at]
            else:
                space, first, n = size, made, -(-left // (size // length))
                made += n
            per = space // length
            take = min(left, n * per)
            whole, rest = divmod(take, per)
            out.append((length, rank, rank + take, first, per, size - space))
            put(space - per * length, first, whole)
            put(space - rest * length, first + whole, int(rest > 0))
            put(space, first + whole + (rest > 0), n - whole - (rest > 0))
            rank, left = rank + take, left - take
    return out


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """The pieces of docs with their places: doc_id, piece, start (ids of the document before it), length, ids_crc32,
    sequence_id, offset and, if asked, ids. The pieces stay in the shared folder, as the result is read from them."""
    spark = docs.sparkSession
    cut = pieces(docs, size, tokenizer, end_id, doc_id, text, ids)
    made = materialize(cut.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "pieces")
    groups = made.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    groups = materialize(groups.withColumn("_before", F.coalesce(before, F.lit(0))), "lengths")
    counts = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("_n")).collect()}  # size rows at most
    places = spark.createDataFrame(plan(counts, size), "length long, from_rank long, to_rank long, first long, per long, at long")
    places = places.groupBy("length").agg(F.collect_list(F.struct("from_rank", "to_rank", "first", "per", "at")).alias("_places"))
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_row")) - 1
    ranked = made.withColumn("_in", rank).join(groups.select("length", "_part", "_before"), ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    mine = F.filter("_places", lambda x: (x["from_rank"] <= F.col("_rank")) & (F.col("_rank") < x["to_rank"]))[0]
    placed = ranked.join(F.broadcast(places), "length").withColumn("_at", mine).withColumn("_k", F.col("_rank") - F.col("_at.from_rank"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_at.first") + F.expr("_k div _at.per")).alias("sequence_id"), (F.col("_at.at") + F.col("_k") % F.col("_at.per") * F.col("length")).alias("offset"), *["ids"] * ids
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_ids and ids (binary, 4 bytes an id) of pieces packed with their ids; a sequence is bounded by its size."""
    one = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return one.select("sequence_id", "n_ids", F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op11_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
