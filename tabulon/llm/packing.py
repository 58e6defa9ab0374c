"""Harmonic packing of token sequences into fixed-length training sequences.

A document's tokens are cut into whole sequences of ``capacity``, then into
pieces of exactly 1/2, 1/4, ... of it while they are at least ``min_piece``
long, and one last short piece.  A piece of length ``l`` belongs to class
``k = capacity // l``: every bin of class ``k`` holds exactly ``k`` pieces, so a
bin never overflows and the pieces of exact fractions fill it without padding.

Workers need no common state.  Pieces are numbered within their class by
(hash bucket, order in the bucket): a small table of counts per (class, bucket)
gives every bucket its first number, then piece ``r`` is in bin ``r // k``.  A
hot class is spread over all buckets.

What is left over at the end of a class (fewer than ``k`` pieces) would be a
padded sequence per class.  Exact fractions are instead grouped into runs of a
power-of-two length, which need no padding, and a last short piece is cut into
its binary parts, which are packed as exact fractions in their turn.  There are
at most ``k`` such pieces per class, however large the corpus.

Defined results: a null or empty text is a document of the closing id alone;
null and repeated ids are packed like any other row; an empty table gives no
pieces; ``sequence_id`` is unique per sequence and not dense.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from typing import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.alphabet import DIGITS, LETTERS, common
from tabulon.llm.common import no_clash, partitions, settled, small_batches
from tabulon.llm.token_counts import byte_symbols

#: entries in one generation of a worker's caches
CACHE_ENTRIES = 400_000


class Remembered(dict):
    """Values of a function by string, in two generations of bounded size: when
    the young one is full it becomes the old one, and what is asked for again
    moves back, so frequent strings stay however many rare ones pass."""

    def __init__(self, compute, entries: int, longest: int = 48):
        super().__init__()
        self.compute, self.entries, self.longest, self.old = compute, entries, longest, {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.compute(key)
            if len(key) > self.longest:
                return out
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class TextIds:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The library encodes each distinct piece; bounded caches per worker keep the
    bytes of pieces and of the chunks between spaces.  Texts with characters
    outside the common alphabet, runs of spaces or special strings go to the
    library whole."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # the vocabulary's own splitting rule, on the common alphabet
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+").findall
        self.symbols = dict(enumerate(byte_symbols()))
        self.tokenize = self.library.model.tokenize
        self.piece = Remembered(self.one_piece, entries)
        self.after_space = Remembered(lambda c: b"".join(map(self.piece.__getitem__, self.split(" " + c))), entries)

    @staticmethod
    def as_bytes(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def whole(self, text: str) -> bytes:
        return self.as_bytes(self.library.encode(text, add_special_tokens=False).ids)

    def one_piece(self, p: str) -> bytes:
        """A piece that the splitting rule leaves whole, by the library's model."""
        shown = p.encode("utf-8").decode("latin-1").translate(self.symbols)
        return self.as_bytes([t.id for t in self.tokenize(shown)])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "  " in text or not common(text) or any(s in text for s in self.specials):
            return self.whole(text)
        head, *rest = text.split(" ")
        return b"".join(map(self.piece.__getitem__, self.split(head))) + b"".join(map(self.after_space.__getitem__, rest))


_ENCODERS: dict[str, TextIds] = {}


def encoder(path: str) -> TextIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextIds(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int, min_piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    out, at = [(s, capacity) for s in range(0, n - capacity + 1, capacity)], n - n % capacity
    size = capacity // 2
    while size >= min_piece:
        if n - at >= size:
            out.append((at, size))
            at += size
        size //= 2
    return out + ([(at, n - at)] if at < n else [])


def binary_parts(start: int, n: int) -> list[tuple[int, int]]:
    """(start, length) of the powers of two that make up a short piece."""
    out = []
    for j in reversed(range(n.bit_length())):
        if n >> j & 1:
            out.append((start, 1 << j))
            start += 1 << j
    return out


_PIECE = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("ids_crc32", T.LongType())


def cut_documents(docs: DataFrame, vocabulary: str, closing_id: int, capacity: int, min_piece: int, text: str,
                  keep: Sequence[str], with_ids: bool) -> DataFrame:
    """One row per piece; a last short piece also carries its binary parts."""
    small_batches(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    out = src.drop("_text").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        out = out.add(name, T.LongType(), False)
    out = out.add("_parts", T.ArrayType(_PIECE))
    if with_ids:
        out = out.add("ids", T.BinaryType())
    width = len(keep)

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa
        enc = encoder(vocabulary)
        close = np.asarray([closing_id], dtype="<u4").tobytes()
        parts_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

        def piece(view, start, length):
            return {"start": start, "length": length, "ids_crc32": zlib.crc32(view[4 * start:4 * (start + length)])}

        for b in batches:
            row, pieces, tokens, parts, raw = [], [], [], [], []
            for i, x in enumerate(b.column(width)):
                data = memoryview(enc.ids(x.as_py()) + close)
                n = len(data) // 4
                for start, length in cuts(n, capacity, min_piece):
                    row.append(i)
                    tokens.append(n)
                    pieces.append(piece(data, start, length))
                    exact = capacity % length == 0
                    parts.append(None if exact else [piece(data, s, m) for s, m in binary_parts(start, length)])
                    if with_ids:
                        raw.append(bytes(data[4 * start:4 * (start + length)]))
            took = pa.array(row, pa.int32())
            cols = [c.take(took) for c in b.columns[:width]]
            cols += [pa.array([p[f] for p in pieces], pa.int64()) for f in ("start", "length", "ids_crc32")]
            cols += [pa.array(tokens, pa.int64()), pa.array(parts, parts_type)]
            if with_ids:
                cols.append(pa.array(raw, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return src.mapInArrow(run, out)


def _numbered(pieces: DataFrame, buckets: int, order: Sequence[str]) -> DataFrame:
    """Adds ``_r``, the 0-based number within the class, and ``_n``, its size."""
    d = pieces.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = d.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_c"))
    by_class = Window.partitionBy("_k")
    # classes x buckets rows, whatever the corpus
    first = counts.select("_k", "_b", F.sum("_c").over(by_class).alias("_n"),
                          (F.sum("_c").over(by_class.orderBy("_b")) - F.col("_c")).alias("_first"))
    local = d.withColumn("_i", F.row_number().over(Window.partitionBy("_k", "_b").orderBy(*order)))
    return (local.join(F.broadcast(first), ["_k", "_b"])
            .withColumn("_r", F.col("_first") + F.col("_i") - 1).drop("_b", "_i", "_first"))


def _power_of_two_runs(rest: F.Column, n_rest: F.Column, most: int) -> F.Column:
    """Which run the ``rest``-th of ``n_rest`` left-over equal pieces is in: the
    runs have the lengths of the binary digits of ``n_rest``, longest first."""
    run = F.lit(0)
    before = F.lit(0)
    for j in reversed(range(most.bit_length())):
        size = n_rest.bitwiseAND(1 << j)
        run = F.when((size > 0) & (rest >= before) & (rest < before + size), F.lit(j)).otherwise(run)
        before = before + size
    return run


def pack_documents(docs: DataFrame, vocabulary: str, closing_id: int = 1, capacity: int = 2048, min_piece: int = 256,
                   text: str = "text", keep: Sequence[str] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset: ``keep`` columns, start, length,
    ids_crc32, doc_tokens (and ``ids`` as bytes, when asked for)."""
    if capacity & (capacity - 1) or min_piece & (min_piece - 1) or not 1 <= min_piece <= capacity:
        raise ValueError("capacity and min_piece must be powers of two")
    no_clash(keep, "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset", "_text", "_parts",
             "_k", "_b", "_c", "_n", "_first", "_i", "_r", "_bin", "_kind", "_start", "_p")
    buckets = max(8, partitions(docs.sparkSession))
    pieces = settled(cut_documents(docs, vocabulary, closing_id, capacity, min_piece, text, keep, with_ids)
                     .withColumn("_k", F.floor(F.lit(capacity) / F.col("length")).cast("long")))
    order = [f"`{c}`" for c in keep] + ["start", "length", "ids_crc32", "doc_tokens"]     # equal rows are the same piece
    order = [F.col(c) for c in order]
    num = _numbered(pieces, buckets, order)
    exact = (F.lit(capacity) % F.col("length")) == 0
    full = F.floor(F.col("_n") / F.col("_k"))
    bin_ = F.floor(F.col("_r") / F.col("_k"))
    in_full = bin_ < full
    rest, n_rest = F.col("_r") - full * F.col("_k"), F.col("_n") - full * F.col("_k")
    cols = [F.col(f"`{c}`") for c in keep]
    own = [*cols, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    # a short class may hold exact fractions beside other lengths; its last bin is dissolved
    short = F.col("_k") > capacity // min_piece
    mixed = short | ~exact | (F.col("_k") == capacity // min_piece)
    main = num.where(in_full).select(*own, "_k", bin_.alias("_bin"), F.lit(0).alias("_kind"))
    runs = num.where(~in_full & ~mixed).select(
        *own, "_k", _power_of_two_runs(rest, n_rest, capacity).cast("long").alias("_bin"), F.lit(1).alias("_kind"))
    tail = num.where(~in_full & mixed)
    whole = F.array(F.struct(*[F.col(c).alias(c) for c in ("start", "length", "ids_crc32")]))
    part = tail.withColumn("_start", F.col("start")).withColumn("_p", F.explode(F.coalesce("_parts", whole)))
    part = part.select(*cols, F.col("_p.start").alias("start"), F.col("_p.length").alias("length"),
                       F.col("_p.ids_crc32").alias("ids_crc32"), "doc_tokens",
                       *([F.expr("substring(ids, cast(4 * (_p.start - _start) + 1 as int), cast(4 * _p.length as int))").alias("ids")] if with_ids else []),
                       F.floor(F.lit(capacity) / F.col("_p.length")).cast("long").alias("_k"))
    tnum = _numbered(part, buckets, order)
    tail_full = tnum.where(in_full).select(*own, "_k", bin_.alias("_bin"), F.lit(2).alias("_kind"))
    tail_runs = tnum.where(~in_full).select(
        *own, "_k", _power_of_two_runs(rest, n_rest, capacity).cast("long").alias("_bin"), F.lit(3).alias("_kind"))

    placed = main.unionByName(runs).unionByName(tail_full).unionByName(tail_runs)
    # bin, class and kind side by side in one number: classes go up to the capacity
    seq = (F.col("_bin") * (2 * capacity) + F.col("_k")) * 4 + F.col("_kind")
    placed = placed.withColumn("sequence_id", seq.cast("long"))
    slot = Window.partitionBy("sequence_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(slot), F.lit(0)).cast("long")).drop("_k", "_bin", "_kind")
