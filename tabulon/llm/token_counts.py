"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol per byte, held in a doubly linked list.  A heap
holds the adjacent pairs that have a merge rank; the lowest rank (leftmost on
ties) is popped, stale entries are skipped, the pair becomes one symbol and its
two new neighbours are pushed.  The count is the number of initial symbols
minus the merges made; no identifier is emitted.

Words repeat, so each Python worker keeps counts of the chunks (runs without
white space) it has met.  The cache has a fixed number of entries and is
emptied when full, so memory does not grow with the corpus.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows with
null or repeated ids each give a row; an empty table gives an empty table;
other columns of the input are kept only when named in ``keep``.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush
from typing import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.alphabet import DIGITS, LETTERS, common
from tabulon.llm.common import no_clash, small_batches

#: entries of a worker's chunk cache
CACHE_ENTRIES = 400_000


class MergeTable:
    """The merge ranks of a vocabulary file, by pairs of symbol numbers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.number = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.rank[self.number[a], self.number[b]] = (r, self.number[a + b])
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.byte_symbol = byte_symbols()

    def initial(self, word: str) -> list[int]:
        symbols = [self.byte_symbol[b] for b in word.encode("utf-8")]
        if symbols:
            symbols[-1] += self.suffix
        return [self.number[s] for s in symbols]

    def count(self, word: str) -> int:
        """Tokens of one word: initial symbols minus merges."""
        sym = self.initial(word)
        n = len(sym)
        if n < 2:
            return n
        rank = self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            m = rank.get((sym[i], sym[i + 1]))
            if m is not None:
                heap.append((m[0], i, m[1], sym[i], sym[i + 1]))
        heapify(heap)
        merges = 0
        while heap:
            _, i, new, a, b = heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue                      # a neighbour has changed since the push
            sym[i], sym[j] = new, -1
            k = right[i] = right[j]
            merges += 1
            if k < n:
                left[k] = i
                m = rank.get((new, sym[k]))
                if m is not None:
                    heappush(heap, (m[0], i, m[1], new, sym[k]))
            h = left[i]
            if h >= 0:
                m = rank.get((sym[h], new))
                if m is not None:
                    heappush(heap, (m[0], h, m[1], sym[h], new))
        return n - merges


def byte_symbols() -> list[str]:
    """Byte-level vocabularies write printable bytes as themselves and the
    others as the code points from 256 on, in byte order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class TextCounter(dict):
    """Counts of whole texts; the dict itself is the bounded chunk cache."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.path, self.entries = path, entries
        self.table = MergeTable(path)
        self.words: dict[str, int] = {}
        self.special = re.compile("|".join(map(re.escape, self.table.specials)) or r"(?!)")
        # the vocabulary's own splitting rule, on the common alphabet
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+").findall
        self.library = None

    def word(self, w: str) -> int:
        n = self.words.get(w)
        if n is None:
            if len(self.words) >= self.entries:
                self.words.clear()
            n = self.table.count(w)
            if len(w) <= 64:
                self.words[w] = n
        return n

    def __missing__(self, chunk: str) -> int:
        n = sum(map(self.word, self.split(chunk)))
        if len(chunk) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[chunk] = n
        return n

    def _uncommon(self, text: str) -> int:
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.path)
        t = self.library.normalizer.normalize_str(text)
        # the splitter has already written bytes as symbols: undo that to count by our own table
        back = {s: b for b, s in enumerate(self.table.byte_symbol)}
        return sum(self.word_bytes([back[c] for c in piece])
                   for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(t))

    def word_bytes(self, raw: Sequence[int]) -> int:
        return self.word(bytes(raw).decode("utf-8", "surrogateescape"))

    def plain(self, text: str) -> int:
        if common(text):
            return sum(map(self.__getitem__, text.lower().split()))
        return self._uncommon(text)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)      # special strings are one token each
        return len(parts) - 1 + sum(map(self.plain, parts))


_COUNTERS: dict[str, TextCounter] = {}


def counter(path: str) -> TextCounter:
    """One counter for each worker process and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TextCounter(path)
    return _COUNTERS[path]


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", keep: Sequence[str] = (),
                 limit: int = 2048) -> DataFrame:
    """``keep`` columns plus n_bytes, n_tokens and over_limit for every row.

    ``vocabulary`` is the path of a byte-level BPE file on every executor."""
    import pyarrow as pa

    no_clash(keep, "n_bytes", "n_tokens", "over_limit", "_text")
    small_batches(df.sparkSession)
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    out = src.select(*[F.col(f"`{c}`") for c in keep]).schema.add("n_bytes", "long", False).add("n_tokens", "long", False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc
        c = counter(vocabulary)
        for b in batches:
            t = b.column(len(keep))
            size = pc.fill_null(pc.binary_length(t), 0).cast(pa.int64())
            n = pa.array([c.count(x.as_py()) for x in t], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], size, n],
                                             names=[*b.schema.names[:len(keep)], "n_bytes", "n_tokens"])

    return src.mapInArrow(run, out).withColumn("over_limit", F.col("n_tokens") > limit)
