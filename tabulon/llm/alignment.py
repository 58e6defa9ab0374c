"""Alignment of two tokenizations of every document by interval coalescing.

Tokens of both tokenizers are byte ranges of the same bytes (a space and the
text).  All ranges of a batch of documents are sorted by start (``lexsort``) and
their ends accumulated (``maximum.accumulate``): a group begins where a start
reaches the running maximum, that is where an A token and a B token end
together.  Inside a group every A token meets the B tokens it overlaps; the
pairs asked for (``end``, ``same`` or ``overlap``) are the links.

Counts of id pairs over the corpus reach the documents without a row per
document and pair.  Documents are settled in *blocks* of bounded size; a block
asks once for each distinct pair it holds.  The requests are summed by pair,
joined with the sums and grouped by block, where NumPy adds them up by document.
A pair has one request per block, however frequent it is, and requests of a pair
in very many blocks are split by the skew join.

Defined results: null and empty texts, and texts whose joined A or B bytes are
not the space and the text (a tokenizer that normalises), have no tokens: zeros
and no groups.  Special strings inside texts are plain text.  Rows with null or
repeated ids are documents of their own; ties among a B id's most frequent pairs
all count as best; an empty table gives an empty table; columns other than
``keep`` are not read, and ``keep`` may not name an added column.  A very long
text is aligned in slices that end where both tokens end, so only its token
numbers are held whole.
"""

from __future__ import annotations

import hashlib
from typing import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.alphabet import common
from tabulon.llm.common import no_clash, settled, small_batches
from tabulon.llm.packing import CACHE_ENTRIES, Remembered, TextIds
from tabulon.llm.token_counts import byte_symbols

#: tokens of both sides that are aligned at once
SLICE_TOKENS = 400_000
#: links of the documents of one block (a longer document is a block by itself)
BLOCK_LINKS = 2_000_000

LINKS = ("end", "same", "overlap")


class PieceIds:
    """Ids of a sentencepiece model, as ``TextIds`` gives those of a byte-level one.

    A piece holds the word mark at its start only, so texts of the common
    alphabet with single spaces are encoded word by word, from a bounded cache;
    other texts go to the library whole."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(pieces)]
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.word = Remembered(self.whole, entries)

    def whole(self, text: str) -> bytes:
        return TextIds.as_bytes(self.library.encode(text, num_threads=1))

    def ids(self, text: str) -> bytes:
        if not self.by_word or "  " in text or text[0] == " " or text[-1] == " " or not common(text):
            return self.whole(text)
        return b"".join(map(self.word.__getitem__, text.split(" ")))


class TwoTokenizers:
    def __init__(self, byte_path: str, piece_path: str):
        import numpy as np
        self.a, self.b = TextIds(byte_path), PieceIds(piece_path)
        self.a.library.encode_special_tokens = True
        back = {s: b for b, s in enumerate(byte_symbols())}
        vocab = self.a.library.get_vocab(with_added_tokens=True)
        self.n_a, self.n_b = max(vocab.values()) + 1, len(self.b.bytes)
        self.bytes_a = [b""] * self.n_a
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.b.bytes))
        # decimal ids after each separator: a new group, a token of the same side, the other side
        self.shown = [f"{mark}{i}" for mark in ";,|" for i in range(max(self.n_a, self.n_b))]

    def encode(self, text: str | None):
        """Ids of both sides, or None where a side does not give the bytes back."""
        import numpy as np
        if not text:
            return None
        raw = (" " + text).encode("utf-8", "surrogatepass")
        a, b = np.frombuffer(self.a.ids(" " + text), "<u4"), np.frombuffer(self.b.ids(text), "<u4")
        if self.size_a[a].sum() != len(raw) or self.size_b[b].sum() != len(raw):
            return None
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.b.bytes.__getitem__, b.tolist())) != raw:
            return None
        return a, b


_BOTH: dict[tuple[str, str], TwoTokenizers] = {}


def both(byte_path: str, piece_path: str) -> TwoTokenizers:
    if (byte_path, piece_path) not in _BOTH:
        _BOTH[byte_path, piece_path] = TwoTokenizers(byte_path, piece_path)
    return _BOTH[byte_path, piece_path]


def coalesce(start_a, end_a, start_b, end_b):
    """Group numbers of A and of B tokens, in order, and all overlapping pairs."""
    import numpy as np
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    side = np.repeat([0, 1], [len(start_a), len(start_b)])
    order = np.lexsort((side, start))
    top = np.maximum.accumulate(end[order])
    fresh = np.r_[True, start[order][1:] >= top[:-1]] if len(order) else np.empty(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    first, stop = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    n = stop - first
    i = np.repeat(np.arange(len(start_a)), n)
    j = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    return group[:len(start_a)], group[len(start_a):], i, j


def _wanted(links: str, start_a, end_a, start_b, end_b, i, j):
    if links == "overlap":
        return i, j
    hit = end_a[i] == end_b[j]
    if links == "same":
        hit &= start_a[i] == start_b[j]
    return i[hit], j[hit]


def _slices(two: TwoTokenizers, docs: list, most: int = SLICE_TOKENS):
    """Lists of (document number, a ids, b ids, last part) of bounded size; a long
    document is cut where an A and a B token end together."""
    import numpy as np
    out, held = [], 0
    for d, (a, b) in docs:
        if out and held + len(a) + len(b) > most:
            yield out
            out, held = [], 0
        if len(a) + len(b) <= most:
            out.append((d, a, b, True))
            held += len(a) + len(b)
            continue
        end_a, end_b = np.cumsum(two.size_a[a]), np.cumsum(two.size_b[b])
        _, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        x = y = k = 0
        while x < len(a):
            k = max(k + 1, int(np.searchsorted(at_a + at_b, x + y + most, "right")) - 1)
            k = min(k, len(at_a) - 1)
            nx, ny = int(at_a[k]) + 1, int(at_b[k]) + 1
            yield [(d, a[x:nx], b[y:ny], nx == len(a))]
            x, y = nx, ny
    if out:
        yield out


def _align_batch(two: TwoTokenizers, docs: list, links: str, n_docs: int, digest: bool):
    """Per document: n_a, n_b, n_groups, n_links, groups and packed links."""
    import numpy as np
    n_groups, n_links = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    n_a, n_b = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    shown, packed, running = [""] * n_docs, [b""] * n_docs, {}
    kind = "<u4" if two.n_a * two.n_b <= 2**32 else "<u8"
    v = max(two.n_a, two.n_b)
    for part in _slices(two, docs):
        count_a, count_b = (np.array([len(p[k]) for p in part]) for k in (1, 2))
        a, b = (np.concatenate([p[k] for p in part]).astype(np.int64) for k in (1, 2))
        end_a, end_b = np.cumsum(two.size_a[a]), np.cumsum(two.size_b[b])       # documents lie one behind the other
        start_a, start_b = end_a - two.size_a[a], end_b - two.size_b[b]
        group_a, group_b, i, j = coalesce(start_a, end_a, start_b, end_b)
        i, j = _wanted(links, start_a, end_a, start_b, end_b, i, j)
        pair = (a[i] * two.n_b + b[j]).astype(kind)
        doc_a = np.repeat(np.arange(len(part)), count_a)
        key = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate([a, b])[order]
        step = np.r_[2, np.diff(key)]
        mark = np.where(step == 0, 1, np.where((step == 1) & (key % 2 == 1), 2, 0))
        text = list(map(two.shown.__getitem__, (mark * v + ids).tolist()))
        groups = np.bincount(doc_a[np.flatnonzero(np.r_[True, np.diff(group_a) > 0])], minlength=len(part))
        of_doc = np.bincount(doc_a[i], minlength=len(part))
        tokens, at = np.r_[0, np.cumsum(count_a + count_b)], np.r_[0, np.cumsum(of_doc)]
        for k, (d, x, y, last) in enumerate(part):
            n_a[d] += len(x)
            n_b[d] += len(y)
            n_groups[d] += groups[k]
            n_links[d] += of_doc[k]
            got = "".join(text[tokens[k]:tokens[k + 1]])
            if d not in running:
                running[d] = ([], hashlib.sha256(), [])
                got = got[1:]
            strings, sha, lists = running[d]
            if digest:
                sha.update(got.encode())
            else:
                strings.append(got)
            lists.append(pair[at[k]:at[k + 1]].tobytes())
            if last:
                shown[d], packed[d] = sha.hexdigest() if digest else "".join(strings), b"".join(lists)
                del running[d]
    return n_a, n_b, n_groups, n_links, shown, packed


def align(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: Sequence[str] = (),
          links: str = "end", digest: bool = False) -> DataFrame:
    """``keep`` columns, block, n_a, n_b, n_groups, n_links, groups and links of every row.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in decimal ids, or its SHA-256 with
    ``digest``; ``links`` packs ``a * (size of B's vocabulary) + b`` of the linked
    tokens in order.  Both files lie at the same path on every executor."""
    import pyarrow as pa

    if links not in LINKS:
        raise ValueError(f"links: one of {LINKS}")
    no_clash(keep, "block", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "_text")
    small_batches(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    out = src.select(*[F.col(f"`{c}`") for c in keep]).schema
    for c in ("block", "n_a", "n_b", "n_groups", "n_links"):
        out = out.add(c, "long")
    out = out.add("groups", "string").add("links", "binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        two = both(byte_path, piece_path)
        block, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            texts = b.column(len(keep))
            got = [(d, ids) for d, x in enumerate(texts) if (ids := two.encode(x.as_py())) is not None]
            n_a, n_b, n_groups, n_links, shown, packed = _align_batch(two, got, links, len(texts), digest)
            blocks = np.empty(len(texts), np.int64)
            for d, n in enumerate(n_links.tolist()):
                if held and held + n > BLOCK_LINKS:
                    block, held = block + 1, 0
                blocks[d], held = block, held + n
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], *(pa.array(x, pa.int64()) for x in (blocks, n_a, n_b, n_groups, n_links)),
                 pa.array(shown, pa.string()), pa.array(packed, pa.binary())],
                names=[*b.schema.names[:len(keep)], "block", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return src.mapInArrow(run, out)


def _requests(kind: str):
    """(block, pair, k) of rows of whole blocks: each distinct pair once."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def counted(block, parts):
            pair, k = np.unique(np.frombuffer(b"".join(parts), kind), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block, np.int64)), pa.array(pair.astype(np.int64)),
                                               pa.array(k.astype(np.int64))], names=["block", "pair", "k"])
        now, parts = None, []
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if block != now and parts:
                    yield counted(now, parts)
                    parts = []
                now = block
                parts.append(raw.as_py())
        if parts:
            yield counted(now, parts)
    return run


def _answered(kind: str, keep: int):
    """Documents of a block with the sums over their links."""
    def run(docs, answers):
        import numpy as np
        import pyarrow as pa
        pair, n, top = (answers.column(c).to_numpy() for c in ("pair", "n", "top"))
        order = np.argsort(pair)
        pair, n, top = pair[order], n[order], top[order]
        raw = docs.column("links").to_pylist()
        have = np.frombuffer(b"".join(raw), kind).astype(np.int64)
        at = np.r_[0, np.cumsum([len(x) // np.dtype(kind).itemsize for x in raw])]
        where = np.searchsorted(pair, have)
        assert len(have) == 0 or np.array_equal(pair[where], have), "a pair of the block has no answer"
        sums = [np.r_[0, np.cumsum(x[where].astype(np.int64))] for x in (n, top)]
        total, best = (s[at[1:]] - s[at[:-1]] for s in sums)
        out = docs.drop_columns(["block", "links"])
        return out.append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))
    return run


def alignment_counts(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: Sequence[str] = ("doc_id",),
                     links: str = "end", digest: bool = True) -> DataFrame:
    """``keep`` columns, n_a, n_b, n_groups, n_links, groups, n_best (links whose
    pair is the most frequent of its B id in the corpus, ties included) and
    count_sum (corpus counts of the pairs, summed over the links)."""
    two = both(byte_path, piece_path)
    kind = "<u4" if two.n_a * two.n_b <= 2**32 else "<u8"
    rows = settled(align(docs, byte_path, piece_path, text, keep, links, digest))
    asked = rows.where("n_links > 0").select("block", "links").mapInArrow(_requests(kind), "block long, pair long, k long")
    asked = settled(asked)
    counts = settled(asked.groupBy("pair").agg(F.sum("k").alias("n")))
    b_id = F.col("pair") % F.lit(two.n_b)
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))       # a row per id of B's vocabulary at most
    marked = counts.join(F.broadcast(highest), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("top"))
    answers = asked.select("block", "pair").join(marked, "pair").select("block", "pair", "n", "top")
    linked = rows.where("n_links > 0")
    schema = rows.drop("block", "links").schema.add("n_best", "long").add("count_sum", "long")
    done = linked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answered(kind, len(keep)), schema)
    none = rows.where("n_links = 0").drop("block", "links").withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    return done.unionByName(none)
