"""Language-model scores of documents by stupid backoff over word bigrams.

    S(w | v) = c'(v w) / c(v)        if v w occurs in some other document
             = alpha * c(w) / N      otherwise

``c`` counts all documents, ``c'`` leaves out the scored document's own
occurrences; ``v`` of the first word is the document start (``c`` = documents).
A document's score is the sum of ``ln S`` over its words.

The computation is relational, on packed rows.  Words are hashed; a row holds,
for one block of documents and one hash partition, the sorted keys with their
documents and counts as bytes, because the n-grams of a corpus are many times
its size when each is a row of its own.

1. Unigrams, packed per (block, hash partition of the word), are summed to one
   row per partition.  Words that hold at least 1 / (4 P) of all tokens, so at most
   ``4 P`` words for ``P`` partitions, are *hot*; they alone are broadcast.
2. Bigrams go to the partition of their first word, those of a hot first word
   to the partition of the whole bigram, so no word fills a partition.  A
   partition holds all counts of its bigrams and of its cold first words.  It
   adds up ``ln S`` per document, and asks for ``c(w)`` where it must back off.
3. These requests meet the unigram table in the partition of the word.
4. The sums of a block's documents are added and unpacked to rows.

``P`` follows from the bytes of the corpus, so a partition has the same size at
every scale and nothing but the hot words reaches the driver.

Words are those of ``near_copies.word_sequence``.  Defined results: a null or
empty text has 0 words, log score 0 and a null mean; null and repeated ids
give a row each, and a repeated row counts as another document; an empty table
gives an empty table.  ``docs`` must be a table that reads alike every time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import settled, small_batches
from tabulon.llm.near_copies import word_sequence


@dataclass(frozen=True)
class BackoffConfig:
    alpha: float = 0.4
    block_docs: int = 4096             # documents of one packed block, at most
    block_words: int = 1_500_000       # words of one packed block, about
    partition_bytes: int = 12_000_000  # text bytes behind one hash partition


#: Stored bytes of a word's hash.  Its partition comes from the 24 bits above
#: them, so a word's name (both together) grows with the corpus to 64 bits.
KEY_BYTES = 5
_START = 0
_ROW = "part long, kind string, block long, a binary, b binary, c binary, d binary, e binary"


def _row_batch(rows: list[dict]):
    import pyarrow as pa
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(
        [("part", pa.int64()), ("kind", pa.string()), ("block", pa.int64()), *[(x, pa.binary()) for x in "abcde"]]))


def _pack(keys, width: int) -> bytes:
    """The low ``width`` bytes of each 64-bit key."""
    import numpy as np
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(raw: bytes, width: int):
    import numpy as np
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _part(keys, n: int):
    """Hash partition, from the bits above the stored ones."""
    import numpy as np
    return ((keys >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _pair(v, w):
    import numpy as np
    with np.errstate(over="ignore"):
        x = (v * np.uint64(0x9E3779B97F4A7C15)) ^ w
        return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _blocks(batches: Iterable, cfg: BackoffConfig):
    """(block id, ids, word hashes of each document); ids follow the task's rows."""
    import numpy as np
    from pyspark import TaskContext
    from xxhash import xxh3_64_intdigest
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
    n, words, ids, docs = 0, 0, [], []
    for b in batches:
        for i, x in zip(b.column(0).to_pylist(), b.column(1)):
            seq = word_sequence(x.as_py() or "")
            h = np.fromiter(map(xxh3_64_intdigest, seq), np.uint64, len(seq))
            h[h == _START] = 1
            ids.append(i)
            docs.append(h)
            words += len(h)
            if len(ids) >= cfg.block_docs or words >= cfg.block_words:
                yield first + n, ids, docs
                n, words, ids, docs = n + 1, 0, [], []
    if ids:
        yield first + n, ids, docs


def _ranges(parts):
    """(partition, begin, end) of equal runs in a sorted array."""
    import numpy as np
    cut = np.flatnonzero(np.diff(parts)) + 1
    for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(parts)]):
        if z > a:
            yield int(parts[a]), a, z


def _unigram_rows(cfg: BackoffConfig, n_parts: int):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        for block, _, docs in _blocks(batches, cfg):
            keys, count = np.unique(np.concatenate(docs), return_counts=True)
            part = _part(keys, n_parts)
            o = np.lexsort((keys, part))
            keys, count, part = keys[o], count[o].astype("<u4"), part[o]
            yield _row_batch([{"part": p, "kind": "count", "block": block, "a": _pack(keys[s:e], KEY_BYTES), "b": count[s:e].tobytes()}
                              for p, s, e in _ranges(part)])
    return run


def _summed(t, width: int):
    """Distinct keys and total counts of packed unigram rows."""
    import numpy as np
    keys = np.concatenate([_unpack(x, width) for x in t.column("a").to_pylist()] or [np.empty(0, np.uint64)])
    count = np.concatenate([np.frombuffer(x, "<u4") for x in t.column("b").to_pylist()] or [np.empty(0, "<u4")])
    u, inv = np.unique(keys, return_inverse=True)
    return u, np.bincount(inv, count, len(u)).astype(np.int64)


def _reduced(t):
    """All packed unigram rows of a partition as one row."""
    import pyarrow as pa
    u, n = _summed(t, KEY_BYTES)
    return pa.Table.from_batches([_row_batch([{"part": t.column("part")[0].as_py(), "kind": "total", "block": -1,
                                               "a": _pack(u, KEY_BYTES), "b": n.astype("<i8").tobytes()}])])


def _totals(batches: Iterable) -> Iterator:
    """Per partition: its tokens, and the words that may be hot (at most 8)."""
    import numpy as np
    import pyarrow as pa
    for batch in batches:
        for r in batch.to_pylist():
            u, n = _unpack(r["a"], KEY_BYTES), np.frombuffer(r["b"], "<i8")
            top = np.argsort(-n, kind="stable")[:8]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"]] * (1 + len(top)), pa.int64()), pa.array([-1, *u[top].astype(np.int64).tolist()], pa.int64()),
                 pa.array([int(n.sum()), *n[top].tolist()], pa.int64())], names=["part", "key", "n"])


def _bigram_rows(cfg: BackoffConfig, n_parts: int, hot):
    """Packed bigrams: a = first words, b = bigrams of each, c = second words,
    d = documents of each bigram, e = (document, count) entries."""
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        hot_keys = np.array(sorted(hot.value), np.uint64)
        mask = np.uint64(2 ** (8 * KEY_BYTES) - 1)
        for block, ids, docs in _blocks(batches, cfg):
            size = np.array([len(h) for h in docs])
            yield _row_batch([{"part": n_parts + block % n_parts, "kind": "docs", "block": block,
                               "a": np.array([0 if i is None else i for i in ids], "<i8").tobytes(),
                               "b": np.array([i is None for i in ids], np.uint8).tobytes(), "c": size.astype("<i8").tobytes()}])
            start = np.array([_START], np.uint64)
            # the end of a document is a second word (start) that only counts
            v = np.concatenate([np.concatenate([start, h]) for h in docs])
            w = np.concatenate([np.concatenate([h, start]) for h in docs])
            doc = np.repeat(np.arange(len(docs)), size + 1)
            v_name = (v & mask) * np.uint64(n_parts) + _part(v, n_parts).astype(np.uint64)
            part = np.where(np.isin(v_name, hot_keys), _part(_pair(v, w), n_parts), _part(v, n_parts))
            o = np.lexsort((doc, w, v, part))
            v, w, doc, part = v[o], w[o], doc[o], part[o]
            # entries of one (first, second, document)
            same_v = np.r_[False, (v[1:] == v[:-1]) & (part[1:] == part[:-1])]
            same_w = same_v & np.r_[False, w[1:] == w[:-1]]
            entry = np.flatnonzero(~(same_w & np.r_[False, doc[1:] == doc[:-1]]))
            count = np.diff(np.r_[entry, len(v)])
            v, w, doc, part, new_v, new_w = v[entry], w[entry], doc[entry], part[entry], ~same_v[entry], ~same_w[entry]
            for p, s, e in _ranges(part):
                nv, nw = np.flatnonzero(new_v[s:e]), np.flatnonzero(new_w[s:e])
                first = v[s:e][nv]
                yield _row_batch([{
                    "part": p, "kind": "pairs", "block": block,
                    # a hot word's own partition is not this one: it is stored with it
                    "a": _pack(first, KEY_BYTES) + _part(first, n_parts).astype(_part_type(n_parts)).tobytes(),
                    "b": np.diff(np.r_[np.searchsorted(nw, nv), len(nw)]).astype("<u4").tobytes(),
                    "c": _pack(w[s:e][nw], KEY_BYTES) + _part(w[s:e][nw], n_parts).astype(_part_type(n_parts)).tobytes(),
                    "d": np.diff(np.r_[nw, e - s]).astype("<u4").tobytes(),
                    "e": doc[s:e].astype("<u2").tobytes() + count[s:e].astype("<u4").tobytes()}])
    return run


def _part_type(n_parts: int) -> str:
    return "<u1" if n_parts <= 2**8 else "<u2" if n_parts <= 2**16 else "<u4"


def _names(raw: bytes, n_parts: int):
    """Whole names (key times partitions plus partition) of packed words."""
    import numpy as np
    kind = np.dtype(_part_type(n_parts))
    n = len(raw) // (KEY_BYTES + kind.itemsize)
    return _unpack(raw[:n * KEY_BYTES], KEY_BYTES) * np.uint64(n_parts) + np.frombuffer(raw[n * KEY_BYTES:], kind).astype(np.uint64)


def _add_sums(rows: list, block_of, doc, value, n_parts: int) -> None:
    """Sums per document, one packed row per block."""
    import numpy as np
    o = np.lexsort((doc, block_of))
    block_of, doc, value = block_of[o], doc[o], value[o]
    for block, s, e in _ranges(block_of):
        d, inv = np.unique(doc[s:e], return_inverse=True)
        rows.append({"part": n_parts + block % n_parts, "kind": "sums", "block": block, "a": d.astype("<u2").tobytes(),
                     "b": np.bincount(inv, value[s:e], len(d)).astype("<f8").tobytes()})


def _score_pairs(cfg: BackoffConfig, n_parts: int, hot, tokens: int):
    def run(t):
        import numpy as np
        import pyarrow as pa
        if t.column("part")[0].as_py() >= n_parts:
            return t                                             # document rows pass
        v, w, doc, count, block = [], [], [], [], []
        for r in t.to_pylist():
            n = len(r["e"]) // 6
            per_v, per_w = np.frombuffer(r["b"], "<u4"), np.frombuffer(r["d"], "<u4")
            v.append(np.repeat(np.repeat(_names(r["a"], n_parts), per_v), per_w))
            w.append(np.repeat(_names(r["c"], n_parts), per_w))
            doc.append(np.frombuffer(r["e"][:2 * n], "<u2"))
            count.append(np.frombuffer(r["e"][2 * n:], "<u4"))
            block.append(np.full(n, r["block"], np.int64))
        v, w, doc, count, block = (np.concatenate(x) for x in (v, w, doc, count, block))
        o = np.lexsort((w, v))
        v, w, doc, count, block = v[o], w[o], doc[o].astype(np.int64), count[o].astype(np.int64), block[o]
        new_v = np.r_[True, v[1:] != v[:-1]]
        new_w = new_v | np.r_[True, w[1:] != w[:-1]]
        id_w, id_v = np.cumsum(new_w) - 1, np.cumsum(new_v) - 1
        pairs = np.bincount(id_w, count)[id_w]
        firsts = np.bincount(id_v, count)
        names = v[new_v]
        table = hot.value
        for i in np.flatnonzero(np.isin(names, np.array(list(table), np.uint64))).tolist():
            firsts[i] = table[int(names[i])]
        scored = w != np.uint64(_START)
        seen = scored & (pairs > count)
        rows: list = []
        sums = [(block[seen], doc[seen], count[seen] * np.log((pairs[seen] - count[seen]) / firsts[id_v][seen]))]
        off = scored & ~seen
        w, doc, count, block = w[off], doc[off], count[off], block[off]
        known = np.isin(w, np.array(list(table), np.uint64))
        if known.any():
            c = np.array([table[int(x)] for x in w[known]], np.float64)
            sums.append((block[known], doc[known], count[known] * np.log(cfg.alpha * c / tokens)))
        _add_sums(rows, *(np.concatenate(x) for x in zip(*sums)), n_parts)
        w, doc, count, block = w[~known], doc[~known], count[~known], block[~known]
        part = (w % np.uint64(n_parts)).astype(np.int64)
        o = np.lexsort((w, block, part))
        w, doc, count, block, part = w[o], doc[o], count[o], block[o], part[o]
        for p, s, e in _ranges(part):
            for b, x, y in _ranges(block[s:e]):
                x, y = s + x, s + y
                rows.append({"part": p, "kind": "ask", "block": b, "a": _pack(w[x:y] // np.uint64(n_parts), KEY_BYTES),
                             "b": doc[x:y].astype("<u2").tobytes(), "c": count[x:y].astype("<u4").tobytes()})
        return pa.Table.from_batches([_row_batch(rows)])
    return run


def _score_words(cfg: BackoffConfig, n_parts: int, tokens: int):
    def run(t):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        rows: list = []
        if t.column("part")[0].as_py() >= n_parts:
            # a block's rows meet here: its sums become one row
            own = t.filter(pc.equal(t.column("kind"), "docs"))
            by_block: dict[int, list] = {}
            for r in t.filter(pc.equal(t.column("kind"), "sums")).to_pylist():
                by_block.setdefault(r["block"], []).append((r["a"], r["b"]))
            for block, parts in by_block.items():
                parts.sort()                                     # the same order in every run
                doc = np.concatenate([np.frombuffer(a, "<u2") for a, _ in parts]).astype(np.int64)
                value = np.concatenate([np.frombuffer(b, "<f8") for _, b in parts])
                _add_sums(rows, np.full(len(doc), block), doc, value, n_parts)
            return pa.concat_tables([own, pa.Table.from_batches([_row_batch(rows)]).cast(own.schema)])
        asks = t.filter(pc.equal(t.column("kind"), "ask")).to_pylist()
        if asks:
            total = t.filter(pc.equal(t.column("kind"), "total")).to_pylist()[0]
            keys, n = _unpack(total["a"], KEY_BYTES), np.frombuffer(total["b"], "<i8")
            w = np.concatenate([_unpack(r["a"], KEY_BYTES) for r in asks])
            doc = np.concatenate([np.frombuffer(r["b"], "<u2") for r in asks]).astype(np.int64)
            count = np.concatenate([np.frombuffer(r["c"], "<u4") for r in asks])
            block = np.repeat(np.array([r["block"] for r in asks]), [len(r["b"]) // 2 for r in asks])
            _add_sums(rows, block, doc, count * np.log(cfg.alpha * n[np.searchsorted(keys, w)] / tokens), n_parts)
        return pa.Table.from_batches([_row_batch(rows)])
    return run


def _unpacked(t):
    """Rows (id, n_words, log_score) of one block."""
    import numpy as np
    import pyarrow as pa
    rows = t.to_pylist()
    head = next(r for r in rows if r["kind"] == "docs")
    ids, none = np.frombuffer(head["a"], "<i8"), np.frombuffer(head["b"], np.uint8).astype(bool)
    score = np.zeros(len(ids))
    for r in sorted((r for r in rows if r["kind"] == "sums"), key=lambda r: (r["a"], r["b"])):
        score[np.frombuffer(r["a"], "<u2")] += np.frombuffer(r["b"], "<f8")
    return pa.table({"id": pa.array(ids, pa.int64(), mask=none), "n_words": np.frombuffer(head["c"], "<i8"), "log_score": score})


def backoff_scores(docs: DataFrame, cfg: BackoffConfig = BackoffConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, log_score and mean_log_score (per word) for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    size, n_docs = src.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n_parts = max(1, math.ceil((size or 0) / cfg.partition_bytes))
    if n_parts >= 2**23:
        raise ValueError("more partitions than word names can hold: raise partition_bytes")
    uni = settled(src.mapInArrow(_unigram_rows(cfg, n_parts), _ROW).groupBy("part").applyInArrow(_reduced, _ROW))
    top = settled(uni.mapInArrow(_totals, "part long, key long, n long"))     # at most 9 rows a partition
    tokens = top.where("key = -1").agg(F.sum("n")).first()[0] or 1
    hot_rows = top.where("key <> -1").where(F.col("n") >= tokens / (4.0 * n_parts)).collect()
    # at most 4 P words, and the document start, whose name is 0 in any partitioning
    hot = spark.sparkContext.broadcast({int(r["key"]) * n_parts + r["part"]: r["n"] for r in hot_rows} | {_START: n_docs})
    pairs = src.mapInArrow(_bigram_rows(cfg, n_parts, hot), _ROW)
    asked = pairs.groupBy("part").applyInArrow(_score_pairs(cfg, n_parts, hot, tokens), _ROW)
    sums = asked.unionByName(uni).groupBy("part").applyInArrow(_score_words(cfg, n_parts, tokens), _ROW)
    out = sums.groupBy("block").applyInArrow(_unpacked, "id long, n_words long, log_score double")
    return out.select(F.col("id").alias(id_col), "n_words", "log_score",
                      F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
