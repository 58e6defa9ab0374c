"""Operator 13 against the tokenizer libraries and the definitions."""

import functools
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tabulon.llm import alignment as AL

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [(1, "The cat sat.\nThe  dog ran, naïvely."), (2, ""), (3, None), (4, " leading and trailing "), (5, "a▁b"),
         (6, "<|endoftext|> and <s> </s> are text"), (7, "tab\tand\r\nnew"), (8, "日本語 🙂 emoji"), (None, "no id here"), (1, "again id one"),
         (9, "x"), (10, "The cat sat. The cat sat."), (11, "é" * 40), (12, " "), (13, "word " * 300 + "end")]


@functools.cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), AL.both(A, B)


def tokens(text):
    """(a ids, a ranges, b ids, b ranges) by the libraries alone, or None."""
    a, b, two = libraries()
    if not text:
        return None
    raw = (" " + text).encode()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts = [two.bytes_a[i] for i in ids[0]], [two.b.bytes[i] for i in ids[1]]
    if any(b"".join(p) != raw for p in parts):
        return None
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    return ids[0], list(zip([0] + ends[0][:-1], ends[0])), ids[1], list(zip([0] + ends[1][:-1], ends[1]))


def brute(rows, links="end"):
    per, pairs = [], Counter()
    for i, text in rows:
        t = tokens(text)
        if t is None:
            per.append((i, 0, 0, [], []))
            continue
        ia, ra, ib, rb = t
        cut = sorted({e for _, e in ra} & {e for _, e in rb})
        groups = [([x for x, (_, e) in zip(ia, ra) if lo < e <= hi], [x for x, (_, e) in zip(ib, rb) if lo < e <= hi])
                  for lo, hi in zip([0] + cut, cut)]
        hit = {"end": lambda p, q: p[1] == q[1], "same": lambda p, q: p == q, "overlap": lambda p, q: p[0] < q[1] and q[0] < p[1]}[links]
        own = [(x, y) for x, p in zip(ia, ra) for y, q in zip(ib, rb) if hit(p, q)]
        per.append((i, len(ia), len(ib), groups, own))
        pairs.update(own)
    best = defaultdict(int)
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    out = []
    for i, na, nb, groups, own in per:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, na, nb, len(groups), len(own), text, sum(pairs[p] == best[p[1]] for p in own), sum(pairs[p] for p in own)))
    return out


@pytest.mark.parametrize("links", AL.LINKS)
def test_counts_equal_brute_force(spark, links):
    df = spark.createDataFrame([(i, t, "x", i) for i, t in TEXTS], "doc_id long, text string, groups string, block long")
    got = AL.alignment_counts(df, A, B, links=links, digest=False).collect()
    key = lambda r: tuple((x is None, x or 0) if k == 0 else x for k, x in enumerate(r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(TEXTS, links), key=key)


def test_digest_on_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {r[0]: r[1:5] + (hashlib.sha256(r[5].encode()).hexdigest() if r[1] else "",) + r[6:] for r in brute(rows)}
    got = {r.doc_id: tuple(r)[1:] for r in AL.alignment_counts(docs, A, B).collect()}
    assert got == want and len(got) == len(rows)


def test_long_texts_are_cut_in_slices(monkeypatch):
    two = AL.both(A, B)
    docs = [(k, ids) for k, (_, t) in enumerate(TEXTS) if (ids := two.encode(t)) is not None]
    whole = AL._align_batch(two, docs, "overlap", len(TEXTS), False)
    monkeypatch.setattr(AL, "_slices", functools.partial(AL._slices, most=25))
    cut = AL._align_batch(two, docs, "overlap", len(TEXTS), False)
    assert all(list(x) == list(y) for x, y in zip(whole, cut))


def test_empty_table_and_clashes(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_a long")
    assert AL.alignment_counts(df, A, B).count() == 0
    with pytest.raises(ValueError):
        AL.alignment_counts(df, A, B, keep=["doc_id", "n_a"])
    with pytest.raises(ValueError):
        AL.align(df, A, B, links="any")


def test_coalesce_is_the_definition():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        ends = [np.unique(np.r_[rng.integers(1, n + 1, int(rng.integers(0, n))), n]) for _ in "ab"]
        starts = [np.r_[0, e[:-1]] for e in ends]
        ga, gb, i, j = AL.coalesce(starts[0], ends[0], starts[1], ends[1])
        cut = np.intersect1d(*ends)
        assert ga.tolist() == np.searchsorted(cut, ends[0]).tolist() and gb.tolist() == np.searchsorted(cut, ends[1]).tolist()
        want = {(x, y) for x in range(len(ends[0])) for y in range(len(ends[1])) if starts[0][x] < ends[1][y] and starts[1][y] < ends[0][x]}
        assert set(zip(i.tolist(), j.tolist())) == want
