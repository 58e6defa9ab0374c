"""Operator 11 against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulon.llm import variants as V

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, least=6, count=5, divisor=199):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if divisor and h % divisor == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= least and n >= count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words, ratio=5):
    near = {w: [] for w in words}
    keys = {}
    for w in words:
        for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            keys.setdefault(k, set()).add(w)
    for group in keys.values():
        for a in group:
            near[a] += [b for b in group if b != a and is_near(a, b)]
    form = {}
    for w, other in near.items():
        best = min(set(other), key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(set(near[w])), words[form[w]] if form[w] else None))
    return sorted(out)


def result(df, cfg=V.VariantConfig()):
    return sorted(map(tuple, V.spelling_variants(df, cfg).collect()), key=lambda r: r[0])


def rows(seed=5):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("aabcéÿ") for _ in range(rnd.randint(5, 8))) for _ in range(150)]
    vocab += [w[:i] + x + w[i + 1:] for w in vocab[:60] for i, x in [(rnd.randrange(len(w)), "b")]] + [w[:2] + w[2] + w[2:] for w in vocab[:40]]
    out = [(i, " ".join(rnd.choices(vocab, [1 / (k + 1) for k in range(len(vocab))], k=60)).replace("aa", "aA")) for i in range(60)]
    return out + [(None, "Aabcab " * 30), (3, None), (4, ""), (3, "aabcab," * 9), (7, "x" * 5000 + " " + "x" * 5001), (8, "ЖЖЖЖЖЖ 123456 a-b")] * 5


@pytest.mark.parametrize("range_words", [100_000, 9])
def test_equals_brute_force(spark, range_words):
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows()], "doc_id long, text string, word string, n long")
    cfg = V.VariantConfig(range_words=range_words)
    assert result(df, cfg) == brute(brute_words(rows()))


def test_damage_and_no_damage(spark):
    df = spark.createDataFrame(rows(9), "doc_id long, text string")
    for divisor in (0, 3):
        assert result(df, V.VariantConfig(divisor=divisor)) == brute(brute_words(rows(9), divisor=divisor))


def test_supplied_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(df, V.VariantConfig(range_words=150)) == brute(brute_words([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]))


def test_words_are_named_in_full(spark):
    df = spark.createDataFrame([(i, t) for i, t in rows()], "doc_id long, text string")
    numbered = V.trie_pairs(V.word_counts(df).checkpoint(), V.VariantConfig(range_words=20)).collect()
    ranks = [r.word for r in sorted(numbered, key=lambda r: r.rank)]
    assert ranks == sorted(ranks)
    for column, cut in (("before", lambda w, i: w[:i]), ("after", lambda w, i: w[len(w) - i:])):
        node = {}
        for r in numbered:
            for i, x in enumerate(r[column]):
                assert node.setdefault(x, cut(r.word, i)) == cut(r.word, i)
        assert len(set(node.values())) == len(node)          # one number for a string, one string for a number


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert result(df) == []
    assert result(spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))) == []
