import random

import pytest
from pyspark.sql import functions as F

from tabulon.llm.components import connected_components
from tabulon.llm.near_copies import MinHashConfig, near_copies, shingle_set


def brute(rows, words, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    flat = [(i, s) for i, v in sets.items() for s in v if i is not None and s]
    for a in range(len(flat)):
        for b in range(a):
            (i, s), (j, t) = flat[a], flat[b]
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets if i is not None}, sets


def corpus(seed=5):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    rows, n = [], 0

    def add(t):
        nonlocal n
        rows.append((n, t if t is None else " ".join(t)))
        n += 1
    for _ in range(25):                                   # groups of copies with a few changed words
        base = text(r.randrange(30, 120))
        for _ in range(r.randrange(1, 6)):
            t = list(base)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = r.choice(vocab)
            add(t)
    chain = text(100)                                     # a chain: neighbours link, the ends do not
    for k in range(8):
        add(chain[3 * k:] + text(3 * k))
    passage = text(60)                                    # a shared passage that is no copy
    for _ in range(20):
        add(passage + text(60))
    for k in range(40):                                   # one large group of near-copies
        add(base + text(1 + k % 3))
    add(None), add([]), add(["Only", "three", "words"]), add(["only", "THREE", "words"]), add(["x"]), add(text(9000))
    rows.append((n, "\t\x0b\n \r"))
    return rows


@pytest.mark.parametrize("cfg", [MinHashConfig(words=4), MinHashConfig(), MinHashConfig(words=4, block=3)])
def test_against_brute_force(spark, cfg):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("sig", F.lit("x"))
    got = {r.doc_id: r for r in near_copies(df, cfg).collect()}
    want, sets = brute(rows, cfg.words)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i][0]) and r.kept == (i == want[i]) for i, r in got.items())


def test_nulls_repeats_and_empty(spark):
    t = "one two three four five six seven"
    rows = [(7, t), (7, t), (3, t), (None, t), (None, None), (9, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_copies(df, MinHashConfig(words=4)).collect()), key=str)
    assert got == sorted([(7, 4, 3, False), (7, 4, 3, False), (3, 4, 3, True), (None, 4, None, True), (None, 0, None, True),
                          (9, 0, 9, True), (9, 0, 9, True)], key=str)
    assert near_copies(df.limit(0)).count() == 0


def test_words_are_split_at_ascii_space_only():
    assert len(shingle_set("a\u00a0b c", 1)) == 2 and len(shingle_set("A\x1cb É", 1)) == 2
    assert (shingle_set("É", 1) != shingle_set("é", 1)).any() and (shingle_set("ABC", 1) == shingle_set("abc", 1)).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(60)] + [(1000, 1001 + i) for i in range(50)]
    edges += [(None, 1), (2, None), (3, 3), (1000, 1001)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((x.node, x.component) for x in got) == sorted((i, find(i)) for i in parent)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_every_text_of_a_repeated_id_links(spark):
    """Id 1 stands for two classes, and each of its texts has a near-copy."""
    import corpus_pipeline
    words = {k: [f"{k}{i}" for i in range(60)] for k in "abc"}
    copy = lambda k, n: " ".join(words[k][:-1] + [f"end{n}"])
    rows = [(1, copy("a", 0)), (1, copy("b", 0)), (2, copy("a", 1)), (3, copy("b", 1)), (2, copy("c", 0)), (2, copy("c", 0)), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_copies(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (9, 9, True)}
    # the pipeline keeps one text of each component of texts, also the third text, of id 2
    left = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    assert left == sorted([(1, copy("a", 0)), (1, copy("b", 0)), (2, copy("c", 0)), (9, "")])
