"""The pipeline's stages, one after the other, against plain Python on a small corpus."""

import collections
import math
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tabulon.llm.mixing import MixConfig
from tabulon.llm.toxicity import fit_toxicity
from tests_llm_brute import near_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(12)
    good, poor = [f"good{i}" for i in range(60)], [f"poor{i}" for i in range(60)]
    rows, quality, toxic = [], {}, {}
    for i in range(360):
        kind = i % 10
        words = [r.choice((good if kind < 7 else poor) if r.random() < 0.6 else [f"any{k}" for k in range(80)]) for _ in range(r.randrange(30, 120))]
        if kind == 3:
            for _ in range(5):
                words.insert(r.randrange(len(words)), r.choice(["slurra", "vilezz", "insultum"]))
        rows.append((i, " ".join(words)))
        quality[i], toxic[i] = int(kind < 7), int(kind == 3)
    copies = [(1000 + k, rows[k * 10][1]) for k in range(12)]                                # exact
    copies += [(1100 + k, rows[k * 10 + 1][1] + " tail") for k in range(12)]                 # near
    rows += copies + [(2000, None), (2001, ""), (2002, "poor1 poor2 " * 900), (None, "an id is missing here today"), (5, rows[5][1])]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], quality, toxic


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """The rows after each stage."""
    rows, quality, toxic = corpus
    sf = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(i, quality[i], toxic[i]) for i in quality], "doc_id long, quality int, toxic int").write.parquet(sf + "/labels.parquet")
    out = [("documents", docs)]
    for name, stage in P.STAGES:
        stage(spark, out[-1][1], sf).write.parquet(f"{sf}/{name}")
        out.append((name, spark.read.parquet(f"{sf}/{name}")))
    return sf, out


def plain(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=str)


def test_toxic_documents_go(spark, corpus, stages):
    sf, out = stages
    docs, left = out[0][1], out[1][1]
    model = fit_toxicity(docs, spark.read.parquet(sf + "/labels.parquet"))

    def verdict(text):                                   # the score by its definition: every segment by brute force
        words = (text or "").lower().split()
        s = [max((model.units[u][0] for w in [c] for u in ["=" + w, *(w[:n] for n in (4, 5, 6) if len(w) > n)] if u in model.units),
                 key=lambda d: d, default=model.config.background) for c in words]
        return s
    kept = {i for i, _ in plain(left)}
    toxic = {i for i, t in corpus[2].items() if t}
    assert len(toxic & kept) <= 0.05 * len(toxic) and {i for i, *_ in corpus[0]} - toxic - kept - {None} == set()
    hot = {i for i, t, *_ in corpus[0] if max(verdict(t), default=-1) > 0}
    assert {i for i, *_ in corpus[0]} - kept <= hot       # nothing goes without a lexicon unit
    assert left.columns == docs.columns


def test_one_of_each_group_of_near_copies_stays(stages):
    _, out = stages
    before, after = plain(out[1][1]), plain(out[2][1])
    assert after == sorted(near_groups(before, 5, 80), key=str)


def test_copies_follow_the_rates(spark, stages):
    from tabulon.llm.mixing import mix_documents
    from tabulon.llm.queries import label_domains
    sf, out = stages
    before, after = out[2][1], collections.Counter(plain(out[3][1]))
    mixed = {r.doc_id: r for r in mix_documents(before, label_domains(spark.read.parquet(sf + "/labels.parquet")), P.TARGETS).collect()}
    for (i, t), n in collections.Counter(plain(before)).items():
        assert after[i, t] == n * mixed[i].copies
    total = sum(r.n_tokens for r in mixed.values())
    for d, share in P.TARGETS.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in mixed.values()) == pytest.approx(share * total, rel=2e-3)
    # the rates are those of a dense projected gradient
    ids = sorted(mixed, key=str)
    n = np.array([mixed[i].n_tokens for i in ids], float)
    p = np.array([[mixed[i][f"p_{d}"] for d in sorted(P.TARGETS)] for i in ids])
    mass, rate = (n[:, None] * p).sum(0), np.ones(len(n))
    t = total * np.array([P.TARGETS[d] for d in sorted(P.TARGETS)])
    for _ in range(5000):
        rate = np.maximum(0, rate - p @ (((rate * n) @ p - t) / mass) - MixConfig().ridge * (rate - 1))
    got = np.array([mixed[i].rate for i in ids])
    assert math.sqrt((n * (got - rate) ** 2).sum() / n.sum()) < 0.02


def test_packed_pieces_are_the_documents(stages):
    _, out = stages
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t in plain(out[3][1]):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want[i, len(ids)] += 1
    got = out[4][1].collect()
    have = collections.Counter()
    for r in got:
        have[r.doc_id, r.doc_tokens] += r.length
    assert have == collections.Counter({k: k[1] * n for k, n in want.items()})
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    # one document whole: its ids in order
    i, t = next((i, t) for i, t in plain(out[3][1]) if t and i is not None and list(plain(out[3][1])).count((i, t)) == 1)
    ids = array("I", lib.encode(t, add_special_tokens=False).ids + [1])
    for r in got:
        if r.doc_id == i:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
