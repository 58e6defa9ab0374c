import collections
import math
import random
import warnings
import zlib

import pytest
from pyspark.sql import functions as F

from tabulon.llm.backoff import BackoffConfig, backoff_scores
from tabulon.llm.mixing import MixConfig, apply_mix, fit_rates, mix_documents, target_report
from tabulon.llm.toxicity import ToxicityConfig, ToxicityModel, _statistic, _teachers, fit_toxicity, maximal_segments, score_toxicity


def segments_by_definition(s):
    """Ruzzo and Tompa's definition, by recursion on the best segment."""
    best, at = 0.0, None
    for a in range(len(s)):
        run = 0.0
        for b in range(a, len(s)):
            run += s[b]
            # shortest among the best
            if run > best + 1e-12 or (at and abs(run - best) <= 1e-12 and b + 1 - a < at[1] - at[0]):
                best, at = run, (a, b + 1)
    if at is None:
        return []
    a, b = at
    return segments_by_definition(s[:a]) + [(a, b, best)] + [(x + b, y + b, v) for x, y, v in segments_by_definition(s[b:])]


def test_maximal_segments_against_the_definition():
    r = random.Random(9)
    for _ in range(300):
        s = [r.choice([-3.1, -1.7, -0.9, 1.3, 2.2, 4.7]) * r.uniform(0.9, 1.1) for _ in range(r.randrange(0, 14))]
        got = maximal_segments(s)
        want = segments_by_definition(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def test_the_scan_is_linear():
    """A falling running sum, where no candidate ever merges, and a rising one."""
    import time
    for cold, segments in ((-5.0, 1_000_000), (-3.0, 1)):
        began = time.process_time()
        got = maximal_segments([4.0, cold] * 1_000_000)
        assert len(got) == segments and time.process_time() - began < 20
    assert maximal_segments([4.0, -3.0] * 5)[0][:2] == (0, 9)


def toxic_corpus(n=600, seed=4):
    r = random.Random(seed)
    clean = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        t = [r.choice(clean) for _ in range(r.randrange(20, 200))]
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            t.insert(r.randrange(len(t)), r.choice(["slur", "vile" + r.choice("abcdef") + r.choice("xyz"), "Insult!"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_is_learnt_and_held_out(spark):
    rows, labels = toxic_corpus()
    extra = [(9000, ""), (9001, None), (None, "slur slur insult"), (9002, "word1 " * 30000), (9003, "slur insult vileax vileby"), (9003, "slur insult vileax vileby")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1))
    lab = spark.createDataFrame(labels + [(1, None), (None, 1), (0, 1), (0, 0)], "doc_id long, toxic int").withColumn("text", F.lit("slur"))
    model = fit_toxicity(df, lab)
    got = [(r.doc_id, r.score, r.predicted) for r in score_toxicity(df, model, keep=["doc_id"], passages=True).collect()]
    assert len(got) == len(rows) + len(extra) and all(0 <= s <= 1 and p == int(s >= 0.5) for _, s, p in got)
    truth = dict(labels)
    wrong = sum(p != truth[i] for i, _, p in got if i in truth)
    assert wrong <= 0.03 * len(rows)
    by = {i: p for i, _, p in got}
    assert (by[9000], by[9001], by[9002], by[9003], by[None]) == (0, 0, 0, 1, 1)
    # labels are no input of a score: the same texts without ids and labels score alike
    again = score_toxicity(df.select(F.lit(None).cast("long").alias("doc_id"), "text"), model, keep=["doc_id"])
    assert sorted(r.score for r in again.collect()) == sorted(s for _, s, _ in got)
    with pytest.raises(ValueError):
        score_toxicity(df, model, keep=["score"])


def test_toxicity_learns_only_from_its_folds(spark):
    rows, labels = toxic_corpus(300)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = lab.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = fit_toxicity(df, lab), fit_toxicity(df, flipped)
    assert a.units == b.units and (a.lam, a.k, a.weight, a.bias) == (b.lam, b.k, b.weight, b.bias)


def test_toxicity_without_labels_or_rows(spark):
    rows, labels = toxic_corpus(30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    for model in (fit_toxicity(df, lab.limit(0)), fit_toxicity(df.limit(0), lab), fit_toxicity(df, lab.where("toxic = 0"))):
        assert {r.score for r in score_toxicity(df, model).collect()} == {0.0}
    assert score_toxicity(df.limit(0), fit_toxicity(df, lab, ToxicityConfig(min_z=0.5))).count() == 0


def test_only_near_copies_teach_once(spark):
    """Texts that share a licence line all teach; copies and near-copies do not."""
    r = random.Random(6)
    licence = " ".join(f"licence{k}" for k in range(60))
    rows = [(i, f"{' '.join(f'w{r.randrange(10**6)}' for _ in range(60))} {licence}") for i in range(60)]
    base = [f"base{k}" for k in range(300)]
    rows += [(100 + i, " ".join(base[:-1] + [f"end{i}"])) for i in range(20)] + [(200 + i, "one and the same text of some words") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id long, toxic int")
    got = [x._text for x in _teachers(df, lab, ToxicityConfig(), "doc_id", "text", "toxic").collect()]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum("licence0" in x for x in got) == sum(i < 60 and i not in held for i, _ in rows)
    assert sum("base0" in x for x in got) == 1 and sum("same" in x for x in got) == 1


def test_weak_segments_add_up(spark):
    """Many toxic words, none of them significant alone: the document counts them all."""
    model = ToxicityModel({"=slur": (1.6, 9.0), "=vile": (4.0, 9.0)}, ToxicityConfig(), lam=2.5, k=0.03, weight=0.55, bias=-5.0)
    gap = " ".join(["word"] * 20)
    weak = f"{gap} slur " * 6
    df = spark.createDataFrame([(0, gap), (1, weak), (2, f"{gap} slur"), (3, f"{gap} vile {gap}")], "doc_id long, text string")
    got = {r.doc_id: r for r in score_toxicity(df, model, keep=["doc_id"], passages=True).collect()}
    assert [got[i].predicted for i in range(4)] == [0, 1, 0, 1]
    assert [got[i].n_passages for i in range(4)] == [0, 0, 0, 1] and got[1].passages == []
    # the sum that the calibration sees is the one that is scored
    n, x = len(weak.split()), 2.5 * 1.6
    seg = spark.createDataFrame([(n, [1.6] * 6)], "n long, seg array<double>")
    t = seg.select(_statistic(model)).first()[0]
    assert t == pytest.approx(6 * (x - math.log(0.03 * n))) and got[1].score == pytest.approx(model.probability(t))


def backoff_brute(rows, alpha=0.4):
    docs = [(i, (t or "").encode().lower().split()) for i, t in rows]
    uni, bi = collections.Counter(), collections.Counter()
    for _, w in docs:
        uni.update(w)
        bi.update(zip([None] + w, w))
    total, out = sum(uni.values()), []
    for i, w in docs:
        own = collections.Counter(zip([None] + w, w))
        x = 0.0
        for (a, b), n in own.items():
            c = bi[a, b] - n
            x += n * math.log(c / (len(docs) if a is None else uni[a]) if c else alpha * uni[b] / total)
        out.append((i, len(w), x))
    return out


@pytest.mark.parametrize("cfg", [BackoffConfig(), BackoffConfig(partition_bytes=800, block_docs=7), BackoffConfig(partition_bytes=100, block_words=20)])
def test_backoff_against_brute_force(spark, cfg):
    r = random.Random(2)
    vocab = ["the"] * 40 + [f"v{i}" for i in range(60)] + ["É", "x|y"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(0, 60)))) for i in range(60)]
    rows += [(70, None), (71, ""), (None, "the v1 the"), (72, "rare"), (72, "rare"), (73, "the the " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("block", F.lit(1))
    got = sorted(((x.doc_id, x.n_words, x.log_score) for x in backoff_scores(df, cfg).collect()), key=str)
    want = sorted(backoff_brute(rows), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-9) for a, b in zip(got, want))
    assert {x.mean_log_score for x in backoff_scores(df, cfg).where("n_words = 0").collect()} == {None}
    assert backoff_scores(df.limit(0), cfg).count() == 0


def mix_corpus(n=400, seed=8):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        kind = "good" if i % 10 < 7 else "poor"
        own = [f"{kind}{k}" for k in range(30)]
        rows.append((i, " ".join(r.choice(own if r.random() < 0.5 else [f"any{k}" for k in range(50)]) for _ in range(r.randrange(5, 80)))))
        labels.append((i, kind))
    return rows, labels


def test_mixing_meets_the_targets(spark):
    rows, labels = mix_corpus()
    rows += [(900, None), (901, ""), (None, "good1 good2 any3"), (902, " lead and tail "), (902, "poor1 poor2"), (903, "any1 " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rate", F.lit("x")).withColumn("token", F.lit("x"))
    lab = spark.createDataFrame(labels[::2] + [(None, "good"), (3, None), (5, "no target"), (1, "good")], "doc_id long, domain string").withColumn("text", F.lit("x"))
    out = mix_documents(df, lab, {"good": 0.5, "poor": 0.5}).toPandas().set_index("doc_id", drop=False)
    assert len(out) == len({i for i, _ in rows})
    assert out.loc[902].n_tokens == 5 and out.loc[900].n_tokens == 0 and out.loc[903].n_tokens == 20000
    total = out.n_tokens.sum()
    for d in ("good", "poor"):
        assert (out.rate * out.n_tokens * out[f"p_{d}"]).sum() == pytest.approx(0.5 * total, rel=1e-3)
    assert ((out.p_good + out.p_poor - 1).abs() < 1e-9).all() and (out.rate >= 0).all() and (out.rate <= 8).all()
    assert ((out.copies - out.rate).abs() < 1 + 1e-9).all()
    truth = dict(labels)
    assert sum((out.loc[i].p_good > 0.5) == (truth[i] == "good") for i in truth) > 0.95 * len(truth)
    copied = apply_mix(df, mix_documents(df, lab, {"good": 0.5, "poor": 0.5}))
    assert copied.columns == df.columns
    n = collections.Counter(r.doc_id for r in copied.collect())
    repeats = collections.Counter(i for i, _ in rows)
    assert all(n[i] == out.copies[i] * repeats[i] for i in repeats if i is not None)


def test_rates_are_the_least_squares_solution(spark):
    """Against a dense projected gradient in plain Python, targets out of reach included."""
    import numpy as np

    from tabulon.llm.mixing import fit_rates
    r = np.random.default_rng(3)
    p = r.dirichlet([0.3, 0.3, 0.3], 50)
    n = r.integers(1, 100, 50)
    soft = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(50)], "_id long, n_tokens long, p_0 double, p_1 double, p_2 double")
    for target in ([0.2, 0.3, 0.5], [1.0, 0.0, 0.0]):
        got = np.array([x.rate for x in fit_rates(soft, target, MixConfig(max_steps=200, tolerance=1e-6)).orderBy("_id").collect()])
        mass = (n[:, None] * p).sum(0)
        t = n.sum() * np.array(target)
        rate = np.ones(50)
        for _ in range(20000):
            rate = np.clip(rate - p @ ((rate * n) @ p / mass - t / mass), 0, 8)
        loss = lambda x: ((((x * n) @ p - t) ** 2) / mass).sum()
        assert loss(got) <= loss(rate) * 1.01 + 1e-4 * n.sum()


def dual_rates(n, p, t, mass, ridge):
    """The same rates by Newton steps on the K numbers of the dual problem, dense."""
    import numpy as np
    dual = np.zeros(len(t))

    def at(l):
        r = np.maximum(0.0, 1 - p @ l)
        value = (-n * ((r - 1) ** 2 / 2 + r * (p @ l))).sum() + t @ l + ridge / 2 * (mass * l) @ l
        return r, (r * n) @ p, value
    for _ in range(500):
        r, now, value = at(dual)
        slope = t - now + ridge * mass * dual
        on = r > 0
        move = np.linalg.solve((p[on] * n[on, None]).T @ p[on] + ridge * np.diag(mass), -slope)
        step = 1.0
        while step > 1e-10 and at(dual + step * move)[2] > value + 1e-4 * step * slope @ move:
            step /= 2
        dual = dual + step * move
        if step <= 1e-10 or np.abs(slope).max() < 1e-9:
            break
    return at(dual)[0]


def test_projected_gradient_equals_the_dual_solution(spark):
    import numpy as np
    r = np.random.default_rng(4)
    for target in ([0.2, 0.3, 0.5], [0.7, 0.25, 0.05]):
        p, n = r.dirichlet([0.3, 0.6, 0.2], 200), r.integers(1, 400, 200)
        soft = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(200)], "_id long, n_tokens long, p_0 double, p_1 double, p_2 double")
        cfg = MixConfig(tolerance=1e-6)
        got = np.array([x.rate for x in fit_rates(soft, target, cfg).orderBy("_id").collect()])
        mass, t = (n[:, None] * p).sum(0), n.sum() * np.array(target)
        want = dual_rates(n.astype(float), p, t, mass, cfg.ridge)
        assert np.abs((got * n) @ p - t).max() <= np.abs((want * n) @ p - t).max() + 1e-4 * n.sum()
        distance = lambda x: (n * (x - 1) ** 2).sum()
        assert (got >= 0).all() and distance(got) <= distance(want) * 1.02 + 1e-3


def test_a_rare_domain_reaches_its_target(spark):
    """Half a per cent of the tokens, five per cent wanted: ten times as often."""
    rows = [(i, 100, *((0.01, 0.99) if i % 200 == 0 else (0.999, 0.001))) for i in range(1000)]
    soft = spark.createDataFrame(rows, "_id long, n_tokens long, p_0 double, p_1 double").cache()
    named = lambda d: d.select("n_tokens", F.col("p_0").alias("p_a"), F.col("p_1").alias("p_b"), "rate", F.col("rate").cast("int").alias("copies"))
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = fit_rates(soft, [0.95, 0.05], MixConfig())
    rep = {r.domain: r for r in target_report(named(got), {"a": 0.95, "b": 0.05}).collect()}
    assert rep["b"].wanted == pytest.approx(5000) and rep["b"].reached == pytest.approx(5000, rel=1e-3)
    assert got.agg(F.max("rate")).first()[0] > 8
    # a cap or a target out of reach is told
    with pytest.warns(UserWarning, match="reached"):
        capped = fit_rates(soft, [0.95, 0.05], MixConfig(max_rate=8.0))
    rep = {r.domain: r for r in target_report(named(capped), {"a": 0.95, "b": 0.05}).collect()}
    assert rep["b"].missed > 500
    with pytest.warns(UserWarning, match="reached"):
        fit_rates(soft.withColumn("p_0", F.lit(0.5)).withColumn("p_1", F.lit(0.5)), [0.9, 0.1], MixConfig())


def test_mixing_without_labels_or_rows(spark):
    rows, labels = mix_corpus(30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, domain string")
    even = mix_documents(df, lab.limit(0), {"good": 0.5, "poor": 0.5}).collect()
    assert all(x.p_good == pytest.approx(0.5) and x.rate == pytest.approx(1.0) for x in even)
    assert mix_documents(df.limit(0), lab, {"good": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mix_documents(df, lab, {"good": -1.0})


def test_mixing_plan_has_no_python(spark):
    rows, labels = mix_corpus(30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = mix_documents(df, spark.createDataFrame(labels, "doc_id long, domain string"), {"good": 0.5, "poor": 0.5})._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
