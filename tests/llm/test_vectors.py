import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm.near_vectors import HyperplaneConfig, near_vectors, tables_for
from tabulon.llm.nearest import nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_nearest(rows, k, is_query):
    ok = {i: np.array(v, float) for i, v, _ in rows if v and i is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in ok:
        if is_query(q):
            c = [(-float(ok[q] @ v / math.sqrt((ok[q] @ ok[q]) * (v @ v))), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])]
            # equal up to rounding: ties by id
            out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in c)[:k]]
    return out


def vectors(n, d=16, seed=1):
    r = np.random.default_rng(seed)
    base = r.normal(size=(max(1, n // 4), d))
    rows = []
    for i in range(n):
        v = base[i % len(base)] + (0 if i % 3 == 0 else r.normal(size=d) * r.choice([0.01, 0.2, 0.4]))
        rows.append((i, [float(np.float32(x)) for x in v], int((i % len(base)) % 3)))
    return rows


BAD = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] + [1.0] * 15, 1), (1004, [None] + [1.0] * 15, 1),
       (1005, [float("inf")] + [1.0] * 15, 1), (1050, [0.0] * 16, 1)]


@pytest.mark.parametrize("block", [7, 1024])
def test_nearest_is_exact(spark, block):
    rows = vectors(200) + BAD + [(2000 + i, [1.0] * 16, 0) for i in range(30)] + [(3000, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_id", F.lit(3)).withColumn("score", F.lit("x"))
    got = nearest(df, F.col("vec_id") % 10 == 0, 5, block=block).collect()
    want = brute_nearest(rows, 5, lambda i: i % 10 == 0)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {q: v for q, v in want.items() if v}
    assert [r["rank"] for r in got if r.query_id == 0 or r.query_id == 10].count(1) == 2


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, F.col("vec_id") == 0, 5).collect()]
    assert got == [(0, 1, 5, 0.0)]
    assert nearest(df.limit(0), F.lit(True)).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 0.0]), (1, [1e-300, 1e-300]), (2, [1e300, 1e300])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in nearest(huge, F.lit(True), 2).collect()}
    assert got[1, 2] == pytest.approx(1.0) and got[0, 1] == pytest.approx(math.sqrt(0.5))


@pytest.mark.parametrize("cfg", [HyperplaneConfig(), HyperplaneConfig(target=4, block=5)])
def test_near_vectors_against_brute_force(spark, cfg):
    rows = vectors(240, seed=2) + BAD + [(2000 + i, [1.0] * 16, 2) for i in range(25)] + [(4000, [1.0] * 16, None), (None, [1.0] * 16, 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1)).withColumn("component_id", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, cfg).collect() if r.vec_id is not None}
    assert near_vectors(df, cfg).count() == len(rows)
    ok = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and None not in v
          and np.isfinite(np.array(v, float)).all() and any(v)]
    parent = {i: i for i, *_ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = dict.fromkeys(parent, 0)
    for a in range(len(ok)):
        for b in range(a):
            (i, v, l), (j, w, m) = ok[a], ok[b]
            if l == m and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = {i: (links[i], find(i), find(i) == i) for i in parent}
    wrong = [i for i in want if want[i] != got[i]]
    assert len(wrong) <= 0.01 * len(want), [(i, want[i], got[i]) for i in wrong][:5]
    # equal vectors always meet
    assert got[2001][:2] == (24, 2000) and got[4000] == (0, 4000, True) and got[1000] == (0, 1000, True)


def test_table_numbers_reach_the_recall():
    for n in (1, 10, 1000, 10**6, 10**9):
        cfg = HyperplaneConfig()
        bits, tables = tables_for(n, cfg)
        p = (1 - math.acos(cfg.threshold) / math.pi) ** bits
        assert 1 - (1 - p) ** tables >= cfg.recall


def test_near_vectors_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_vectors_of_one_id_take_one_place(spark):
    from tabulon.llm.nearest import nearest
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.001 * i]) for i in range(12)] + [(i, [1.0, 0.1 * i]) for i in range(2, 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in nearest(df, F.col("vec_id") == 0, k=5).orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5]
