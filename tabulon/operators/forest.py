"""Random forests whose trees no process holds as a whole (MDL2, MDL5).

Spark ML grows and keeps a forest in the driver, about half a kilobyte for a node, and
sends all of it to every scoring task; trees of depth 30 have as many nodes as their
table has rows, within a small factor.  Here the same forest (Gini splits of at most
``BINS`` bins, Poisson bootstrap, a random subset of features at each node, leaves of
one prediction merged, votes by share of the leaf) is grown in two steps:

1. rows are binned to a byte a feature and packed in blocks; while a node has more than
   ``local_rows`` rows, histograms by block are added up and the driver learns its split;
2. the rows of each remaining node go to one task, which grows the subtree below it.

The driver knows the split of the few large nodes; subtrees stay in a table.  Scoring
deals rows to packs of subtrees of bounded size in the same way.  Which rows a tree
draws follows from (seed, tree, block), which features a node tries from (seed, tree,
node), so a task that runs again does the same.
"""

from __future__ import annotations

import json
import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.ordered import materialize

#: bins of a feature, as Spark ML's maxBins; borders from which the cuts between them are taken
BINS, BORDERS = 32, 1024
#: bytes of binned rows that one task grows a subtree from, and nodes that a scoring task holds
LOCAL_BYTES, PACK_NODES = 32 << 20, 1_000_000
#: nodes whose histograms are held at a time
NODES_AT_ONCE = 2048
#: a share of weight below which a rest is a rounding error
TINY = 1e-12

NODES = "tree int, root int, nodes int, feature binary, cut binary, `left` binary, stats binary, importances array<double>"


# --- bins ---------------------------------------------------------------------------------

def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _cuts_of_values(values: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def _cuts_of_borders(parts: list[tuple[float, float, float]]) -> list[float]:
    """Cuts at even shares of weight between neighbouring (weight, least, greatest)."""
    stride = sum(p[0] for p in parts) / BINS
    cuts, run, target = [], 0.0, stride
    for (w, _, top), (after, low, _) in zip(parts, parts[1:]):
        run += w
        if run + after / 2 >= target:                # no later border is nearer to the share
            cuts.append((top + low) / 2)
            target = (int(run / stride) + 1) * stride if run >= target else target + stride
    return cuts[:BINS - 1]


def find_cuts(rows: DataFrame, width: int) -> list[list[float]]:
    """Ascending cuts of each feature, from all rows: between all values where there are
    at most ``BINS``, else at even shares of weight.  ``rows`` has x, y and w."""
    probs = [i / BORDERS for i in range(1, BORDERS)]
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(j)), probs, 10_000).alias(f"b{j}") for j in range(width)]).first()
    borders = [np.unique(found[f"b{j}"]) if found[f"b{j}"] else np.zeros(0) for j in range(width)]

    def summed(batches):
        totals, ends, seen = [np.zeros(len(b) + 1) for b in borders], [np.full((len(b) + 1, 2), (np.inf, -np.inf)) for b in borders], [set() for _ in borders]
        for b in batches:
            x, w = _matrix(b.column("x")), b.column("w").to_numpy(zero_copy_only=False)
            for j in range(width if len(x) else 0):
                at = np.searchsorted(borders[j], x[:, j], side="left")
                totals[j] += np.bincount(at, w, len(totals[j]))
                np.minimum.at(ends[j][:, 0], at, x[:, j])
                np.maximum.at(ends[j][:, 1], at, x[:, j])
                if len(seen[j]) <= BINS:
                    seen[j] |= set(np.unique(x[:, j])[:BINS + 1].tolist())
        out = [(j, i, float(totals[j][i]), float(ends[j][i, 0]), float(ends[j][i, 1]), sorted(seen[j])[:BINS + 1] if i == 0 else None)
               for j in range(width) for i in range(len(totals[j])) if i == 0 or ends[j][i, 0] <= ends[j][i, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64())))],
                                         names=["j", "i", "w", "low", "top", "seen"])
    table = rows.select("x", "w").mapInArrow(summed, "j int, i int, w double, low double, top double, seen array<double>")
    table = table.groupBy("j", "i").agg(F.sum("w").alias("w"), F.min("low").alias("low"), F.max("top").alias("top"),
                                        F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"))
    cuts: list[list[float]] = [[] for _ in range(width)]
    parts: dict[int, list] = {}
    for r in table.orderBy("j", "i").collect():                       # at most BORDERS rows a feature
        if r["i"] == 0:
            parts[r["j"]] = [r["seen"]]
        if r["low"] <= r["top"]:
            parts[r["j"]].append((r["w"], r["low"], r["top"]))
    for j, (seen, *rest) in parts.items():
        cuts[j] = _cuts_of_values(seen) if len(seen) <= BINS else _cuts_of_borders(rest)
    return cuts


def _packed(rows: DataFrame, cuts: list[list[float]], extra: dict) -> DataFrame:
    """One row for each Arrow batch: its bins by feature, and the ``extra`` columns
    (name to NumPy type) as they are."""
    edges = [np.array(c) for c in cuts]

    def pack(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for i, b in enumerate(b for b in batches if b.num_rows):
            x = _matrix(b.column("x"))
            if x.shape[1] != len(edges):
                raise ValueError(f"vectors of {x.shape[1]} features for a forest of {len(edges)}")
            bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)
            cols = [np.ascontiguousarray(b.column(c).to_numpy(zero_copy_only=False).astype(t)).tobytes() for c, t in extra.items()]
            yield pa.RecordBatch.from_arrays([pa.array([(part << 33) + i], pa.int64()), pa.array([bins.tobytes()], pa.binary()), *(pa.array([c], pa.binary()) for c in cols)],
                                             names=["block", "x", *extra])
    return rows.select("x", *extra).mapInArrow(pack, "block long, x binary, " + ", ".join(f"{c} binary" for c in extra))


# --- splits -------------------------------------------------------------------------------

def _tried(rng, nodes: int, width: int, tries: int) -> np.ndarray:
    """(nodes, tries): features that each node tries."""
    if tries >= width:
        return np.tile(np.arange(width), (nodes, 1))
    return rng.random((nodes, width)).argsort(axis=1)[:, :tries]


def _best(hist: np.ndarray, counts: np.ndarray | None, min_rows: int):
    """Of (classes, nodes, bins) weights: per node the best cut, its gain and the class
    weights on both sides; of ``counts`` (nodes, bins) each side needs ``min_rows``."""
    run = hist.cumsum(axis=2)
    left, whole = run[:, :, :-1], run[:, :, -1]
    right = whole[:, :, None] - left
    lw, rw, total = left.sum(axis=0), right.sum(axis=0), whole.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left * left).sum(axis=0) / lw + (right * right).sum(axis=0) / rw
        gain = (gain - ((whole * whole).sum(axis=0) / total)[:, None]) / total[:, None]
    ok = (lw > 0) & (rw > 0)
    if counts is not None:
        n = counts.cumsum(axis=1)[:, :-1]
        ok &= (n >= min_rows) & (counts.sum(axis=1)[:, None] - n >= min_rows)
    gain = np.where(ok, gain, -1.0)
    cut = gain.argmax(axis=1)
    nodes = np.arange(len(cut))
    return cut, gain[nodes, cut], left[:, nodes, cut], right[:, nodes, cut]


def _pure(stats: np.ndarray) -> np.ndarray:
    """Whether (classes, nodes) weights are of one class."""
    return stats.max(axis=0) >= stats.sum(axis=0) * (1 - TINY)


def _level(x, y, weight, count, rows, sizes, rng, classes, tries, min_rows):
    """Best splits of nodes whose ``rows`` lie one node after the other: feature, cut,
    gain and the weights of both sides."""
    n, flat, m = len(sizes), x.ravel(), x.shape[1]
    feature, cut, gain, sides = np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n), np.zeros((2, classes, n))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for start in range(0, n, NODES_AT_ONCE):
        q = min(NODES_AT_ONCE, n - start)
        mine = rows[ends[start]:ends[start + q]]
        here = np.repeat(np.arange(q), sizes[start:start + q])
        tried = _tried(rng, q, len(x), tries)
        w, base = weight[mine], y[mine].astype(np.int64) * (q * BINS) + here * BINS
        for s in range(tried.shape[1]):
            f = tried[:, s]
            b = flat[(f * m)[here] + mine]
            hist = np.bincount(base + b, w, classes * q * BINS).reshape(classes, q, BINS)
            counts = np.bincount(here * BINS + b, count[mine], q * BINS).reshape(q, BINS) if min_rows > 1 else None
            c, g, low, high = _best(hist, counts, min_rows)
            better = np.flatnonzero(g > np.maximum(gain[start:start + q], TINY))
            to = better + start
            feature[to], cut[to], gain[to], sides[0][:, to], sides[1][:, to] = f[better], c[better], g[better], low[:, better], high[:, better]
    return feature, cut, gain, sides


def grow(x, y, weight, count, rng, classes: int, depth: int, tries: int, min_rows: int) -> dict:
    """A tree of binned rows, level by level; arrays by node, a right child behind its
    left one, leaves with feature -1."""
    stats = np.bincount(y, weight, classes).reshape(classes, 1)
    opened = np.flatnonzero(~_pure(stats))
    rows, sizes = np.arange(x.shape[1]), np.array([x.shape[1]])
    levels, first = [], 0
    while True:
        n = stats.shape[1]
        feature, cut, gain, left = np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n), np.zeros(n, np.int32)
        levels.append((feature, cut, gain, left, stats))
        if len(levels) > depth or not len(opened):
            break
        f, c, g, sides = _level(x, y, weight, count, rows, sizes, rng, classes, tries, min_rows)
        split = np.flatnonzero(f >= 0)
        if not len(split):
            break
        to = opened[split]
        feature[to], cut[to], gain[to], left[to] = f[split], c[split], g[split], first + n + 2 * np.arange(len(split))
        stats = sides[:, :, split].transpose(1, 2, 0).reshape(classes, -1)
        first += n
        open_ = ~_pure(stats)
        opened = np.flatnonzero(open_)
        # the rows of children that stay open, again one node after the other
        rows = rows[np.repeat(f >= 0, sizes)]
        rank = np.repeat(np.arange(len(split)), sizes[split])
        child = 2 * rank + (x[f[split][rank], rows] > c[split][rank])
        go = open_[child]
        rows, child = rows[go], child[go]
        every = np.bincount(child, minlength=len(open_))
        begin = np.cumsum(every) - every
        moved = np.empty_like(rows)
        for side in (0, 1):
            on = (child & 1) == side
            of = child[on]
            ahead = np.cumsum(every[side::2]) - every[side::2]
            moved[begin[of] + np.arange(len(of)) - ahead[of >> 1]] = rows[on]
        rows, sizes = moved, every[opened]
    return _pruned(levels)


def _pruned(levels: list) -> dict:
    """Levels as one tree, without the splits both of whose sides are leaves of the same
    prediction."""
    sizes = [len(lv[0]) for lv in levels]
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    feature, cut, gain, left = (np.concatenate([lv[i] for lv in levels]) for i in range(4))
    stats = np.concatenate([lv[4] for lv in levels], axis=1)
    said = stats.argmax(axis=0)
    for lv in reversed(range(len(levels))):
        i = np.arange(firsts[lv], firsts[lv + 1])
        i = i[feature[i] >= 0]
        a = left[i]
        same = i[(feature[a] < 0) & (feature[a + 1] < 0) & (said[a] == said[a + 1])]
        feature[same], gain[same], cut[same] = -1, 0.0, 0
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    for lv in range(len(levels)):
        i = np.arange(firsts[lv], firsts[lv + 1])
        i = i[kept[i] & (feature[i] >= 0)]
        kept[left[i]] = kept[left[i] + 1] = True
    number = np.cumsum(kept) - 1
    left = np.where(feature >= 0, number[np.where(feature >= 0, left, 0)], 0).astype(np.int32)
    return {"feature": feature[kept], "cut": cut[kept], "gain": gain[kept], "left": left[kept], "stats": stats[:, kept]}


def _importances(tree: dict, width: int) -> np.ndarray:
    inner = tree["feature"] >= 0
    return np.bincount(tree["feature"][inner], (tree["gain"] * tree["stats"].sum(axis=0))[inner], width)


def walk(x: np.ndarray, tree: dict, each=None) -> np.ndarray:
    """The leaf of every row (a column of ``x``); ``each(rows, before, after)`` sees the
    steps on the way."""
    feature, cut, left = tree["feature"], tree["cut"], tree["left"]
    at = np.zeros(x.shape[1], np.int32)
    rows = np.arange(x.shape[1] if feature[0] >= 0 else 0)
    while len(rows):
        here = at[rows]
        after = left[here] + (x[feature[here], rows] > cut[here])
        if each:
            each(rows, here, after)
        at[rows] = after
        rows = rows[feature[after] >= 0]
    return at


# --- growing ---------------------------------------------------------------------------------

def _tops(trees: int, classes: int) -> list[dict]:
    one = {"feature": np.full(1, -1, np.int16), "cut": np.zeros(1, np.uint8), "left": np.zeros(1, np.int32), "gain": np.zeros(1),
           "stats": np.zeros((classes, 1)), "closed": np.zeros(1, bool), "depth": np.zeros(1, np.int32)}
    return [{k: v.copy() for k, v in one.items()} for _ in range(trees)]


def _draws(batches, width: int, trees: list[int], seed: int, rate: float) -> Iterator:
    """(block, tree, x, y, weight, count) of the rows that each tree draws of each block."""
    for b in batches:
        for block, x, y, w in zip(*(b.column(c).to_pylist() for c in ("block", "x", "y", "w"))):
            x, y, w = np.frombuffer(x, np.uint8).reshape(width, -1), np.frombuffer(y, np.uint8), np.frombuffer(w, np.float64)
            for t in trees:
                count = np.random.default_rng([seed, 0, t, block]).poisson(rate, len(y)).astype(np.uint8)
                in_ = np.flatnonzero(count)
                yield block, t, x[:, in_], y[in_], w[in_], count[in_]


def _split_large(blocks: DataFrame, tops: list[dict], n_rows: float, local_rows: int, width: int, classes: int, depth: int, tries: int, min_rows: int, seed: int, rate: float) -> None:
    """Splits all nodes of more than ``local_rows`` rows, a level at a time; the driver
    holds these only, a few for each tree and ``local_rows`` rows."""
    large = {(t, 0) for t in range(len(tops))} if n_rows * rate > local_rows else set()
    while large:
        feats = {(t, i): _tried(np.random.default_rng([seed, 2, t, i]), 1, width, tries)[0] for t, i in large}
        at_once, trees = [dict(tops[t]) for t in range(len(tops))], sorted({t for t, _ in large})

        def histograms(batches):
            sums: dict = {}
            for _, t, x, y, w, count in _draws(batches, width, trees, seed, rate):
                leaf = walk(x, at_once[t])
                for i in np.unique(leaf).tolist():
                    if (t, i) in feats:
                        s = np.flatnonzero(leaf == i)
                        one = np.stack([np.concatenate([np.bincount(y[s].astype(np.int64) * BINS + x[f, s], w[s] * count[s], classes * BINS),
                                                        np.bincount(x[f, s], count[s], BINS)]) for f in feats[t, i]])
                        sums[t, i] = sums[t, i] + one if (t, i) in sums else one
            if sums:
                keys = sorted(sums)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                                  pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["tree", "node", "hist"])

        def best(key, group):
            t, i = key[0].as_py(), key[1].as_py()
            hist = sum(np.sort(np.stack([np.frombuffer(h, np.float64) for h in group.column("hist").to_pylist()]), axis=0)).reshape(-1, classes + 1, BINS)
            out = (t, i, -1, 0, 0.0, hist[0, :classes].sum(axis=1).tolist(), None, None, None)
            for f, h in zip(feats[t, i].tolist(), hist):
                cut, gain, low, high = _best(h[:classes, None, :], h[None, classes], min_rows)
                if gain[0] > max(out[4], TINY):
                    n = h[classes, :cut[0] + 1].sum(), h[classes, cut[0] + 1:].sum()
                    out = (t, i, f, int(cut[0]), float(gain[0]), out[5], low[:, 0].tolist(), high[:, 0].tolist(), [float(v) for v in n])
            kinds = (*[pa.int32()] * 4, pa.float64(), *[pa.list_(pa.float64())] * 4)
            return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(out, kinds)], names=["tree", "node", "feature", "cut", "gain", "stats", "low", "high", "n"])
        found = blocks.mapInArrow(histograms, "tree int, node int, hist binary").groupBy("tree", "node").applyInArrow(
            best, "tree int, node int, feature int, cut int, gain double, stats array<double>, low array<double>, high array<double>, n array<double>").orderBy("tree", "node").collect()
        large = set()
        for r in found:
            top, i, stats = tops[r["tree"]], r["node"], np.array(r["stats"])
            top["stats"][:, i] = stats
            if r["feature"] < 0 or top["depth"][i] >= depth:
                top["closed"][i] = True
                continue
            new = np.stack([r["low"], r["high"]], axis=1)
            k = len(top["feature"])
            top["feature"][i], top["cut"][i], top["gain"][i], top["left"][i] = r["feature"], r["cut"], r["gain"], k
            below = top["depth"][i] + 1
            done = _pure(new) | (below >= depth)
            for name, more in (("feature", [-1, -1]), ("cut", [0, 0]), ("left", [0, 0]), ("gain", [0.0, 0.0]), ("closed", done), ("depth", [below, below])):
                top[name] = np.concatenate([top[name], np.array(more, top[name].dtype)])
            top["stats"] = np.concatenate([top["stats"], new], axis=1)
            large |= {(r["tree"], k + s) for s in (0, 1) if not done[s] and r["n"][s] > local_rows}


def _subtrees(blocks: DataFrame, tops: list[dict], width: int, classes: int, depth: int, tries: int, min_rows: int, seed: int, rate: float) -> DataFrame:
    """The rows of every node that is left go to one task, which grows what is below it."""
    trees = list(range(len(tops)))
    roots = sum(int(((top["feature"] < 0) & ~top["closed"]).sum()) for top in tops)

    def deal(batches):
        for b in batches:
            for one in range(b.num_rows):
                out = []
                for block, t, x, y, w, count in _draws([b.slice(one, 1)], width, trees, seed, rate):
                    leaf = walk(x, tops[t])
                    for i in np.unique(leaf).tolist():
                        if not tops[t]["closed"][i]:
                            s = slice(None) if len(tops[t]["feature"]) == 1 else np.flatnonzero(leaf == i)
                            out.append((t, i, block, np.ascontiguousarray(x[:, s]).tobytes(), y[s].tobytes(), w[s].tobytes(), count[s].tobytes()))
                if out:
                    kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["tree", "root", "block", "x", "y", "w", "n"])

    def below(key, group):
        t, i = key[0].as_py(), key[1].as_py()
        order = np.argsort(group.column("block").to_numpy(), kind="stable")
        parts = {c: (v := group.column(c).to_pylist()) and [v[o] for o in order] for c in ("x", "y", "w", "n")}
        x = np.concatenate([np.frombuffer(v, np.uint8).reshape(width, -1) for v in parts["x"]], axis=1)
        y, n = (np.frombuffer(b"".join(parts[c]), np.uint8) for c in ("y", "n"))
        w = np.frombuffer(b"".join(parts["w"]), np.float64) * n
        tree = grow(x, y, w, n, np.random.default_rng([seed, 1, t, i]), classes, depth - int(tops[t]["depth"][i]), tries, min_rows)
        return _node_rows([(t, i, tree)], width)
    dealt = blocks.mapInArrow(deal, "tree int, root int, block long, x binary, y binary, w binary, n binary")
    return dealt.repartition(max(1, min(roots, 8 * blocks.sparkSession.sparkContext.defaultParallelism + 64)), "tree", "root").groupBy("tree", "root").applyInArrow(below, NODES)


def _node_rows(trees: list, width: int) -> pa.Table:
    cols = {"tree": [t for t, _, _ in trees], "root": [i for _, i, _ in trees], "nodes": [len(d["feature"]) for _, _, d in trees]}
    arrays = [pa.array(v, pa.int32()) for v in cols.values()]
    arrays += [pa.array([np.ascontiguousarray(d[c]).tobytes() for _, _, d in trees], pa.binary()) for c in ("feature", "cut", "left", "stats")]
    arrays.append(pa.array([_importances(d, width).tolist() for _, _, d in trees], pa.list_(pa.float64())))
    return pa.Table.from_arrays(arrays, names=[*cols, "feature", "cut", "left", "stats", "importances"])


def _tree_of(row: dict, classes: int) -> dict:
    return {"feature": np.frombuffer(row["feature"], np.int16), "cut": np.frombuffer(row["cut"], np.uint8), "left": np.frombuffer(row["left"], np.int32),
            "stats": np.frombuffer(row["stats"], np.float64).reshape(classes, -1)}


def fit_forest(rows: DataFrame, label: str, weight: str | None, path: str, trees: int, depth: int, tries: str, min_rows: int, rate: float, seed: int,
               features_col: str = "features") -> "ForestModel":
    """A forest of ``trees`` trees over the vectors of ``rows``; its subtrees are a table
    below ``path`` in the shared folder.  ``tries``: "all" features at each node, or
    "sqrt" of their number (all, if there is one tree)."""
    x = rows.select(vector_to_array(features_col).alias("x"), F.col(label).cast("double").alias("y"),
                    (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    x = x.persist(StorageLevel.MEMORY_AND_DISK)            # four passes read it
    bad = ~F.coalesce((F.col("y") >= 0) & (F.col("y") < 100) & (F.col("y") == F.floor("y")) & (F.col("w") >= 0) & ~F.isnan("w") & (F.col("w") < float("inf")), F.lit(False))
    n, wrong, most, width, narrow = x.agg(F.count(F.lit(1)), F.count_if(bad), F.max("y"), F.max(F.size("x")), F.min(F.size("x"))).first()
    if not n:
        raise ValueError("no rows to train on")
    if wrong or width != narrow:
        raise ValueError(f"{wrong} rows without a whole label in 0..99 or a weight of at least 0, vectors of {narrow} to {width} features")
    classes = max(2, int(most) + 1)
    k = width if tries == "all" or trees == 1 else int(np.ceil(np.sqrt(width)))
    cuts = find_cuts(x, width)
    blocks = materialize(_packed(x, cuts, {"y": np.uint8, "w": np.float64}))
    x.unpersist()
    tops, args = _tops(trees, classes), (width, classes, depth, k, min_rows, seed, rate)
    _split_large(blocks, tops, n, LOCAL_BYTES // (width + 10), *args)
    _subtrees(blocks, tops, *args).write.parquet(path)
    spark = rows.sparkSession
    grown = spark.read.parquet(path)
    sizes = {(r["tree"], r["root"]): r for r in grown.select("tree", "root", "nodes", "importances", F.when(F.col("nodes") == 1, F.col("stats")).alias("stats")).collect()}   # one row per subtree
    totals, packed = np.zeros(width), []
    for t, top in enumerate(tops):
        shares = _join_top(t, top, sizes, classes, width)
        totals += shares / shares.sum() if shares.sum() > 0 else 0.0
        packed += [(t, i, sizes[t, i]["nodes"]) for i in np.flatnonzero((top["feature"] < 0) & ~top["closed"]).tolist()]
    return ForestModel._of(path, cuts, tops, totals / totals.sum() if totals.sum() > 0 else totals, packed, classes, features_col)


def _join_top(t: int, top: dict, sizes: dict, classes: int, width: int) -> np.ndarray:
    """Closes what needs no subtree, merges leaves of one prediction among the large
    nodes and returns the tree's importances."""
    leaf = top["feature"] < 0
    for i in np.flatnonzero(leaf & ~top["closed"]).tolist():
        r = sizes.get((t, i))
        if r is None:                                      # no row was drawn
            top["closed"][i] = True
        elif r["nodes"] == 1:
            top["stats"][:, i], top["closed"][i] = np.frombuffer(r["stats"], np.float64), True
    for i in reversed(range(len(top["feature"]))):         # children have larger numbers
        a = top["left"][i]
        if top["feature"][i] >= 0 and top["closed"][a] and top["closed"][a + 1] and top["stats"][:, a].argmax() == top["stats"][:, a + 1].argmax():
            top["feature"][i], top["gain"][i], top["closed"][i] = -1, 0.0, True
    live, out = [0], np.zeros(width)
    while live:
        i = live.pop()
        if top["feature"][i] >= 0:
            out[top["feature"][i]] += top["gain"][i] * top["stats"][:, i].sum()
            live += [int(top["left"][i]), int(top["left"][i]) + 1]
        elif not top["closed"][i]:
            out += np.array(sizes[t, i]["importances"])
    return out


# --- the model ---------------------------------------------------------------------------------

class ForestModel(Model, HasFeaturesCol, MLWritable, MLReadable):
    """A fitted forest: large nodes here, subtrees in a table.  Adds ``rawPrediction``,
    ``probability`` and ``prediction``, as Spark ML's forest does."""

    @classmethod
    def _of(cls, path: str, cuts, tops, importances, packed, classes: int, features_col: str) -> "ForestModel":
        m = cls()
        m._set(featuresCol=features_col)
        m.path, m.cuts, m.tops, m.importances, m.packed, m.numClasses = path, cuts, tops, importances, packed, classes
        return m

    @property
    def numFeatures(self) -> int:
        return len(self.cuts)

    @property
    def getNumTrees(self) -> int:
        return len(self.tops)

    @property
    def totalNumNodes(self) -> int:
        inner = sum(len(_reached(top)) for top in self.tops)
        return inner + sum(n - 1 for t, i, n in self._live())

    @property
    def featureImportances(self):
        return Vectors.dense(self.importances)

    def _live(self) -> list:
        """Subtrees that rows still reach: (tree, root, nodes)."""
        reached = [set(_reached(top)) for top in self.tops]
        return [(t, i, n) for t, i, n in self.packed if i in reached[t] and not self.tops[t]["closed"][i]]

    def _packs(self, parallel: int) -> list[list[tuple[int, int]]]:
        """Subtrees in order, packed up to ``PACK_NODES`` nodes; a tree that is all here
        is an item without a subtree, root -1."""
        closed = [(t, -1, 1) for t, top in enumerate(self.tops) if top["closed"][_reached(top)].any()]
        items = sorted([*self._live(), *closed])
        most = min(PACK_NODES, -(-sum(n for _, _, n in items) // max(1, parallel)))
        packs, size = [[]], 0
        for t, i, n in items:
            if packs[-1] and size + n > most:
                packs.append([])
                size = 0
            packs[-1].append((t, i))
            size += n
        return packs

    def _dealt(self, rows: DataFrame, outputs: int, visit) -> DataFrame:
        """(_row, values): per row of ``rows`` (_row, x) the sum over all trees of what
        ``visit(x, tree, root or closed, subtree, out)`` adds to its ``outputs`` numbers."""
        spark, width, classes, tops = rows.sparkSession, self.numFeatures, self.numClasses, self.tops
        packs = self._packs(2 * spark.sparkContext.defaultParallelism)
        blocks = materialize(_packed(rows, self.cuts, {"_row": np.int64}))
        n = blocks.agg(F.sum(F.length("_row") / 8)).first()[0] or 0
        chunks = max(1, -(-int(n) // (LOCAL_BYTES // (width + 10))))

        def reaches(x, items):
            """By tree of the pack: the leaf of each row among the large nodes."""
            return {t: walk(x, tops[t]) for t in {t for t, _ in items}}

        def asked(leaf, t, i):
            return tops[t]["closed"][leaf[t]] if i < 0 else leaf[t] == i

        def deal(batches):
            for b in batches:
                for block, x, row in zip(*(b.column(c).to_pylist() for c in ("block", "x", "_row"))):
                    x, row, out = np.frombuffer(x, np.uint8).reshape(width, -1), np.frombuffer(row, np.int64), []
                    for p, items in enumerate(packs):
                        if all(len(tops[t]["feature"]) == 1 for t, _ in items):
                            s = slice(None)
                        else:
                            leaf = reaches(x, items)
                            s = np.flatnonzero(np.any([asked(leaf, t, i) for t, i in items], axis=0))
                        if len(row[s]):
                            out.append((p, hash(block) % chunks, block, np.ascontiguousarray(x[:, s]).tobytes(), row[s].tobytes()))
                    if out:
                        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["pack", "chunk", "block", "x", "_row"])

        def score(key, left, right):
            subtrees = {(r["tree"], r["root"]): _tree_of(r, classes) for r in right.select(["tree", "root", "feature", "cut", "left", "stats"]).to_pylist()}
            items, out = packs[key[0].as_py()], []
            for block, x, row in zip(*(left.column(c).to_pylist() for c in ("block", "x", "_row"))):
                x, row = np.frombuffer(x, np.uint8).reshape(width, -1), np.frombuffer(row, np.int64)
                leaf, values = reaches(x, items), np.zeros((outputs, len(row)))
                for t, i in items:
                    s = np.flatnonzero(asked(leaf, t, i))
                    if len(s):
                        values[:, s] += visit(np.ascontiguousarray(x[:, s]), tops[t], leaf[t][s], subtrees.get((t, i)))
                out.append((block, row.tobytes(), values.tobytes()))
            return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.binary(), pa.binary()))], names=["block", "_row", "sums"])

        def added(key, group):
            row, inverse = np.unique(np.concatenate([np.frombuffer(v, np.int64) for v in group.column("_row").to_pylist()]), return_inverse=True)
            sums = np.concatenate([np.frombuffer(v, np.float64).reshape(outputs, -1) for v in group.column("sums").to_pylist()], axis=1)
            total = np.stack([np.bincount(inverse, s, len(row)) for s in sums], axis=1)
            return pa.Table.from_arrays([pa.array(row, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), outputs).cast(pa.list_(pa.float64()))], names=["_row", "values"])
        where = spark.createDataFrame([(p, t, i) for p, items in enumerate(packs) for t, i in items], "pack int, tree int, root int")
        nodes = spark.read.parquet(self.path).drop("nodes", "importances").join(F.broadcast(where), ["tree", "root"])
        nodes = nodes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        rows_of = blocks.mapInArrow(deal, "pack int, chunk int, block long, x binary, _row binary")
        parts = max(1, min(len(packs) * chunks, 8 * spark.sparkContext.defaultParallelism + 64))
        scored = rows_of.repartition(parts, "pack", "chunk").groupBy("pack", "chunk").cogroup(
            nodes.repartition(parts, "pack", "chunk").groupBy("pack", "chunk")).applyInArrow(score, "block long, _row binary, sums binary")
        return scored.groupBy("block").applyInArrow(added, "_row long, values array<double>")

    def _rows(self, dataset: DataFrame) -> DataFrame:
        """``dataset`` with a number of each row, settled: several passes read it."""
        return materialize(dataset.withColumn("_row", F.monotonically_increasing_id()))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def visit(x, top, leaf, subtree):
            stats = top["stats"][:, leaf] if subtree is None else subtree["stats"][:, walk(x, subtree)]
            total = stats.sum(axis=0)
            return np.divide(stats, total, out=np.zeros_like(stats), where=total > 0)
        rows = self._rows(dataset)
        votes = self._dealt(rows.select("_row", vector_to_array(self.getFeaturesCol()).alias("x")), self.numClasses, visit)
        total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
        share = F.when(total > 0, F.transform("values", lambda v: v / total)).otherwise(F.col("values"))
        best = F.array_position("values", F.array_max("values")) - 1
        return rows.join(votes, "_row").select(*[F.col(f"`{c}`") for c in dataset.columns], array_to_vector("values").alias("rawPrediction"),
                                               array_to_vector(share).alias("probability"), best.cast("double").alias("prediction"))

    def contributions(self, scored: DataFrame, key: str, features_col: str = "features") -> DataFrame:
        """``key``, bias, margin and contributions, as ``model.tree_contributions``."""
        width, trees = self.numFeatures, len(self.tops)

        def share(tree):
            return tree["stats"][1] / tree["stats"].sum(axis=0)

        def visit(x, top, leaf, subtree):
            out = np.zeros((width + 1, x.shape[1]))

            def steps(tree):
                value = share(tree)
                return lambda rows, before, after: np.add.at(out, (tree["feature"][before], rows), value[after] - value[before])
            walk(x, top, steps(top)) if len(top["feature"]) > 1 else None
            if subtree is not None:
                walk(x, subtree, steps(subtree))
            out[width] += share(top)[0] if len(top["feature"]) > 1 or subtree is None else share(subtree)[0]
            return out / trees
        rows = materialize(scored.select(key, vector_to_array(features_col).alias("x")).withColumn("_row", F.monotonically_increasing_id()))
        parts = self._dealt(rows.select("_row", "x"), width + 1, visit)
        return rows.join(parts, "_row").select(key, F.get("values", F.lit(width)).alias("bias"), F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("margin"),
                                               F.slice("values", 1, width).alias("contributions"))

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


def _reached(top: dict) -> list[int]:
    """Large nodes from the root on."""
    live, out = [0], []
    while live:
        i = live.pop()
        out.append(i)
        if top["feature"][i] >= 0:
            live += [int(top["left"][i]), int(top["left"][i]) + 1]
    return sorted(out)


class _Writer(MLWriter):
    def __init__(self, instance: ForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m, spark = self.instance, SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(m, path, spark)
        spark.read.parquet(m.path).write.parquet(path + "/nodes")
        about = {"cuts": [list(map(float, c)) for c in m.cuts], "importances": m.importances.tolist(), "classes": m.numClasses, "packed": m.packed,
                 "tops": [{k: [str(v.dtype), v.tolist()] for k, v in top.items()} for top in m.tops]}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(path + "/about")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ForestModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        about = json.loads(spark.read.text(path + "/about").first()[0])
        tops = [{k: np.array(v, t) for k, (t, v) in top.items()} for top in about["tops"]]
        m = self.cls._of(path + "/nodes", about["cuts"], tops, np.array(about["importances"]), [tuple(p) for p in about["packed"]], about["classes"], "features")
        DefaultParamsReader.getAndSetParams(m, metadata)
        return m


def forest_path(spark: SparkSession) -> str:
    from tabulon.session import scratch_path
    return scratch_path(spark, f"forest-{uuid.uuid4().hex}")
