"""Connected components by alternating large-star and small-star.

*Large-star* links each larger neighbour of a node to the smallest node of its
neighbourhood (the node included), *small-star* does so for its smaller
neighbours.  Components are kept, every node moves to a smaller one, and the
table ends as stars around the smallest node of each component.

Before the first round and after each one, union-find turns every chunk of
edges that lies in one task into stars, without a shuffle: a component whose
edges lie together is done at once, and a round has at most one edge per node
and chunk.

A neighbourhood is never gathered: its minimum is an aggregate with map-side
combine, and new edges come from a join back on the node.  Nodes of more than
``edges / HOT_NODES`` edges (at most ``2 * HOT_NODES`` of them, whatever the
input) get their minimum by broadcast, so a hot centre stays spread over the
tasks that hold its edges.  Each round is a checkpoint in the shared folder, in
as many pieces as its edges need.

Defined results: null ends and loops are no edges; repeated edges count once; an
empty table gives no rows.
"""

from __future__ import annotations

from typing import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import partitions, settled

#: edges of a task's share of a round, and of a chunk of union-find
TASK_EDGES, CHUNK_EDGES = 250_000, 1_000_000
#: a node with more than this share of all edges is hot; a floor keeps small tables plain
HOT_NODES, HOT_FLOOR = 5_000, 10_000


def _stars_of_chunks(batches: Iterable) -> Iterator:
    """Each chunk of edges as stars: every node to the smallest it is linked to."""
    import pyarrow as pa
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars():
        pairs = [(x, find(x)) for x in root]
        u, v = zip(*((x, r) for x, r in pairs if x != r))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    held = 0
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(root.setdefault(x, x)), find(root.setdefault(y, y))
            root[max(x, y)] = min(x, y)
        held += b.num_rows
        if held >= CHUNK_EDGES:
            yield stars()
            root.clear()
            held = 0
    if root:
        yield stars()


def _contracted(edges: DataFrame) -> DataFrame:
    return settled(edges.mapInArrow(_stars_of_chunks, "u long, v long"))


def _pieces(edges: int, most: int) -> int:
    return max(1, min(most, -(-edges // TASK_EDGES)))


def _star(edges: DataFrame, smaller: bool, hot_over: int) -> DataFrame:
    """edges (u, v).  Large-star: all neighbours of u, those above u move to the
    minimum.  Small-star: neighbours of u not above it, they and u move."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.where("v < u") if smaller else both
    low = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    hot = F.broadcast(low.where(F.col("n") > hot_over).select("u", "m"))
    moves = near if smaller else near.where("v > u")
    met = moves.join(hot.select("u"), "u", "left_anti").join(low.select("u", "m"), "u").unionByName(moves.join(hot, "u"))
    moved = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if smaller:
        moved = moved.unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is
    its smallest node.  Null ends and loops are no edges; nodes without an edge
    are absent.  Repeats until the table is a set of stars, without a limit."""
    most = partitions(edges.sparkSession)
    e = settled(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).dropna().where("u <> v"))
    k = _pieces(e.count(), most)
    e = _contracted(e.coalesce(k))
    while True:
        n = e.count()
        k = _pieces(n, most)
        e = e.coalesce(k)
        # stars: every node leads down to one node, which leads nowhere itself
        ends = e.select(F.col("u").alias("node"), "v").unionByName(e.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
        seen = ends.groupBy("node").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("n"), F.count("v").alias("up"))
        if seen.where("a <> b or (up > 0 and up < n)").isEmpty():
            break
        hot_over = max(HOT_FLOOR, n // HOT_NODES)
        large = _star(e, False, hot_over).coalesce(k)
        e = _contracted(_star(large, True, hot_over).distinct().coalesce(k))
    e = e.distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
