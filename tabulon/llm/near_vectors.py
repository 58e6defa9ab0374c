"""Near-duplicate vectors by random-hyperplane hashing in several tables.

1. Equal vectors of one label are one *class* (smallest id, number of copies);
   only classes are hashed.
2. In each of ``L`` tables a class gets ``b`` sign bits.  ``b`` follows the
   largest label (about ``2^b`` buckets of ``target`` classes each) and ``L`` follows from
   ``b``: a pair at the threshold shares a bucket in some table with
   probability ``1 - (1 - p^b)^L >= recall``, ``p = 1 - acos(threshold) / pi``.
3. A bucket is cut into blocks; every pair of blocks is one task group.  All
   its cosines are one matrix product in double precision, and a pair links
   only when it reaches the threshold.  No pair is written: a group returns,
   per class, how many vectors it links with there and one edge to the smallest
   class it is connected with in the group.  A pair that met in an earlier
   table is not counted again.
4. Connected components of these edges (alternating large-star and small-star).

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label or id, link with nothing: 0 links, their
own component, kept; only vectors of one length are compared; repeated ids give
a row each; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import settled, small_batches
from tabulon.llm.components import connected_components
from tabulon.llm.vectors import code_of, packed_vectors


@dataclass(frozen=True)
class HyperplaneConfig:
    threshold: float = 0.93
    recall: float = 0.999      # for a pair exactly at the threshold
    target: int = 256          # classes in a bucket
    block: int = 1024          # classes in a block
    seed: int = 424243


def tables_for(n: int, cfg: HyperplaneConfig) -> tuple[int, int]:
    """(bits, tables) for labels of up to ``n`` classes."""
    bits = max(2, math.ceil(math.log2(max(n, 2) / cfg.target))) if n > cfg.target else 2
    p = (1 - math.acos(cfg.threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - cfg.recall) / math.log(1 - p)))


def _sign_hashes(code: str, bits: int, n_tables: int, seed: int):
    """Adds one bucket number per table; the planes follow from the seed."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        planes = {}
        for b in batches:
            sig = []
            for v in b.column("vec").to_pylist():
                x = np.frombuffer(v, code).astype(np.float64)
                d = len(x)
                if d not in planes:
                    planes[d] = np.random.Generator(np.random.PCG64([seed, d])).standard_normal((d, n_tables * bits))
                s = ((x / np.abs(x).max()) @ planes[d] >= 0).reshape(n_tables, bits)
                sig.append((s << np.arange(bits)).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sig, pa.list_(pa.int64()))], names=[*b.schema.names, "sig"])
    return run


def _block_links(code: str, cfg: HyperplaneConfig):
    def run(t):
        import numpy as np
        import pyarrow as pa
        n = t.num_rows
        table, lo, hi = (t.column(c)[0].as_py() for c in ("t", "lo", "hi"))
        ids, copies, blk = (t.column(c).to_numpy() for c in ("rep", "copies", "blk"))
        x = np.frombuffer(b"".join(t.column("vec").to_pylist()), code).reshape(n, -1).astype(np.float64)
        x = x / (2.0 ** np.floor(np.log2(np.abs(x).max(axis=1))))[:, None]
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        sig = np.array(t.column("sig").to_pylist(), dtype=np.int64)
        left, right = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        root = np.arange(n)

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i
        links = np.zeros(n, np.int64)
        for s in range(0, len(left), 256):                       # a strip of the product at a time
            a = left[s:s + 256]
            near = (x[a] @ x[right].T) / np.outer(norm[a], norm[right]) >= cfg.threshold
            if lo == hi:
                near &= ids[right][None, :] > ids[a][:, None]
            i, j = np.nonzero(near)
            i, j = a[i], right[j]
            for u, v in zip(i.tolist(), j.tolist()):
                u, v = find(u), find(v)
                if u != v:
                    small, large = (u, v) if ids[u] < ids[v] else (v, u)
                    root[large] = small
            first = ~(sig[i, :table] == sig[j, :table]).any(axis=1) if table else np.ones(len(i), bool)
            np.add.at(links, i[first], copies[j[first]])
            np.add.at(links, j[first], copies[i[first]])
        low = np.array([ids[find(i)] for i in range(n)], np.int64)
        some = (links > 0) | (low != ids)
        return pa.table({"rep": pa.array(ids[some], pa.int64()), "n": pa.array(links[some], pa.int64()), "low": pa.array(low[some], pa.int64())})
    return run


def near_vectors(df: DataFrame, cfg: HyperplaneConfig = HyperplaneConfig(), id_col: str = "vec_id",
                 vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, n_links, component_id and kept for every row of ``df``."""
    small_batches(df.sparkSession)
    code = code_of(df, vector)
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("_e"))
    rows = settled(packed_vectors(base, "_e", ["id", "label"]).withColumn(
        "key", F.when(F.col("id").isNotNull() & F.col("label").isNotNull(), F.unhex(F.md5("vec")))))
    able = rows.where("key is not null")
    # map-side combine takes up a vector that a third of the rows share
    classes = able.groupBy("label", "key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, n_tables = tables_for(largest, cfg)
    hashed = settled(classes.mapInArrow(_sign_hashes(code, bits, n_tables, cfg.seed),
                                        "label string, key binary, rep long, copies long, vec binary, sig array<long>"))
    met = hashed.select("label", F.octet_length("vec").alias("dim"), "rep", F.posexplode("sig").alias("t", "bucket"))
    size = met.groupBy("label", "dim", "t", "bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(cfg.block)).cast("long").alias("nb"),
                                                          F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    full = hashed.select("label", F.octet_length("vec").alias("dim"), "rep", "copies", "vec", "sig", F.posexplode("sig").alias("t", "bucket"))
    full = full.join(size, ["label", "dim", "t", "bucket"]).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")))
    full = full.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    full = full.withColumn("lo", F.least("blk", "_o")).withColumn("hi", F.greatest("blk", "_o"))
    found = settled(full.groupBy("label", "dim", "t", "bucket", "lo", "hi").applyInArrow(_block_links(code, cfg), "rep long, n long, low long"))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = connected_components(found.select(F.col("low").alias("u"), F.col("rep").alias("v")))
    whole = (classes.select("label", "key", "rep", "copies").join(links, "rep", "left")
             .join(comp, F.col("rep") == F.col("node"), "left")
             .select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    out = rows.select("id", "label", "key").join(whole, ["label", "key"], "left")
    cid = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), cid.alias("component_id"),
                      F.coalesce(cid == F.col("id"), F.lit(True)).alias("kept"))
