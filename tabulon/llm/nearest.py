"""Nearest neighbours by a block matrix join with int8 tiles.

The query set and the candidates are dealt into blocks by a hash of the id;
every (query block, candidate block) cell is one task group of bounded size.  In
a cell the unit vectors are quantised to int8 with one scale per vector, and one
integer tile product gives all approximate cosines.  With ``x = s q + e`` the
error of a product is at most ``|e_x| |s_y q_y| + |e_y|``, so every cosine has a
lower and an upper bound.  A pair survives when its upper bound reaches the
k-th largest lower bound of its query; survivors are recomputed from the
original vectors in double precision and go through a heap of k.  The cells'
short lists are merged by heaps, one per query.

Equal vectors have equal cosines, and ties go to the smaller id, so of each
distinct vector only its k + 1 smallest ids can be among k results (one of them
may be the query itself).  The others are left out before the join; this drops
no result and keeps a vector shared by a third of the rows from filling tiles.

The product of queries and candidates is the stated query set against all rows;
the result is exact, so recall is 1.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part on either side; only vectors of one length are
compared; rows with a null id take no part; repeated ids count as one candidate
by the best of their vectors; an empty table gives an empty table.
"""

from __future__ import annotations

from typing import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import settled, small_batches
from tabulon.llm.vectors import code_of, packed_vectors
from tabulon.operators.ordered import top_n_per_key

#: rows of one side of a cell
BLOCK = 1024


def _quantise(x):
    """int8 codes, scales, exact error norms and norms of the quantised rows."""
    import numpy as np
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(x - back, axis=1), np.linalg.norm(back, axis=1)


def _tile(code: str, k: int):
    """The k best candidates of every query of one cell."""
    def run(t):
        import heapq

        import numpy as np
        import pyarrow as pa
        ids = t.column("vec_id").to_numpy()
        is_q = t.column("is_query").to_numpy(zero_copy_only=False)
        raw = np.frombuffer(b"".join(t.column("vec").to_pylist()), code).reshape(len(ids), -1).astype(np.float64)
        # scaled first, so that no square over- or underflows
        unit = raw / np.abs(raw).max(axis=1)[:, None]
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        qi, ci = np.flatnonzero(is_q), np.flatnonzero(~is_q)
        found = {"query_id": [], "vec_id": [], "score": []}
        if len(qi) and len(ci):
            q8, qs, qe, _ = _quantise(unit[qi])
            c8, cs, ce, cn = _quantise(unit[ci])
            exact = np.float32 if 127 * 127 * unit.shape[1] < 2**24 else np.float64   # integer sums stay exact
            tile = (q8.astype(exact) @ c8.astype(exact).T).astype(np.float64) * qs[:, None] * cs[None, :]
            err = qe[:, None] * cn[None, :] + ce[None, :] + 1e-12
            own = ids[qi][:, None] == ids[ci][None, :]
            low = np.where(own, -np.inf, tile - err)
            names = np.unique(ids[ci])
            if len(names) < len(ci):                       # several vectors of one id: its best one counts
                order = np.argsort(ids[ci], kind="stable")
                starts = np.searchsorted(ids[ci][order], names)
                low = np.maximum.reduceat(low[:, order], starts, axis=1)
            n = min(k, low.shape[1])
            cut = np.partition(low, low.shape[1] - n, axis=1)[:, low.shape[1] - n]
            keep = (tile + err >= cut[:, None]) & ~own
            for r in range(len(qi)):
                cand = np.flatnonzero(keep[r])
                if not len(cand):
                    continue
                # one row at a time in the same order: equal vectors get equal scores in every cell
                score = _cosines(raw[qi[r]], raw[ci[cand]])
                per: dict[int, float] = {}
                for i, x in zip(ids[ci[cand]].tolist(), score.tolist()):
                    per[i] = max(x, per.get(i, x))
                best = heapq.nsmallest(k, ((-x, i) for i, x in per.items()))
                found["query_id"] += [int(ids[qi[r]])] * len(best)
                found["vec_id"] += [i for _, i in best]
                found["score"] += [-s for s, _ in best]
        return pa.table({"query_id": pa.array(found["query_id"], pa.int64()), "vec_id": pa.array(found["vec_id"], pa.int64()),
                         "score": pa.array(found["score"], pa.float64())})
    return run


def _cosines(q, rows):
    import numpy as np
    sq, sr = np.abs(q).max(), np.abs(rows).max(axis=1)
    # a power of two leaves every digit as it is and keeps squares in range
    q = q / 2.0 ** np.floor(np.log2(sq))
    rows = rows / (2.0 ** np.floor(np.log2(sr)))[:, None]
    dots = np.einsum("ij,j->i", rows, q)
    return dots / (np.sqrt(np.einsum("j,j->", q, q)) * np.sqrt(np.einsum("ij,ij->i", rows, rows)))


def _merge(k: int):
    """Heaps of the k best per query, over one partition's queries."""
    def run(batches: Iterable) -> Iterator:
        import heapq

        import pyarrow as pa
        heaps: dict[int, list] = {}
        for b in batches:
            for q, v, s in zip(*(b.column(i).to_pylist() for i in range(3))):
                h = heaps.setdefault(q, [])
                if any(v == -w for _, w in h):              # a repeated id: its best vector counts
                    h[:] = [(max(x, s), w) if -w == v else (x, w) for x, w in h]
                    heapq.heapify(h)
                elif len(h) < k:
                    heapq.heappush(h, (s, -v))
                else:
                    heapq.heappushpop(h, (s, -v))
        out = [(q, r, -v, s) for q, h in heaps.items() for r, (s, v) in enumerate(sorted(h, reverse=True), 1)]
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))],
                                         names=["query_id", "rank", "vec_id", "score"])
    return run


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
            block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score (cosine): the ``k`` nearest rows of each
    row for which ``is_query`` holds."""
    small_batches(df.sparkSession)
    code = code_of(df, vector)
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(is_query, F.lit(False)).alias("_q"),
                     F.col(f"`{vector}`").alias("_e"))
    rows = packed_vectors(base, "_e", ["_id", "_q"])
    rows = settled(rows.where("vec is not null and _id is not null")
                   .select(F.col("_id").alias("vec_id"), F.col("_q").alias("is_query"), "vec").distinct())
    n_q, n = rows.agg(F.count_if("is_query"), F.count(F.lit(1))).first()
    n_q, n = max(1, -(-n_q // block)), max(1, -(-n // block))
    cand = top_n_per_key(rows.select("vec_id", "vec"), ["vec"], [F.col("vec_id")], k + 1).drop("rank")
    spread = F.xxhash64("vec_id")
    cells_q = (rows.where("is_query").select("vec_id", "vec", F.pmod(spread, F.lit(n_q)).alias("qb"))
               .withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("is_query", F.lit(True)))
    cells_c = (cand.select("vec_id", "vec", F.pmod(spread, F.lit(n)).alias("cb"))
               .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long")))).withColumn("is_query", F.lit(False)))
    cells = cells_q.unionByName(cells_c).withColumn("dim", F.octet_length("vec"))
    lists = cells.groupBy("qb", "cb", "dim").applyInArrow(_tile(code, k), "query_id long, vec_id long, score double")
    return lists.repartition("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
