"""Splits, folds, samples and last-N views (WIN1-3, WIN5, SMP1-2).

Row membership is decided by ``md5(seed ':' key)``, so it is the same on every
run, on every engine that has md5, and after any executor loss.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.operators.ordered import hash_order, row_numbers, strata_ranks, top_n_per_key


def stratified_split(df: DataFrame, strata: str, key: str, test_pct: int = int(C.TEST_SIZE * 100),
                     seed: int = C.RANDOM_SEED) -> DataFrame:
    """WIN2: exact stratified split; adds ``split`` = 'train' / 'test'.

    Within each stratum rows are ranked in hash order (distributed ranks, a
    hot class is spread over hash buckets); the last ceil(n·pct/100) ranks
    are the test rows.
    """
    r = strata_ranks(df, strata, key, seed)
    n_test = F.expr(f"(_n_stratum * {test_pct} + 99) div 100")
    return r.withColumn("split", F.when(F.col("_rank") <= F.col("_n_stratum") - n_test, "train")
                        .otherwise("test")).drop("_rank", "_n_stratum")


def stratified_folds(df: DataFrame, strata: str, key: str, k: int = C.CV_FOLDS,
                     seed: int = C.RANDOM_SEED) -> DataFrame:
    """WIN3: ``fold`` = (rank - 1) mod k within the stratum; fold sizes per
    class differ by at most one.  Usable as ``CrossValidator(foldCol=...)``."""
    r = strata_ranks(df, strata, key, seed)
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_n_stratum")


def hash_split(df: DataFrame, key: str, test_pct: int = int(C.TEST_SIZE * 100),
               seed: int = C.RANDOM_SEED) -> DataFrame:
    """WIN2 (approximate shares, no shuffle): test when the hash falls in the
    last ``test_pct`` percent; a pure map over the rows."""
    h = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long")
    return df.withColumn("split", F.when(h % 100 < 100 - test_pct, "train").otherwise("test"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = C.RANDOM_SEED) -> DataFrame:
    """SMP1: ``n`` rows in seeded hash order (top-n per partition, then merged)."""
    return df.orderBy(hash_order(seed, key), F.col(key)).limit(n)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """SMP2: first ``n`` rows by an explicit key."""
    return df.orderBy(F.col(key)).limit(n)


def last_n(df: DataFrame, ts: str, id_col: str, n: int) -> DataFrame:
    """WIN1 (global): newest ``n`` rows, ties by id - a TakeOrderedAndProject."""
    return df.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(n)


def last_n_per_key(df: DataFrame, key: str, ts: str, id_col: str, n: int) -> DataFrame:
    """WIN1 (per key): newest ``n`` rows of each key (map-side group limit)."""
    return top_n_per_key(df, [key], [F.col(ts).desc(), F.col(id_col).desc()], n)


def global_row_number(df: DataFrame, order_col: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """1-based row number over the whole table in ``order_col`` order, by range
    partitioning and partition sizes (``ordered.row_numbers``).

    Rows of equal order value are ordered by ``tiebreak``, by default all other
    columns, so they are split over tasks and numbered alike on every run."""
    rest = list(tiebreak) or [c for c in df.columns if c != order_col]
    return row_numbers(df, [F.col(f"`{c}`") for c in (order_col, *rest)])


def batch_ids(df: DataFrame, order_col: str, prefix: str = "batch_", tiebreak: Sequence[str] = ()) -> DataFrame:
    """WIN5: ``batch_{i}`` with i = position - 1 in a stated key order."""
    r = global_row_number(df, order_col, tiebreak)
    return r.withColumn("item_id", F.concat(F.lit(prefix), (F.col("row_number") - 1).cast("string")))
