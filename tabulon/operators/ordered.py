"""Ordered scans that stay distributed.

A window ordered over a whole table without ``partitionBy`` runs in a single
task.  KS, Wasserstein, ROC AUC, average precision, curve points, exact
quantiles and stratified ranks all need such cumulative sums, so they go
through the two-level form here:

1. the caller pre-aggregates to one row per distinct (group, order value);
2. rows are cut into range buckets whose bounds come from ``percentile_approx``
   per group (or from a caller-supplied monotone bucket column);
3. a window partitioned by (group, bucket) gives local running sums;
4. bucket totals (at most ``groups x buckets`` rows) are turned into offsets
   and joined back.

Buckets only group the sort, so the result is exact.  What is broadcast is
bounded by ``groups x n_buckets`` rows; callers pass ``groups_bounded`` only
when the groups are columns, models or classes (not data keys).

Two more scans take the same two levels: ``first_after`` (a reverse running
minimum with a carry between ranges, for as-of matches by data key) and
``lagged`` / ``trailing`` (the previous row, and a range frame with halo rows,
over buckets of an order column).  ``row_numbers`` needs no window at all.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.config import DEFAULT_SCALE

_UNB = Window.unboundedPreceding

#: rows that a table of bounds or offsets may have to be broadcast
BROADCAST_ROWS = 200_000


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table that several branches read: a reliable
    checkpoint into the shared ``spark.checkpoint.dir``.  Used for
    distinct-value tables, so the source is scanned once and a lost executor
    re-reads the checkpoint instead of the source."""
    from tabulon.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _maybe_broadcast(df: DataFrame, bounded: bool) -> DataFrame:
    return F.broadcast(df) if bounded else df


def _bounds_below(bounds: str, value: str, most: int) -> Column:
    """Number of ascending ``bounds`` (``most`` at most) below a value, by bisection:
    a row meets log2 of the bounds and not each of them."""
    steps = [1 << i for i in reversed(range(max(1, most.bit_length())))]
    further = lambda at, step: at + F.when(F.get(bounds, at + step - 1) < F.col(value), step).otherwise(0)
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), further)


def running_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                 group_cols: Sequence[str] = (), descending: bool = False,
                 bucket_col: str | None = None, tiebreak: Sequence[str] = (),
                 n_buckets: int | None = None, groups_bounded: bool | None = True,
                 with_totals: bool = False) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` ordered by ``order_col`` per group.

    Adds ``<c>_run`` for every sum column and ``next_value``: the following
    order value in the group (null on the last row); with ``with_totals``
    also ``<c>_total``, the group total.  ``df`` should hold one
    row per (group, order value) unless ``tiebreak`` names a full key.

    ``groups_bounded`` says that groups are columns, models or classes, whose
    bounds and offsets may be broadcast; None counts the groups of ``df`` (settled)
    first and broadcasts only up to ``BROADCAST_ROWS`` rows.
    """
    n_buckets = n_buckets or DEFAULT_SCALE.buckets_per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = list(group_cols)
    if groups_bounded is None:
        most = max(1, BROADCAST_ROWS // n_buckets)
        groups_bounded = not g or df.select(*g).distinct().limit(most + 1).count() <= most
    d = df
    if not g:
        d = d.withColumn("_g", F.lit(0))
        g = ["_g"]
    ordv = -F.col(order_col) if descending else F.col(order_col)
    d = d.withColumn("_o", ordv)
    if bucket_col is None:
        probs = [i / n_buckets for i in range(1, n_buckets)]
        bounds = d.groupBy(*g).agg(
            F.percentile_approx("_o", probs, DEFAULT_SCALE.quantile_accuracy)
            .alias("_bounds"))
        d = (d.join(_maybe_broadcast(bounds, groups_bounded or not group_cols), g)
             .withColumn("_bk", F.when(F.col("_bounds").isNotNull(), _bounds_below("_bounds", "_o", n_buckets - 1)))
             .drop("_bounds"))
    else:
        d = d.withColumn("_bk", F.col(bucket_col))

    order = [F.col("_o")] + [F.col(c) for c in tiebreak]
    w = Window.partitionBy(*g, "_bk").orderBy(*order)
    wrun = w.rowsBetween(_UNB, Window.currentRow)
    local = d.select(
        "*",
        *[F.sum(c).over(wrun).alias(f"_l_{c}") for c in sum_cols],
        F.lead(order_col).over(w).alias("_lnext"),
    )
    totals = d.groupBy(*g, "_bk").agg(
        *[F.sum(c).alias(f"_t_{c}") for c in sum_cols],
        F.min_by(order_col, F.struct(*order)).alias("_bfirst"),
    )
    wb = Window.partitionBy(*g).orderBy("_bk")
    wg = Window.partitionBy(*g)
    offsets = totals.select(
        *g, "_bk",
        *[F.coalesce(F.sum(f"_t_{c}").over(wb.rowsBetween(_UNB, -1)), F.lit(0))
          .alias(f"_off_{c}") for c in sum_cols],
        *[F.sum(f"_t_{c}").over(wg).alias(f"_tot_{c}") for c in sum_cols],
        F.lead("_bfirst").over(wb).alias("_nfirst"),
    )
    out = local.join(_maybe_broadcast(offsets, groups_bounded or not group_cols),
                     g + ["_bk"])
    out = out.select(
        *[c for c in df.columns],
        *[(F.col(f"_l_{c}") + F.col(f"_off_{c}")).alias(f"{c}_run") for c in sum_cols],
        *([F.col(f"_tot_{c}").alias(f"{c}_total") for c in sum_cols] if with_totals else []),
        F.coalesce("_lnext", "_nfirst").alias("next_value"),
    )
    return out


def exact_quantiles(long_df: DataFrame, value_col: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), groups_bounded: bool | None = True
                    ) -> DataFrame:
    """Exact quantiles with linear interpolation (like ``percentile``).

    Works on distinct-value counts, so the result needs no single task to
    hold all values.  Each distinct value knows the rank range it covers
    (running count) and the group size, so the rows holding the lower and
    upper neighbour of every quantile position are found by a per-row test
    and reduced in one aggregate - no join.  Returns (group..., q, value);
    groups with no non-null value are absent.
    """
    vals = long_df.where(F.col(value_col).isNotNull() & ~F.isnan(value_col))
    counts = materialize(vals.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_n")))
    return quantiles_of_counts(counts, value_col, "_n", probs, group_cols, groups_bounded)


def quantiles_of_counts(counts: DataFrame, value_col: str, n_col: str, probs: Sequence[float],
                        group_cols: Sequence[str] = (), groups_bounded: bool | None = True) -> DataFrame:
    """``exact_quantiles`` of a settled table of values and how often each occurs
    (a value may have several rows)."""
    g = list(group_cols)
    c = counts.select(*g, F.col(value_col).alias("_v"), F.col(n_col).alias("_n"))
    run = running_sums(c, "_v", ["_n"], g, groups_bounded=groups_bounded, with_totals=True)
    prev = F.col("_n_run") - F.col("_n")
    aggs, covers_any = [], F.lit(False)
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        c_lo = (prev <= lo) & (lo < F.col("_n_run"))
        c_hi = (prev <= hi) & (hi < F.col("_n_run"))
        covers_any = covers_any | c_lo | c_hi
        v = F.col("_v").cast("double")
        aggs += [F.max(F.when(c_lo, v)).alias(f"_lo{i}"), F.max(F.when(c_hi, v)).alias(f"_hi{i}"),
                 F.max(pos - lo).alias(f"_fr{i}")]
    red = run.where(covers_any).groupBy(*g).agg(*aggs)
    structs = [F.struct(F.lit(float(p)).alias("q"),
                        (F.col(f"_lo{i}") + F.col(f"_fr{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
                        .alias("value")) for i, p in enumerate(probs)]
    return red.select(*g, F.inline(F.array(*structs)))


def hash_order(seed: int, key: Column | str) -> Column:
    """Deterministic pseudo-random order key: md5(seed ':' key) as hex text.

    DuckDB's ``md5`` returns the same text, so oracle queries can use it.
    """
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), k.cast("string")))


def strata_ranks(df: DataFrame, strata_col: str, key_col: str, seed: int,
                 digits: int | None = None) -> DataFrame:
    """Adds ``_rank`` (1-based row number within the stratum in hash order)
    and ``_n_stratum``, without sending a whole stratum to one task.

    The md5 hex is uniform, so its first ``digits`` hex digits form balanced
    buckets; a hot stratum is split over ``16**digits`` tasks.
    """
    digits = digits or DEFAULT_SCALE.rank_hash_digits
    d = (df.withColumn("_h", hash_order(seed, key_col))
         .withColumn("_hb", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int"))
         .withColumn("_one", F.lit(1)))
    run = running_sums(d, "_h", ["_one"], [strata_col], bucket_col="_hb",
                       tiebreak=[key_col], groups_bounded=False, with_totals=True)
    out = run.withColumnRenamed("_one_run", "_rank").withColumnRenamed("_one_total", "_n_stratum")
    return out.drop("_h", "_hb", "_one", "next_value")


def top_n_per_key(df: DataFrame, key_cols: Sequence[str], order: Sequence[Column],
                  n: int) -> DataFrame:
    """First ``n`` rows per key in ``order`` (a full, deterministic order),
    numbered in ``rank``.

    ``row_number() <= n`` lets Spark insert a map-side ``WindowGroupLimit``
    before the exchange, so each task ships at most ``n`` rows per key and a
    hot key reaches its final task as ``n x partitions`` rows, not all rows.
    """
    w = Window.partitionBy(*key_cols).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def key_ranges(df: DataFrame, key: str, order_col: str, per_range: int | None = None) -> DataFrame | None:
    """(key, _bounds): ascending bounds that cut the rows of every heavy key into
    ranges of about ``per_range`` rows; None when no key is heavy.

    Without ``per_range`` a key is heavy above a quarter of a task's fair share,
    so there are at most ``4 x partitions`` heavy keys and twice as many bounds
    over all of them, however large the table: small enough to broadcast."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    if per_range is None:
        total, most = counts.agg(F.sum("_n"), F.max("_n")).first()              # two scalars
        per_range = max(DEFAULT_SCALE.range_rows, (total or 0) // (4 * parts))
        if (most or 0) <= per_range:
            return None
    heavy = counts.where(F.col("_n") > per_range)
    k = min(4096, 4 * parts + 1) if per_range >= DEFAULT_SCALE.range_rows else 4096
    probs = [i / k for i in range(1, k)]
    q = (df.join(F.broadcast(heavy), key).groupBy(key).agg(
        F.max("_n").alias("_n"), F.percentile_approx(order_col, probs, DEFAULT_SCALE.quantile_accuracy).alias("_q")))
    ranges = F.least(F.ceil(F.col("_n") / F.lit(per_range)), F.lit(k)).cast("int")
    picks = F.transform(F.sequence(F.lit(1), ranges - 1), lambda i: F.get("_q", (i * F.lit(k) / ranges).cast("int") - 1))
    return q.where(ranges > 1).select(key, F.array_distinct(picks).alias("_bounds"))


def _range_of(bounds: str, value: str, step: int = 64) -> Column:
    """Number of bounds below a value: whole steps first, then inside one."""
    coarse = F.size(F.filter(bounds, lambda b, i: ((i + 1) % step == 0) & (b < F.col(value))))
    fine = F.size(F.filter(F.slice(bounds, coarse * step + 1, step), lambda b: b < F.col(value)))
    return coarse * step + fine


def first_after(df: DataFrame, key: str, order_col: str, target: str, per_range: int | None = None) -> DataFrame:
    """Adds ``first_after``: the smallest ``target`` struct among the rows of the
    same key at or after the row's own ``order_col`` (a number).

    ``target`` is null on rows that are no target, and begins with the order value.
    A heavy key is cut into ranges of the order column by count, not by time: in a
    range the answer is a running minimum from its end; where a range has none, it
    is the first target of the later ranges, a reverse minimum over one row per
    range.  Rows without a key or an order value are left out; the rows of one key
    at one instant stay together."""
    d = df.where(F.col(key).isNotNull() & F.col(order_col).isNotNull())
    bounds = key_ranges(d, key, order_col, per_range)
    back = lambda *by: Window.partitionBy(*by).orderBy(F.col(order_col).desc()).rangeBetween(_UNB, 0)
    if bounds is None:
        return d.withColumn("first_after", F.min(target).over(back(key)))
    bounds = F.broadcast(materialize(bounds))
    d = d.join(bounds, key, "left").withColumn(
        "_bk", F.when(F.col("_bounds").isNull(), 0).otherwise(_range_of("_bounds", order_col)))
    firsts = d.where(F.col("_bounds").isNotNull() & F.col(target).isNotNull()).groupBy(key, "_bk").agg(F.min(target).alias("_f"))
    grid = bounds.select(key, F.explode(F.sequence(F.lit(0), F.size("_bounds"))).alias("_bk"))
    later = Window.partitionBy(key).orderBy(F.col("_bk").desc()).rowsBetween(_UNB, -1)
    carry = grid.join(firsts, [key, "_bk"], "left").select(key, "_bk", F.min("_f").over(later).alias("_carry"))
    local = d.select("*", F.min(target).over(back(key, "_bk")).alias("_local")).drop("_bounds")
    return (local.join(F.broadcast(carry), [key, "_bk"], "left")       # one row per range of a heavy key
            .withColumn("first_after", F.coalesce("_local", "_carry")).drop("_bk", "_local", "_carry"))


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """1-based row numbers in a stated order, without a window: rows are sorted by
    range partitioning and settled, so numbers repeat on every read; a row's number
    is its place in its partition after the sizes of the partitions before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    d = d.withColumn("_id", F.monotonically_increasing_id())       # partition << 33 | place
    part = F.shiftright("_id", 33).cast("int")
    sizes = d.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))      # one row per partition
    before = Window.orderBy("_p").rowsBetween(_UNB, -1)
    first = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    out = d.withColumn("_p", part).join(F.broadcast(first), "_p")
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, F.col("_first") + place + 1).drop("_id", "_p", "_first")


def _bucket(order_col: str, width: int) -> Column:
    return F.floor(F.col(order_col) / F.lit(width)).cast("long")


def lagged(df: DataFrame, order_col: str, columns: Sequence[str], group_cols: Sequence[str] = (), width: int = 1 << 20) -> DataFrame:
    """Adds ``previous_<c>``: the values of the row before in ``order_col`` (a
    number, distinct in its group), over buckets of ``width``.  The first row of a
    bucket gets the last row of the nearest earlier one; only such last rows, one
    per (group, bucket), meet in a window of their group."""
    g = list(group_cols)
    if not columns:
        return df
    d = df.withColumn("_bk", _bucket(order_col, width))
    row = F.struct(*[F.col(c).alias(c) for c in columns])
    local = F.lag(row).over(Window.partitionBy(*g, "_bk").orderBy(order_col))
    tails = d.groupBy(*g, "_bk").agg(F.max_by(row, order_col).alias("_tail"))
    heads = tails.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], F.col("_bk").alias("_b"),
                         F.lag("_tail").over(Window.partitionBy(*(g or [F.lit(0)])).orderBy("_bk")).alias("_carry"))
    same = F.col("_bk") == F.col("_b")
    for i, c in enumerate(g):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = d.withColumn("_prev", local).join(heads, same, "left").withColumn("_prev", F.coalesce("_prev", "_carry"))
    return out.select(*df.columns, *[F.col(f"_prev.{c}").alias(f"previous_{c}") for c in columns])


def trailing(df: DataFrame, order_col: str, back: int, aggs: dict, group_cols: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Adds aggregates over the rows whose ``order_col`` (a whole number) lies in
    ``[own - back, own]``, by (group, bucket) with halo rows: a row in the last
    ``back`` of a bucket is also sent to the next one, where it is seen and not
    returned.  ``aggs`` maps a new name to an aggregate."""
    g = list(group_cols)
    width = max(width or 0, back + 1, 1)
    d = df.withColumn("_own", _bucket(order_col, width))
    reach = F.floor((F.col(order_col) + F.lit(back)) / F.lit(width)).cast("long")
    d = d.withColumn("_bk", F.explode(F.sequence("_own", reach)))
    w = Window.partitionBy(*g, "_bk").orderBy(order_col).rangeBetween(-back, 0)
    return (d.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
            .where("_bk = _own").drop("_bk", "_own"))
