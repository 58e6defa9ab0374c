"""Replaying a supplied table as a stream source (for the registered queries
and tests; a deployment reads its own source)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import scalar as S

#: files of one slice; also the files that a replayed micro-batch takes
FILES = 4


def stage_in_time_order(df: DataFrame, ts: str, path: str, slices: int = 6, fmt: str = "parquet",
                        closing: DataFrame | None = None) -> str:
    """Write ``df`` as ``slices`` successive appends in time order, so a file
    source replays it as ordered micro-batches (the way data arrives); then the
    ``closing`` rows, which move the watermark past the last window."""
    rng = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    if rng["lo"] is None:
        df.limit(0).write.mode("overwrite").format(fmt).save(path)
        return path
    lo, hi = rng["lo"], rng["hi"]
    step = (hi - lo) / slices
    dt = df.schema[ts].dataType
    for i in range(slices):
        a = S.typed_lit(lo + step * i, dt)
        b = S.typed_lit(lo + step * (i + 1), dt)
        last = i == slices - 1
        part = df.where(((F.col(ts) >= a) | F.lit(i == 0)) & ((F.col(ts) < b) | F.lit(last)))
        part.repartition(FILES).write.mode("append").format(fmt).save(path)
    if closing is not None:
        closing.write.mode("append").format(fmt).save(path)
    return path


def closing_row(df: DataFrame, ts: str, days: int = 60) -> DataFrame:
    """One row of nulls, ``days`` after the last: it closes every open window."""
    kind = df.schema[ts].dataType
    last = df.agg(F.max(ts).alias("_m"))                     # one row
    return last.select(*[(F.col("_m") + F.make_interval(days=F.lit(days))).cast(kind).alias(f.name) if f.name == ts
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
