"""Data preparation flow: scan → validate → drop → impute → measure.

Each stage is a DataFrame function; the fitted fill values are the only thing
that reaches the driver (one value per column).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon import config as C
from tabulon.operators import clean, profile, validate
from tabulon.operators import counts as VC


@dataclass
class Prepared:
    table: DataFrame
    validation: DataFrame
    drop_report: clean.DropReport
    fill_values: dict
    quality: DataFrame
    describe: DataFrame


def prepare(raw: DataFrame, drop: Sequence[str], numeric: Sequence[str],
            categorical: Sequence[str], required: Sequence[str] = (),
            min_rows: int = 1000, max_missing_share: float = 0.3) -> Prepared:
    """The raw table is scanned once, for its value counts (``operators.counts``):
    checks, fill values, the report before and after and the description of the
    prepared table are all read from them.  The prepared table itself is a lazy
    projection of the raw one; no copy of either is written."""
    dropped, report = clean.drop_listed(raw, drop)
    num = [c for c in numeric if c in dropped.columns]
    cat = [c for c in categorical if c in dropped.columns]
    seen = VC.value_counts(raw, num, cat, [c for c in raw.columns if c not in {*num, *cat}], rows=True)
    summary = VC.missing_of_rows(seen, len(raw.columns))
    checks = validate.validate_summary(summary, raw.columns, min_rows, max_missing_share, required)
    values = VC.fills_of(seen, num, cat, C.UNKNOWN_CATEGORY)
    table = clean.fill(dropped, values)
    after = VC.filled(seen, values)
    kept = VC.missing_by_column(after, dropped.columns).agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("_kept"))
    quality = profile.before_after(summary.crossJoin(F.broadcast(kept)), raw, table, len(report.dropped), F.col("_kept"))   # one row each
    return Prepared(table, checks, report, values, quality, VC.describe_counts(after, num))
