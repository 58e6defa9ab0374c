"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch.  Texts are read whole, so the batch is kept short.
BATCH_ROWS = 512


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Make this package importable on executors; and Python workers see at most ``rows`` whole texts at once (a batch of the
    default 10,000 long texts would not fit beside the executor's heap)."""
    from tabulon.session import ship_package
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """A table that several later steps read: a reliable checkpoint in the
    shared folder, so a lost executor costs a re-read and not a re-run."""
    from tabulon.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: F.Column) -> F.Column:
    """A-Z to a-z and nothing else (``lower`` would follow the locale tables)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def no_clash(keep, *added: str) -> None:
    """``keep`` may not hold a name that the operator adds."""
    both = {c.lower() for c in keep} & {a.lower() for a in added}
    if both:
        raise ValueError(f"columns to keep clash with added columns: {sorted(both)}")


def as_row(df: DataFrame) -> F.Column:
    """All columns as one struct, so that no name of theirs can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def written(df: DataFrame, name: str) -> DataFrame:
    """A table that later steps read, as Parquet in the shared folder: smaller
    than a checkpoint, and its size tells the planner which joins may broadcast."""
    import uuid

    from tabulon.session import scratch_path
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
