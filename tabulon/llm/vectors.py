"""Reading embedding columns in Python workers."""

from __future__ import annotations

from typing import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def packed_vectors(df: DataFrame, vector: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus ``vec``: the vector as little-endian bytes of its own
    element type (float or double), null when it is null, empty, zero or holds a
    null or non-finite component.  Minus zero becomes zero, so equal vectors have
    equal bytes."""
    kind = df.schema[vector].dataType
    wide = not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType))
    item = "double" if wide else "float"
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vector}`").cast(f"array<{item}>").alias("_v"))
    out = src.drop("_v").schema.add("vec", T.BinaryType())
    width = len(keep)

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa
        code = "<f8" if wide else "<f4"
        for b in batches:
            lists = b.column(width)
            flat = lists.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(code) + 0.0   # nulls become NaN; -0 becomes 0
            values = values.astype(code)
            ends = np.cumsum([0 if n is None else n for n in lists.value_lengths().to_pylist()])
            vec, at = [], 0
            for e in ends.tolist():
                v = values[at:e]
                vec.append(v.tobytes() if e > at and np.isfinite(v).all() and v.any() else None)
                at = e
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(vec, pa.binary())], names=out.names)

    return src.mapInArrow(run, out)


def code_of(df: DataFrame, vector: str) -> str:
    """numpy type of the packed components."""
    kind = df.schema[vector].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
