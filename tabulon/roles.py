"""Column roles: which columns are key, target, prediction, numeric, categorical."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


@dataclass(frozen=True)
class ColumnRoles:
    key: str | None = None
    target: str | None = None
    prediction: str | None = None
    score: str | None = None
    timestamp: str | None = None
    numeric: tuple[str, ...] = field(default_factory=tuple)
    categorical: tuple[str, ...] = field(default_factory=tuple)

    @classmethod
    def infer(cls, df: DataFrame, key=None, target=None, prediction=None,
              score=None, timestamp=None) -> "ColumnRoles":
        """Numeric and string columns by type, excluding the named roles."""
        special = {c for c in (key, target, prediction, score, timestamp) if c}
        return cls(key=key, target=target, prediction=prediction, score=score,
                   timestamp=timestamp,
                   numeric=tuple(numeric_columns(df, special)),
                   categorical=tuple(string_columns(df, special)))

    def present_in(self, *dfs: DataFrame) -> "ColumnRoles":
        """Restrict feature roles to columns present in every table."""
        def keep(cols):
            return tuple(c for c in cols if all(c in d.columns for d in dfs))
        return replace(self, numeric=keep(self.numeric),
                       categorical=keep(self.categorical))

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical
