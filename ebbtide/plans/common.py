"""Shared helpers of the query modules: rounding of float outputs in both engines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ebbtide.plans.fixtures import NUMERIC_FEATURES


def round_doubles(df: DataFrame, digits: int = 6, floor_mode: bool = False) -> DataFrame:
    """Round every double column (engine-independent comparison of float results).

    ``floor_mode`` rounds as ``floor(x * 10^d + 0.5) / 10^d``: plain IEEE steps
    that give identical bits in every engine, even on decimal ties."""
    scale = float(10 ** digits)

    def rnd(c):
        if floor_mode:
            return (F.floor(F.col(c) * scale + 0.5).cast("double") / scale)
        return F.round(F.col(c), digits)

    return df.select(
        *[rnd(f.name).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields]
    )


def sql_round_replace(cols: Iterable[str] = NUMERIC_FEATURES, digits: int = 6) -> str:
    """DuckDB ``* REPLACE`` list rounding the given double columns."""
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in cols)


def sql_round(cols: Iterable[str], digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in cols)
