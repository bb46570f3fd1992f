"""Variance inflation factors from one Gram-matrix pass (M7) and the iterative
VIF column dropper (M8).

VIF of column i regressed on the others WITHOUT an intercept (uncentred R^2):
    VIF_i = 1 / (1 - R_i^2) = G_ii / RSS_i,   RSS_i = G_ii - g_i' G_-i^-1 g_i
where G = X'X.  One distributed pass computes G (d(d+1)/2 sums, partial
aggregation per task); everything after is d x d algebra on the driver.
Dropping a column removes a row and column of G, so the iterative dropper
needs no rescan and no sampling.  Columns holding any NULL are left out of the
VIF computation (but kept in the output), as in the reference.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType, StringType, StructField, StructType

from ebbtide.functions.scalar import is_missing
from ebbtide.operators.stages import JsonEstimator, StateModel


def gram_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Upper triangle of X'X as a long table (a, b, g).

    Each task multiplies its Arrow batches with NumPy (X_p' X_p, BLAS) and emits
    d(d+1)/2 partial sums; one small grouped sum adds the partitions.  The data
    never leaves its task; only d^2 numbers per task are shuffled."""
    cols = list(cols)
    d = len(cols)
    iu = np.triu_indices(d)

    def partial(batches):
        acc = np.zeros((d, d))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            acc += x.T @ x
        yield pd.DataFrame({"i": iu[0].astype("int32"), "j": iu[1].astype("int32"), "g": acc[iu]})

    x = df.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(cols)])
    parts = x.mapInPandas(partial, "i int, j int, g double")
    summed = parts.groupBy("i", "j").agg(F.sum("g").alias("g"))
    names = F.array(*[F.lit(c) for c in cols])
    return summed.select(
        F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), "g"
    )


def gram_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    cols = list(cols)
    idx = {c: i for i, c in enumerate(cols)}
    g = np.zeros((len(cols), len(cols)))
    for r in gram_long(df, cols).collect():  # d(d+1)/2 numbers
        i, j = idx[r["a"]], idx[r["b"]]
        g[i, j] = g[j, i] = r["g"] or 0.0
    return g


#: What is left of a scaled column that the others explain is taken for zero up to this.
RESIDUAL = 1e-9
#: Coefficients above this take part in a linear dependence.
COEFFICIENT = 1e-7


def sweep(a: np.ndarray, k: int, sign: int = 1) -> np.ndarray:
    """The symmetric matrix swept on column k: k enters the explaining columns (``sign`` -1: leaves them)."""
    d = a[k, k]
    out = a - np.outer(a[:, k], a[k, :]) / d
    out[k, :] = sign * a[k, :] / d
    out[:, k] = sign * a[:, k] / d
    out[k, k] = -1.0 / d
    return out


class Collinear:
    """VIFs of a set of columns from their Gram matrix, kept up to date while columns leave.

    The matrix, scaled to a unit diagonal so that columns of any magnitude count
    alike, is swept on every column that the earlier ones do not explain; the swept
    block is then the negative inverse, whose diagonal holds the VIFs.  Columns that
    are left out depend on those with a coefficient in their row; all of a dependence
    are infinite.  Dropping a column is one sweep back, and one sweep more if a
    dependent column is free then: d squared steps, not a new decomposition."""

    def __init__(self, g: np.ndarray) -> None:
        diag = np.diag(g)
        scale = np.sqrt(np.where(diag > 0, diag, 1.0))
        self.a = g / np.outer(scale, scale)
        self.swept, self.waiting = [], []
        for k in range(len(g)):
            if self.a[k, k] > RESIDUAL:
                self.a = sweep(self.a, k)
                self.swept.append(k)
            else:
                self.waiting.append(k)

    def vif(self) -> dict[int, float]:
        out = {k: float("inf") for k in self.waiting}
        for k in self.swept:
            depends = len(self.waiting) and np.abs(self.a[k, self.waiting]).max() > COEFFICIENT
            out[k] = float("inf") if depends else float(-self.a[k, k])
        return out

    def drop(self, k: int) -> None:
        if k in self.waiting:
            self.waiting.remove(k)
            return
        self.a = sweep(self.a, k, -1)
        self.swept.remove(k)
        for free in self.waiting:
            if self.a[free, free] > RESIDUAL:
                self.a = sweep(self.a, free)
                self.waiting.remove(free)
                self.swept.append(free)
                return  # the rank is whole again: the others depend as before


def vif_from_gram(g: np.ndarray) -> np.ndarray:
    """VIF of every column; columns of an exact linear dependence and all-zero columns are infinite."""
    if g.shape[0] == 1:
        return np.ones(1)
    found = Collinear(g).vif()
    return np.array([found[k] for k in range(g.shape[0])])


def numeric_null_free(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns without any NULL or NaN (``dropna(axis=1)``), via one count aggregate."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]
    if not num:
        return []
    row = df.agg(*[F.sum(is_missing(df, c).cast("long")).alias(c) for c in num]).first()
    return [c for c in num if (row[c] or 0) == 0]


def vif_table(spark: SparkSession, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cols = list(cols)
    v = vif_from_gram(gram_matrix(df, cols)) if len(cols) >= 2 else np.array([])
    rows = sorted(zip(cols, map(float, v)), key=lambda t: (-t[1], t[0]))
    schema = StructType([StructField("feature", StringType()), StructField("vif", DoubleType())])
    return spark.createDataFrame(rows, schema)


def iterative_drop(g: np.ndarray, cols: Sequence[str], threshold: float, min_cols: int = 2):
    """Drop the worst column (the first by name of equals) while its VIF > threshold; stop under ``min_cols`` columns."""
    cols = list(cols)
    state, dropped = Collinear(g), []
    while len(cols) - len(dropped) >= min_cols:
        v = state.vif()
        worst = min(v, key=lambda k: (-v[k], cols[k]))
        if not v[worst] > threshold:
            break
        dropped.append((cols[worst], v[worst]))
        state.drop(worst)
    gone = {c for c, _ in dropped}
    return [c for c in cols if c not in gone], dropped


class VIFDropperModel(StateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        dropped = {d for d, _ in self._get_state()["dropped"]}
        return df.select(*[c for c in df.columns if c not in dropped])


class VIFDropper(JsonEstimator):
    """Iteratively drop the highest-VIF column while VIF > threshold.

    Uses every row: the Gram pass is one scan, so the reference's row sample
    (a speed device of the single-machine version) is unnecessary."""

    def __init__(self, threshold: float = 10.0, exclude: Sequence[str] = ()):
        super().__init__(threshold=threshold, exclude=list(exclude))

    def _fit(self, df: DataFrame) -> VIFDropperModel:
        o = self._opts()
        cols = numeric_null_free(df, o["exclude"])
        if len(cols) < 2:
            return VIFDropperModel(state={"dropped": [], "kept": cols})
        kept, dropped = iterative_drop(gram_matrix(df, cols), cols, float(o["threshold"]))
        return VIFDropperModel(state={"dropped": dropped, "kept": kept})
