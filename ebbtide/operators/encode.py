"""Fitted encoders: mixed imputer (M1), out-of-fold target encoder (M5),
ordinal encoder (M6).

Target encoder design (the "OOF catch"): the fitted table is keyed by
(column, fold, category) with fold -1 = the full-train map.  Training rows
carry their fold, test rows do not (fold -1), so ONE ``transform`` yields the
out-of-fold value on train rows and the full-train value on test rows, which
also keeps ``pyspark.ml.Pipeline.fit`` leak-free.  Out-of-fold statistics are
computed by subtraction (total - fold) from one grouped pass, never k scans.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ebbtide.functions.constants import HIGH_CARD_CATS, TARGET_SMOOTHING
from ebbtide.operators.profile import long_values
from ebbtide.operators.split import dense_rank_values
from ebbtide.functions.scalar import without_nan
from ebbtide.operators.stages import JsonEstimator, StateModel, TableModel
from ebbtide.session import scratch_path


def _fitted(table: DataFrame, name: str) -> DataFrame:
    """Write a fitted lookup table to the shared checkpoint folder: transforms start
    from the files, whose measured bytes let adaptive execution choose the join."""
    path = scratch_path(table.sparkSession, f"fitted/{name}-{uuid.uuid4().hex}")
    table.write.parquet(path)
    return table.sparkSession.read.parquet(path)


class MixedImputerModel(StateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._get_state()
        num, cat = st["numeric"], st["categorical"]
        out = []
        for x in df.columns:
            if x in num:
                out.append(F.coalesce(without_nan(df, x).cast("double"), F.lit(num[x])).alias(x))
            elif x in cat:
                out.append(F.coalesce(F.col(x), F.lit(cat[x])).alias(x))
            else:
                out.append(F.col(x))
        return df.select(*out)


class MixedImputer(JsonEstimator):
    """Numeric -> train median (exact, midpoint on even n); string -> train mode
    (most frequent, smallest on ties).  NaN counts as missing.  Boolean columns pass
    through untouched.  Numerics come out as double."""

    def __init__(self, exclude: Sequence[str] = ()):
        super().__init__(exclude=list(exclude))

    def _fit(self, df: DataFrame) -> MixedImputerModel:
        skip = set(self._opts()["exclude"])
        num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]
        cat = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in skip]
        from ebbtide.operators.quantile import exact_quantiles, modes

        medians, mode_values = {}, {}
        if num:
            long_num = long_values(df, num)
            got = {r["feature"]: r["value"] for r in exact_quantiles(long_num, ["feature"], "value", [0.5]).collect()}
            for c in num:
                if got.get(c) is None:
                    raise ValueError(f"MixedImputer: numeric column {c!r} is entirely null; no median to impute")
                medians[c] = float(got[c])
        if cat:
            long_cat = long_values(df, cat, value_type="string")
            got = {r["feature"]: r["mode"] for r in modes(long_cat, ["feature"]).collect()}
            mode_values = {c: got.get(c) for c in cat}
        return MixedImputerModel(state={"numeric": medians, "categorical": mode_values})


class TargetEncoderModel(TableModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._get_state()
        o = self._opts()
        cols = [c for c in st["columns"] if c in df.columns]
        fold_col = o["foldCol"]
        fold = F.coalesce(F.col(fold_col), F.lit(-1)) if fold_col in df.columns else F.lit(-1)
        gm = {int(k): v for k, v in st["fold_means"].items()}
        gm_expr = F.lit(gm[-1])
        for f, g in gm.items():
            if f != -1:
                gm_expr = F.when(F.col("_te_fold") == f, F.lit(g)).otherwise(gm_expr)
        out = df.withColumn("_te_fold", fold.cast("int"))
        for c in cols:
            m = self.table.where(F.col("column") == c).select(
                F.col("fold").alias("_te_fold"), F.col("value").alias(f"_te_v_{c}"), F.col("enc").alias(f"{c}_enc")
            )
            out = out.join(m, (out["_te_fold"] == m["_te_fold"]) & (out[c] == m[f"_te_v_{c}"]), "left").drop(
                m["_te_fold"], m[f"_te_v_{c}"]
            )
            out = out.withColumn(f"{c}_enc", F.coalesce(F.col(f"{c}_enc"), gm_expr))
        # encoded column replaces its source; the *_enc columns go to the end
        rest = [x for x in df.columns if x not in cols]
        return out.select(*rest, *[f"{c}_enc" for c in cols])


class TargetEncoderOOF(JsonEstimator):
    """Smoothed target encoding ``(n * mean + k * g) / (n + k)``.

    Rows with ``foldCol`` = f get the map built from the other folds with that
    complement's own mean g_f; rows without a fold get the full-train map;
    categories never seen -> the matching global mean."""

    def __init__(self, cols: Sequence[str] = HIGH_CARD_CATS, labelCol: str = "churn", foldCol: str = "fold",
                 k: float = TARGET_SMOOTHING):
        super().__init__(cols=list(cols), labelCol=labelCol, foldCol=foldCol, k=float(k))

    def _fit(self, df: DataFrame) -> TargetEncoderModel:
        o = self._opts()
        label, fold_col, k = o["labelCol"], o["foldCol"], o["k"]
        if label not in df.columns:
            raise ValueError("TargetEncoderOOF requires the label column during fit")
        cols = [c for c in o["cols"] if c in df.columns]
        # per-fold totals (k rows) -> full and complement global means
        tot = df.groupBy(F.col(fold_col).alias("fold")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("y")
        ).collect()
        n_all = sum(r["n"] for r in tot)
        y_all = sum(r["y"] for r in tot)
        fold_means = {-1: y_all / n_all}
        for r in tot:
            rest = n_all - r["n"]
            fold_means[int(r["fold"])] = (y_all - r["y"]) / rest if rest else y_all / n_all
        long = long_values(df, cols, ids=[fold_col, label], value_type="string", var="column", val="value")
        per = long.groupBy("column", "value", F.col(fold_col).alias("fold")).agg(
            F.count(F.lit(1)).alias("n_f"), F.sum(F.col(label).cast("double")).alias("y_f")
        )
        w = Window.partitionBy("column", "value")
        per = per.select("*", F.sum("n_f").over(w).alias("n_t"), F.sum("y_f").over(w).alias("y_t"))
        gm_col = F.lit(fold_means[-1])
        for f, g in fold_means.items():
            if f != -1:
                gm_col = F.when(F.col("fold") == f, F.lit(g)).otherwise(gm_col)
        oof = per.select(
            "column", "value", F.col("fold").cast("int").alias("fold"),
            ((F.col("y_t") - F.col("y_f") + k * gm_col) / (F.col("n_t") - F.col("n_f") + k)).alias("enc"),
        )
        # a category absent from fold f is never looked up with fold f (no such row), so the
        # subtraction table is complete; n_t - n_f = 0 gives (0 + k g_f) / k = g_f as required
        cat_totals = per.select("column", "value", "n_t", "y_t").distinct()
        full = cat_totals.select(
            "column", "value", F.lit(-1).alias("fold"),
            ((F.col("y_t") + k * F.lit(fold_means[-1])) / (F.col("n_t") + k)).alias("enc"),
        )
        table = _fitted(oof.unionByName(full), "target-encoder")
        state = {"columns": cols, "fold_means": {str(kk): v for kk, v in fold_means.items()}}
        return TargetEncoderModel(state=state, table=table, foldCol=fold_col)


class OrdinalEncoderModel(TableModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        cols = [c for c in self._get_state()["columns"] if c in df.columns]
        out = df
        for c in cols:
            m = self.table.where(F.col("column") == c).select(F.col("value").alias(f"_oe_{c}"),
                                                              F.col("code").alias(f"_oe_code_{c}"))
            out = out.join(m, out[c] == m[f"_oe_{c}"], "left").drop(f"_oe_{c}")
        return out.select(
            *[
                F.coalesce(F.col(f"_oe_code_{x}"), F.lit(-1.0)).alias(x) if x in cols else F.col(x)
                for x in df.columns
            ]
        )


class OrdinalCategoricalEncoder(JsonEstimator):
    """Every string column (at fit time) -> 0-based rank of its sorted distinct
    train values; unseen -> -1 (``StringIndexer`` would give n, not -1)."""

    def __init__(self, exclude: Sequence[str] = ()):
        super().__init__(exclude=list(exclude))

    def _fit(self, df: DataFrame) -> OrdinalEncoderModel:
        skip = set(self._opts()["exclude"])
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in skip]
        if not cols:
            return OrdinalEncoderModel(state={"columns": []},
                                       table=df.sparkSession.createDataFrame([], "column string, value string, code double"))
        long = long_values(df, cols, value_type="string", var="column", val="value").where(F.col("value").isNotNull())
        # exact sorted rank of the distinct values without one task per column
        ranked_values = dense_rank_values(long, "column", "value", "rank")
        table = ranked_values.select("column", "value", (F.col("rank") - 1).cast("double").alias("code"))
        return OrdinalEncoderModel(state={"columns": cols}, table=_fitted(table, "ordinal-encoder"))
