"""Feature stages: engineer (M2), percentile clipper (M3), binary maps (M4), scaler.

Every transform is ONE ``select`` (no ``withColumn`` chains), built from
JVM-side expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.constants import BINARY_MAPS, EPS, RATIO_KEYWORDS
from ebbtide.functions.scalar import clip_keep_null, decline_flag, eps_ratio, map_lookup, tier_cut
from ebbtide.operators.stages import JsonEstimator, StatelessTransformer, StateModel


def engineered_columns() -> dict[str, Column]:
    """The 24 derived columns (ratio with epsilon, tier, flags)."""
    c = F.col
    return {
        "call_completion_rate": eps_ratio("comp_vce_Mean", "plcd_vce_Mean"),
        "drop_rate": eps_ratio("drop_vce_Mean", "plcd_vce_Mean"),
        "block_rate": eps_ratio("blck_vce_Mean", "plcd_vce_Mean"),
        "short_call_ratio": eps_ratio("inonemin_Mean", "plcd_vce_Mean"),
        "dropped_or_blocked_rate": eps_ratio(c("drop_vce_Mean") + c("blck_vce_Mean"), "plcd_vce_Mean"),
        "unanswered_rate": eps_ratio("unan_vce_Mean", "plcd_vce_Mean"),
        "data_to_voice_ratio": eps_ratio("plcd_dat_Mean", "plcd_vce_Mean"),
        "voice_mou_per_call": eps_ratio("mou_cvce_Mean", "comp_vce_Mean"),
        "revenue_per_minute": eps_ratio("rev_Mean", "mou_Mean"),
        "overage_ratio": eps_ratio("ovrmou_Mean", "mou_Mean"),
        "custcare_rate": eps_ratio("custcare_Mean", "months"),
        "peak_usage_share": c("peak_vce_Mean") / (c("peak_vce_Mean") + c("opk_vce_Mean") + F.lit(EPS)),
        "roam_to_total_ratio": eps_ratio("roam_Mean", "plcd_vce_Mean"),
        "revenue_per_subscriber": eps_ratio("rev_Mean", "actvsubs"),
        "customer_ltv": c("totmrc_Mean") * c("months"),
        "mou_momentum": eps_ratio("avg3mou", "avg6mou"),
        "rev_momentum": eps_ratio("avg3rev", "avg6rev"),
        "lifetime_vs_recent_mou": eps_ratio("avg3mou", "avgmou"),
        "revenue_stability": eps_ratio("avg3rev", "avgrev"),
        "active_sub_ratio": eps_ratio("actvsubs", "uniqsubs"),
        "models_per_phone": eps_ratio("models", "phones"),
        "device_age_tier": tier_cut("eqpdays"),
        "mou_declining_flag": decline_flag("change_mou"),
        "revenue_declining_flag": decline_flag("change_rev"),
    }


ENGINEERED = (
    "call_completion_rate", "drop_rate", "block_rate", "short_call_ratio", "dropped_or_blocked_rate",
    "unanswered_rate", "data_to_voice_ratio", "voice_mou_per_call", "revenue_per_minute", "overage_ratio",
    "custcare_rate", "peak_usage_share", "roam_to_total_ratio", "revenue_per_subscriber", "customer_ltv",
    "mou_momentum", "rev_momentum", "lifetime_vs_recent_mou", "revenue_stability", "active_sub_ratio",
    "models_per_phone", "device_age_tier", "mou_declining_flag", "revenue_declining_flag",
)


class FeatureEngineer(StatelessTransformer):
    """Stateless: appends the 24 engineered columns (replacing same-named ones)."""

    def _transform(self, df: DataFrame) -> DataFrame:
        new = engineered_columns()
        keep = [F.col(x) for x in df.columns if x not in new]
        return df.select(*keep, *[expr.alias(name) for name, expr in new.items()])


def ratio_columns(columns: Sequence[str], keywords: Sequence[str] = RATIO_KEYWORDS) -> list[str]:
    return [c for c in columns if any(k in c for k in keywords)]


class PercentileClipperModel(StateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        bounds = self._get_state()["bounds"]
        return df.select(
            *[
                clip_keep_null(x, float(bounds[x][0]), float(bounds[x][1])).alias(x) if x in bounds else F.col(x)
                for x in df.columns
            ]
        )


class PercentileClipper(JsonEstimator):
    """Clip ratio-named columns at train quantiles (linear interpolation, exact)."""

    def __init__(self, lower: float = 0.01, upper: float = 0.99, keywords: Sequence[str] = RATIO_KEYWORDS,
                 accuracy: int = 10000):
        super().__init__(lower=lower, upper=upper, keywords=list(keywords), accuracy=accuracy)

    def _fit(self, df: DataFrame) -> PercentileClipperModel:
        o = self._opts()
        cols = ratio_columns(df.columns, o["keywords"])
        if not cols:
            return PercentileClipperModel(state={"bounds": {}})
        from ebbtide.operators.profile import quantiles

        lo, hi = float(o["lower"]), float(o["upper"])
        rows = quantiles(df, cols, [lo, hi], accuracy=int(o["accuracy"])).collect()
        found: dict[str, dict[float, float]] = {}
        for r in rows:  # 2 x #columns rows
            found.setdefault(r["feature"], {})[float(r["q"])] = float(r["value"])
        bounds = {c: [found[c][lo], found[c][hi]] for c in cols if c in found}
        return PercentileClipperModel(state={"bounds": bounds})


class BinaryMapEncoder(StatelessTransformer):
    """Map known binary categoricals to 0/1; anything else (incl. NULL) -> 0."""

    def __init__(self, maps: dict | None = None):
        super().__init__(maps=maps or BINARY_MAPS)

    def _transform(self, df: DataFrame) -> DataFrame:
        maps = self._opts()["maps"]
        return df.select(*[map_lookup(x, maps[x]).alias(x) if x in maps else F.col(x) for x in df.columns])


class StandardScalerModel(StateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._get_state()["stats"]
        out = []
        for x in df.columns:
            if x in st:
                mean, std = st[x]
                scale = std if std and std > 0 else 1.0
                out.append(((F.col(x) - F.lit(mean)) / F.lit(scale)).alias(x))
            else:
                out.append(F.col(x))
        return df.select(*out)


class StandardScaler(JsonEstimator):
    """(x - mean) / population std; a zero std divides by 1 (scikit-learn rule).
    ``ml.feature.StandardScaler`` uses the sample std, hence this stage."""

    def __init__(self, inputCols: Sequence[str] = ()):
        super().__init__(inputCols=list(inputCols))

    def _fit(self, df: DataFrame) -> StandardScalerModel:
        cols = self._opts()["inputCols"]
        aggs = []
        for i, c in enumerate(cols):
            aggs += [F.avg(F.col(c)).alias(f"m{i}"), F.stddev_pop(F.col(c)).alias(f"s{i}")]
        row = df.agg(*aggs).first()
        stats = {c: [row[f"m{i}"], row[f"s{i}"]] for i, c in enumerate(cols)}
        return StandardScalerModel(state={"stats": stats})
