"""The preprocessing pipeline factory (M12): a ``pyspark.ml.Pipeline`` of the
custom stages in the fixed order impute -> engineer -> clip -> binary maps ->
target encode -> ordinal encode -> (VIF)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline

from ebbtide.functions.constants import BINARY_MAPS, HIGH_CARD_CATS
from ebbtide.operators.collinear import VIFDropper
from ebbtide.operators.encode import MixedImputer, OrdinalCategoricalEncoder, TargetEncoderOOF
from ebbtide.operators.features import BinaryMapEncoder, FeatureEngineer, PercentileClipper

ID_COLS = ("cust_id", "churn", "split", "fold")


def build_preprocessing_pipeline(
    high_card_cats: Sequence[str] | None = None,
    binary_maps: dict | None = None,
    vif_threshold: float | None = None,
    id_cols: Sequence[str] = ID_COLS,
    label: str = "churn",
    fold_col: str = "fold",
) -> Pipeline:
    """Fit on TRAIN rows carrying ``fold``; transform train and test with the same
    model (train rows get out-of-fold target encodings, test rows the full map).
    ``vif_threshold=None`` leaves the VIF step out (the reference's real run)."""
    ids = list(id_cols)
    stages = [
        MixedImputer(exclude=ids),
        FeatureEngineer(),
        PercentileClipper(),
        BinaryMapEncoder(maps=binary_maps or BINARY_MAPS),
        TargetEncoderOOF(cols=list(high_card_cats or HIGH_CARD_CATS), labelCol=label, foldCol=fold_col),
        OrdinalCategoricalEncoder(exclude=ids),
    ]
    if vif_threshold is not None:
        stages.append(VIFDropper(threshold=vif_threshold, exclude=ids))
    return Pipeline(stages=stages)
