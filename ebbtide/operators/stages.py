"""Base classes for the custom ``pyspark.ml`` stages.

Small fitted state (per-column medians, bounds, ...) is kept in a JSON param
(bounded by the number of columns).  Fitted lookup tables whose size grows
with category cardinality stay DataFrames and are saved as Parquet next to the
stage metadata.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession


class HasState(Params):
    state = Param(Params._dummy(), "state", "fitted state as JSON text", typeConverter=TypeConverters.toString)

    def _get_state(self) -> dict:
        return json.loads(self.getOrDefault(self.state)) if self.isDefined(self.state) else {}

    def _set_state(self, value: dict):
        return self._set(state=json.dumps(value))


class JsonParams(Params):
    """Param holding a JSON document (column lists, maps)."""

    options = Param(Params._dummy(), "options", "options as JSON text", typeConverter=TypeConverters.toString)

    def _opts(self) -> dict:
        return json.loads(self.getOrDefault(self.options)) if self.isDefined(self.options) else {}


class StatelessTransformer(Transformer, JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **opts):
        super().__init__()
        self._setDefault(options=json.dumps(opts))


class StateModel(Model, HasState, JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, state: dict | None = None, **opts):
        super().__init__()
        self._setDefault(options=json.dumps(opts))
        if state is not None:
            self._set_state(state)


class TableModelWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.mode("overwrite").parquet(f"{path}/table")


class TableModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        inst = self.cls()
        DefaultParamsReader.getAndSetParams(inst, metadata)
        inst.table = SparkSession.builder.getOrCreate().read.parquet(f"{path}/table")
        return inst


class TableModel(Model, HasState, JsonParams, MLReadable, MLWritable):
    """A model whose fitted lookup table is a DataFrame."""

    table: DataFrame | None = None

    def __init__(self, state: dict | None = None, table: DataFrame | None = None, **opts):
        super().__init__()
        self._setDefault(options=json.dumps(opts))
        if state is not None:
            self._set_state(state)
        self.table = table

    def write(self):
        return TableModelWriter(self)

    @classmethod
    def read(cls):
        return TableModelReader(cls)


class JsonEstimator(Estimator, JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **opts):
        super().__init__()
        self._setDefault(options=json.dumps(opts))
