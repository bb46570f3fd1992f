"""ebbtide: customer-attrition analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    table loading, CSV / Parquet / JSON sources and sinks, model persistence
functions  column expressions (scalar helpers, fixed lookup values)
operators  profiling, statistics, splits, feature stages, metrics, models, explanations
plans      fixture views derived from the driver tables and the query registry
streaming  applying a fitted feature pipeline to a streaming DataFrame
"""

__version__ = "0.1.0"
