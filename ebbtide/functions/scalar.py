"""Column expressions (all JVM-side built-ins; no Python UDFs).

Each helper returns a ``Column`` so it composes inside one ``select`` and stays
in whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.constants import DECLINE_CUTOFF, EPS, NULL_TOKENS, RISK_HIGH, RISK_MEDIUM, TIER_EDGES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def md5_int(text: Column, hex_digits: int = 8) -> Column:
    """Integer of the first ``hex_digits`` hex digits of md5(text): a deterministic
    pseudo-random number identical in every SQL engine (unlike ``rand``)."""
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, 10).cast("long")


def try_numeric(x) -> Column:
    """Text to double, bad text -> NULL (pandas ``to_numeric(errors='coerce')``)."""
    return _c(x).try_cast("double")


def scrub_tokens(x, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Whole-cell, case-sensitive null-token match -> NULL; type unchanged."""
    c = _c(x)
    return F.when(c.isin(*tokens), F.lit(None)).otherwise(c)


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating-point column (the two are one missing value)."""
    c = F.col(name)
    return (c.isNull() | F.isnan(c)) if df.schema[name].dataType.typeName() in ("double", "float") else c.isNull()


def without_nan(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    return F.when(~is_missing(df, name), F.col(name))


def log1p_safe(x) -> Column:
    """``log1p`` defined only above -1 (NULL at and below, like NaN/-inf dropped)."""
    c = _c(x)
    return F.when(c > -1, F.log1p(c))


def eps_ratio(num, den) -> Column:
    """``num / (den + 1e-6)``: never divides by zero for den >= 0."""
    return _c(num) / (_c(den) + F.lit(EPS))


def tier_cut(x, edges=TIER_EDGES) -> Column:
    """Right-closed bins (-inf,e0], (e0,e1], ... -> 0..len(edges) as double; NULL stays NULL."""
    c = _c(x)
    out = None
    for i, e in enumerate(edges):
        out = F.when(c <= e, float(i)) if out is None else out.when(c <= e, float(i))
    return out.when(c.isNotNull(), float(len(edges)))


def clip_keep_null(x, lo, hi) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (``least``/``greatest`` would replace it)."""
    c = _c(x)
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c < lo_c, lo_c).when(c > hi_c, hi_c).otherwise(c)


def decline_flag(x, cutoff: float = DECLINE_CUTOFF) -> Column:
    """1 if x < cutoff else 0; NULL -> 0."""
    return F.coalesce((_c(x) < cutoff).cast("int"), F.lit(0))


def round_half_even(x, scale: int) -> Column:
    """NumPy/pandas rounding: scale, round half to even on the double, unscale
    (``rint(x * 10^d) / 10^d``, the same IEEE steps as ``numpy.around``):
    0.25 -> 0.2 at one decimal.  ``bround`` would round the decimal text instead."""
    f = float(10 ** scale)
    return F.rint(_c(x) * f) / f


def at_threshold(p, thr) -> Column:
    """Inclusive decision rule ``p >= thr`` as 0/1."""
    t = thr if isinstance(thr, Column) else F.lit(thr)
    return (_c(p) >= t).cast("int")


def safe_div(num, den) -> Column:
    """``zero_division=0``: 0.0 when the denominator is 0."""
    n, d = _c(num), _c(den)
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d)


def risk_label(p) -> Column:
    c = _c(p)
    return F.when(c >= RISK_HIGH, "High Risk").when(c >= RISK_MEDIUM, "Medium Risk").otherwise("Low Risk")


def churn_label(pred) -> Column:
    return F.when(_c(pred) == 1, "Churn").otherwise("No Churn")


def map_lookup(x, mapping: Mapping[str, int], default: int = 0) -> Column:
    """Left lookup into a literal map, default on a miss (including NULL keys)."""
    m = F.create_map(*[v for k, val in mapping.items() for v in (F.lit(k), F.lit(val))])
    return F.coalesce(m[_c(x)], F.lit(default)).cast("int")


def width_bin(x, lo, hi, n: int) -> Column:
    """Equal-width bin 1..n over [lo, hi], top edge closed (x = hi -> n)."""
    c = _c(x)
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    width = (hi_c - lo_c) / n
    raw = F.floor((c - lo_c) / width) + 1
    return F.when(hi_c == lo_c, F.lit(1)).otherwise(F.least(raw, F.lit(n))).cast("int")


def r6(x) -> Column:
    """Round a float result to 6 decimals for engine-independent comparison."""
    return F.round(_c(x), 6)
