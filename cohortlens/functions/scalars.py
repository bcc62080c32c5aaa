"""Scalar expressions: losses, guarded ratios, decoding of parameter cells, threshold grids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens import constants as K


def linspace(start: float, stop: float, n: int) -> list[float]:
    return [float(x) for x in np.linspace(start, stop, n)]


# The threshold grids.
BASE_GRID = linspace(0.01, 0.99, 200)
DENSE_LOW_GRID = linspace(0.01, 0.4, 200) + linspace(0.41, 0.99, 100)


def double_array(values) -> Column:
    """An array literal, parsed in one go instead of one call per element."""
    return F.expr("array(" + ",".join(f"{float(v)!r}D" for v in values) + ")")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(z: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def bce_with_logits(z: str | Column, y: str | Column) -> Column:
    """Binary cross-entropy of a logit; does not overflow for large |z|."""
    z, y = _c(z), _c(y)
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def focal_loss(z: str | Column, y: str | Column, alpha: float = K.FOCAL_ALPHA,
               gamma: float = K.FOCAL_GAMMA) -> Column:
    """Focal loss per row; aggregate with ``avg`` or ``sum``."""
    y = _c(y).cast("double")
    bce = bce_with_logits(z, y)
    weight = F.lit(alpha) * y + F.lit(1 - alpha) * (F.lit(1.0) - y)
    return weight * F.pow(F.lit(1.0) - F.exp(-bce), F.lit(float(gamma))) * bce


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / (b + eps), the guarded form of every rate."""
    return _c(a) / (_c(b) + F.lit(K.EPS))


def ratio_or_zero(a: str | Column, b: str | Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def hard_decision(p: str | Column, t: float | Column) -> Column:
    """1 where the score is strictly above the threshold. NaN scores give NULL, not 1."""
    p = _c(p)
    return F.when(F.isnan(p), None).otherwise((p > t).cast("int"))


def base_name(model_key: str | Column) -> Column:
    """``LightGBM2`` -> ``LightGBM``."""
    return F.regexp_replace(_c(model_key), r"\p{Nd}", "")


def matches_keyword(name: str | Column, keyword: str) -> Column:
    """Case-insensitive pattern match of a model name."""
    return _c(name).rlike(f"(?i){keyword}")


def decode_param(name: str | Column, cell: str | Column, lenient: bool = False) -> Column:
    """Typed value of a parameter cell, as a struct (kind, i, d, b, s).

    Null words and NULL decode to NULL. Integers go through a double and lose the fraction.
    A cell that cannot be read as its type is NULL, or kept as text in the lenient variant,
    which also knows a few more names.
    """
    name, cell = _c(name), _c(cell)
    ints = K.INT_PARAMS + (K.EXTRA_INT_PARAMS if lenient else ())
    floats = K.FLOAT_PARAMS + (K.EXTRA_FLOAT_PARAMS if lenient else ())
    low = F.lower(cell)
    number = cell.try_cast("double")
    whole = F.when(F.abs(number) < 9e18, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
    truth = (
        F.when(low.isin(*K.TRUE_WORDS), True)
        .when(low.isin(*K.FALSE_WORDS), False)
        .otherwise(number != 0)
    )
    is_null = cell.isNull() | low.isin(*K.NULL_WORDS)

    def value(kind, i=None, d=None, b=None, s=None):
        return F.struct(
            F.lit(kind).alias("kind"),
            (F.lit(None) if i is None else i).cast("long").alias("i"),
            (F.lit(None) if d is None else d).cast("double").alias("d"),
            (F.lit(None) if b is None else b).cast("boolean").alias("b"),
            (F.lit(None) if s is None else s).cast("string").alias("s"),
        )

    raw = value("str", s=cell)
    failed = raw if lenient else F.lit(None)
    return (
        F.when(is_null, None)
        .when(name.isin(*ints), F.when(whole.isNotNull(), value("int", i=whole)).otherwise(failed))
        .when(name.isin(*K.BOOL_PARAMS), F.when(truth.isNotNull(), value("bool", b=truth)).otherwise(failed))
        .when(name.isin(*floats), F.when(number.isNotNull(), value("float", d=number)).otherwise(failed))
        .otherwise(raw)
    )


def param_keys_only(params: str | Column) -> Column:
    """A params map without the entries that hold metrics."""
    def keep(k, _):
        fits = ~k.isin(*K.METRIC_COLUMNS)
        for part in K.METRIC_FRAGMENTS:
            fits = fits & ~k.contains(part)
        return fits
    return F.map_filter(_c(params), keep)


def merge_params(fixed: str | Column, tuned: str | Column) -> Column:
    """fixed ∪ tuned, the tuned value winning, whatever the session's duplicate-key policy."""
    fixed, tuned = _c(fixed), _c(tuned)
    return F.map_concat(F.map_filter(fixed, lambda k, _: ~F.map_contains_key(tuned, k)), tuned)
