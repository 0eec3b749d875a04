"""Column-expression helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round2(c: str | Column, digits: int = 2) -> Column:
    """numpy/pandas rounding: rint(x * 10^d) / 10^d (half to even on the scaled value)."""
    scale = float(10**digits)
    return F.rint(col(c).cast("double") * F.lit(scale)) / F.lit(scale)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """NULL instead of an error when the divisor is zero or NULL."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def dbl(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def clip(c: str | Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), dbl(lo)), dbl(hi))


def pct_change(new: str | Column, old: str | Column) -> Column:
    """(new - old) / old * 100, 0 when old is 0."""
    return F.when(col(old) != 0, (col(new) - col(old)) / col(old) * 100.0).otherwise(dbl(0.0))


def flag(cond: Column) -> Column:
    return cond.cast("int")


def month_sin(m: str | Column) -> Column:
    return round2(F.sin(dbl(2 * math.pi) * col(m) / 12.0))


def month_cos(m: str | Column) -> Column:
    return round2(F.cos(dbl(2 * math.pi) * col(m) / 12.0))


def horizon_degradation(h: str | Column) -> Column:
    """Error growth over the horizon: 1.0 at month 1, 1.15 at 2, 1.30 from 3 on, linear
    in between."""
    h = col(h).cast("double")
    return (
        F.when(h <= 1, dbl(1.0))
        .when(h <= 2, 1.0 + (h - 1) * 0.15)
        .when(h <= 3, 1.15 + (h - 2) * 0.15)
        .otherwise(dbl(1.30))
    )


def confidence_level(conf: str | Column, horizon: str | Column | float = 1.0) -> Column:
    """conf / (1 + 0.15 (h - 1)) -> High >= .8, Medium >= .6, else Low."""
    h = col(horizon) if not isinstance(horizon, (int, float)) else dbl(horizon)
    adj = col(conf) / (1.0 + 0.15 * (h - 1.0))
    return F.when(adj >= 0.8, F.lit("High")).when(adj >= 0.6, F.lit("Medium")).otherwise(F.lit("Low"))


def display_name(product: str | Column) -> Column:
    """strip '_revenue', '_' -> ' ', title case."""
    s = F.regexp_replace(col(product), "_revenue", "")
    return F.initcap(F.regexp_replace(s, "_", " "))
