"""Numeric column functions. All return Spark columns and stay inside generated code."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column; NULL is the only missing value afterwards."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATS)}
    return df.select(
        *[
            F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")).alias(n) if n in floats else F.col(f"`{n}`")
            for n in df.columns
        ]
    )


def coerce_number(c: str | Column, floor: float | None = None) -> Column:
    """Text to double, unparsable -> NULL, optionally floored."""
    value = col(c).cast("string").try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if floor is None else F.when(value.isNotNull(), F.greatest(value, F.lit(float(floor))))


def weighted_sum(weights: Mapping[str, float]) -> Column:
    terms = [F.col(name) if w == 1 else F.col(name) * F.lit(w) for name, w in weights.items()]
    return reduce(lambda a, b: a + b, terms)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def bounded_difference(a: str | Column, b: str | Column, floor: float = 0) -> Column:
    diff = col(a) - col(b)
    return F.when(diff.isNotNull(), F.greatest(F.lit(floor).cast("double"), diff.cast("double")))


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL for a zero or missing denominator."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def planar_distance(lat: str | Column, lon: str | Column, anchor: Sequence[float], unit: float = 111.0) -> Column:
    """Planar distance to an anchor (lat, lon), degrees times `unit` kilometres."""
    dlat, dlon = col(lat) - F.lit(float(anchor[0])), col(lon) - F.lit(float(anchor[1]))
    return F.sqrt(dlat * dlat + dlon * dlon) * F.lit(unit)


def line_distance(
    lat: str | Column,
    lon: str | Column,
    base: float = -124.0,
    slope: float = 0.7,
    top: float = 42.0,
    bottom: float = 32.0,
) -> Column:
    """Longitude gap to a straight coast line that is defined between two latitudes."""
    clipped = F.greatest(F.lit(bottom), F.least(F.lit(top), col(lat)))
    return F.abs(col(lon) - (F.lit(base) + F.lit(slope) * (F.lit(top) - clipped)))


def log_floor(c: str | Column, floor: float = 0.0) -> Column:
    """log1p of the value floored at `floor`."""
    c = col(c).cast("double")
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(floor))))


def clip(c: str | Column, bound: float) -> Column:
    return clip_range(c, -bound, bound)


def clip_range(c: str | Column, low: float | None, high: float | None) -> Column:
    """NULL stays NULL (`greatest` and `least` alone would skip it)."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def unlog(c: str | Column, bound: float = 20.0) -> Column:
    """expm1 after clipping to +-bound."""
    return F.expm1(clip(c, bound))


def signed_root(c: str | Column) -> Column:
    """sign(x) * sqrt(|x| + 1); zero stays zero."""
    c = col(c)
    return F.signum(c) * F.sqrt(F.abs(c) + F.lit(1.0))


def finite_or(c: str | Column, default: float = 0.0) -> Column:
    """NULL, NaN and infinities become `default`."""
    c = col(c).cast("double")
    return F.when(is_finite(c), c).otherwise(F.lit(float(default)))


def is_finite(c: str | Column) -> Column:
    c = col(c).cast("double")
    inf = F.lit(math.inf)
    return c.isNotNull() & ~F.isnan(c) & (c < inf) & (c > -inf)


def pick_number_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Numeric columns by schema (no job)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def pick_text_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def date_parts(c: str | Column, pattern: str = "d/M/yyyy") -> dict[str, Column]:
    """Year, month, day and weekday (Monday = 0) of a text date; unreadable -> NULL."""
    stamp = F.try_to_timestamp(col(c), F.lit(pattern))
    return {
        "year": F.year(stamp),
        "month": F.month(stamp),
        "day": F.dayofmonth(stamp),
        "weekday": F.weekday(stamp),
    }
