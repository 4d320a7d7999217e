"""Scalers and distribution transforms fitted on training rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.functions.numeric import clip_range, col
from cadastre.operators.quantiles import exact_quantiles
from cadastre.operators.rows import TRAIN, where


@dataclass(frozen=True)
class Affine:
    """(x - offset) / width per column."""

    params: Mapping[str, tuple[float, float]]

    def expr(self, name: str, value: str | Column | None = None) -> Column:
        offset, width = self.params[name]
        value = F.col(f"`{name}`") if value is None else col(value)
        return (value.cast("double") - F.lit(offset)) / F.lit(width)

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: self.expr(c) for c in self.params if c in df.columns})


def _affine(pairs: Mapping[str, tuple[float | None, float | None]]) -> Affine:
    return Affine({c: (o if o is not None else 0.0, w if w else 1.0) for c, (o, w) in pairs.items()})


def fit_standard(df: DataFrame, columns: Sequence[str], fit_on: str | Column | None = TRAIN) -> Affine:
    """Mean and population deviation; a zero deviation divides by 1."""
    row = where(df, fit_on).agg(
        *[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    return _affine({c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)})


def fit_minmax(df: DataFrame, columns: Sequence[str], fit_on: str | Column | None = TRAIN) -> Affine:
    """Training minimum and range; not clipped; a constant column becomes x - min."""
    row = where(df, fit_on).agg(
        *[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    return _affine(
        {c: (row[f"lo{i}"], None if row[f"lo{i}"] is None else row[f"hi{i}"] - row[f"lo{i}"]) for i, c in enumerate(columns)}
    )


def fit_robust(df: DataFrame, columns: Sequence[str], fit_on: str | Column | None = TRAIN) -> Affine:
    """Median and interquartile range (linear quantiles)."""
    q = exact_quantiles(where(df, fit_on), {c: [0.25, 0.5, 0.75] for c in columns})
    return _affine({c: (v[1], None if v[0] is None else v[2] - v[0]) for c, v in q.items()})


@dataclass(frozen=True)
class Winsor:
    """Clip limits of the columns that were skewed enough."""

    limits: Mapping[str, tuple[float, float]]
    skew: Mapping[str, float | None]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: clip_range(f"`{c}`", lo, hi) for c, (lo, hi) in self.limits.items() if c in df.columns})


def fit_winsor(
    df: DataFrame,
    columns: Sequence[str],
    fit_on: str | Column | None = TRAIN,
    min_skew: float = 1.0,
    reach: float = 3.5,
) -> Winsor:
    """Clip to q1 - reach * IQR and q3 + reach * IQR where |biased skew| > min_skew."""
    train = where(df, fit_on)
    row = train.agg(*[F.skewness(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    skew = {c: row[f"s{i}"] for i, c in enumerate(columns)}
    chosen = [c for c in columns if skew[c] is not None and abs(skew[c]) > min_skew]
    q = exact_quantiles(train, {c: [0.25, 0.75] for c in chosen})
    return Winsor({c: (v[0] - reach * (v[1] - v[0]), v[1] + reach * (v[1] - v[0])) for c, v in q.items()}, skew)


def l2_normalize(vector: str | Column, eps: float = 1e-8) -> Column:
    """v / (|v| + eps) on an array column."""
    v = col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: x / (norm + F.lit(eps)))
