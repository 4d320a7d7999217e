"""Box-Cox: lambda by maximum likelihood on training rows, one aggregate row per Newton step."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.functions.numeric import col
from cadastre.operators.rows import TRAIN, where
from cadastre.session import materialize


def forward(x: str | Column, lam: float) -> Column:
    x = col(x)
    if lam == 0:
        return F.ln(x)
    return (F.pow(x, F.lit(float(lam))) - F.lit(1.0)) / F.lit(float(lam))


def inverse(
    y: str | Column, lam: float | None, shift: float = 0.0, base_floor: float | None = 1e-12, floor: float | None = 0.0
) -> Column:
    """Undo the transform; `lam=None` is the identity. `base_floor=None` leaves the base alone."""
    y = col(y)
    if lam is None:
        return y
    if lam == 0:
        out = F.exp(y)
    else:
        base = y * F.lit(float(lam)) + F.lit(1.0)
        if base_floor is not None:
            base = F.when(base.isNotNull(), F.greatest(base, F.lit(base_floor)))
        out = F.pow(base, F.lit(1.0 / lam))
    out = out - F.lit(float(shift))
    return out if floor is None else F.when(out.isNotNull(), F.greatest(out, F.lit(float(floor))))


def scores(values: DataFrame, lambdas: Sequence[float]) -> DataFrame:
    """(lam, llf) over a positive column `x`: (lam - 1) * sum(ln x) - n/2 * ln(variance of the moved x).

    Every row is repeated per lambda inside the task and folded into one partial sum per lambda, so
    the whole grid costs one scan, and the generated code is the same for every round.
    """
    x, lam = F.col("x"), F.col("lam")
    grid = values.select("x", F.explode(F.array(*[F.lit(float(v)) for v in lambdas])).alias("lam"))
    moved = F.when(lam == 0, F.ln(x)).otherwise((F.pow(x, lam) - 1) / F.when(lam == 0, 1.0).otherwise(lam))
    parts = grid.withColumn("moved", moved).groupBy("lam").agg(
        F.sum(F.ln(x)).alias("logs"), F.count("*").alias("n"), F.var_pop("moved").alias("spread")
    )
    return parts.select("lam", ((lam - 1) * F.col("logs") - F.col("n") / 2 * F.ln("spread")).alias("llf"))


def needed_shift(low: float | None) -> float:
    """abs(min) + 1 when the minimum is not positive."""
    return abs(low) + 1.0 if low is not None and low <= 0 else 0.0


@dataclass(frozen=True)
class BoxCox:
    column: str
    lam: float
    shift: float

    def apply(self, df: DataFrame, out: str | None = None) -> DataFrame:
        shifted = F.col(f"`{self.column}`").cast("double") + F.lit(self.shift)
        return df.withColumn(out or self.column, F.when(shifted > 0, forward(shifted, self.lam)))

    def undo(self, y: str | Column, base_floor: float | None = 1e-12) -> Column:
        return inverse(y, self.lam, self.shift, base_floor)


def likelihood_table(df: DataFrame, column: str, lambdas: Sequence[float], shift: float | None = None) -> DataFrame:
    """(lambda, llf) rows from a single aggregation over all the lambdas."""
    return scores(_shifted(df, column, shift)[0], lambdas)


def _shifted(df: DataFrame, column: str, shift: float | None) -> tuple[DataFrame, float]:
    values = df.select(F.col(f"`{column}`").cast("double").alias("x")).filter("x is not null")
    if shift is None:
        shift = needed_shift(values.agg(F.min("x")).first()[0])
    return values.select((F.col("x") + F.lit(shift)).alias("x")), shift


def _slope(values: DataFrame, centre: float, lam: float) -> tuple[float, float] | None:
    """First and second derivative of the likelihood per row, over positive `x` with the mean logarithm `centre`.

    With z = ln x - centre the likelihood is -ln var(w) / 2 and a constant, w = (exp(lam z) - 1) / lam; w and its derivatives by
    lam are columns, as series where lam z is small, and the derivatives of the variance are covariances of theirs.
    """
    z = F.ln("x") - F.lit(centre)
    a = z * F.lit(lam)
    series = lambda power, terms: F.pow(z, F.lit(power)) * sum((F.pow(a, F.lit(k)) * t for k, t in enumerate(terms)), F.lit(0.0))
    by = lam or 1.0
    near = F.abs(a) < 0.02
    w = F.when(near, series(1, [1, 1 / 2, 1 / 6, 1 / 24, 1 / 120])).otherwise(F.expm1(a) / by)
    first = F.when(near, series(2, [1 / 2, 1 / 3, 1 / 8, 1 / 30, 1 / 144])).otherwise((z * F.exp(a) - F.expm1(a) / by) / by)
    rows = values.select(z.alias("z"), a.alias("a"), w.alias("w"), first.alias("w1"))
    z, a = F.col("z"), F.col("a")
    second = F.when(F.abs(a) < 0.02, series(3, [1 / 3, 1 / 4, 1 / 10, 1 / 36])).otherwise((z * z * F.exp(a) - 2 * F.col("w1")) / by)
    rows = rows.withColumn("w2", second)
    v, c, v1, c2 = rows.agg(F.var_pop("w"), F.covar_pop("w", "w1"), F.var_pop("w1"), F.covar_pop("w", "w2")).first()
    if v is None or not 0 < v < math.inf or not math.isfinite(c + v1 + c2):
        return None
    return -c / v, -(v1 + c2) / v + 2 * (c / v) ** 2


def fit_boxcox(df: DataFrame, column: str, fit_on: str | Column | None = TRAIN, start: float = 1.0, rounds: int = 40, tolerance: float = 1e-9) -> BoxCox:
    """Newton steps from `start`, kept between the last points where the likelihood rose and fell; lambda is `start` for a constant column."""
    train = materialize(where(df, fit_on).select(F.col(f"`{column}`")), "boxcox")  # one narrow copy for all steps
    values, shift = _shifted(train, column, None)
    centre, least, most = values.agg(F.avg(F.ln("x")), F.min("x"), F.max("x")).first()
    lam, low, high, last = start, -math.inf, math.inf, 0.0
    for _ in range(rounds if least != most else 0):
        found = _slope(values, centre, lam)
        if found is None:  # out of the range of numbers
            lam = (lam + last) / 2
            continue
        slope, bend = found
        low, high = (lam, high) if slope > 0 else (low, lam)
        last = lam
        lam = lam - slope / bend if bend < 0 else lam + math.copysign(1.0, slope)
        if not low < lam < high:
            lam = (low + high) / 2 if math.isfinite(low + high) else last + math.copysign(1.0, slope)
        if abs(lam - last) < tolerance:
            break
    return BoxCox(column, lam, shift)
