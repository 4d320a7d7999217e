"""Regression metrics as aggregates, grouped by any keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.functions.numeric import clip, clip_range, col
from cadastre.functions.numeric import is_finite


def mse(truth, pred) -> Column:
    gap = col(truth) - col(pred)
    return F.avg(gap * gap)


def rmse(truth, pred) -> Column:
    return F.sqrt(mse(truth, pred))


def mae(truth, pred) -> Column:
    return F.avg(F.abs(col(truth) - col(pred)))


def r2(truth, pred) -> Column:
    """1 - SSE/SST; NULL when the truth is constant."""
    t, gap = col(truth), col(truth) - col(pred)
    return F.lit(1.0) - F.try_divide(F.sum(gap * gap), F.count(t) * F.var_pop(t))


def rmsle(truth, pred, truth_floor: float = 0.0, pred_floor: float = 0.0, factor: float = 1.0) -> Column:
    """Root mean squared error of log1p values.

    Variants: both floored at 0 (default), prediction floored at -1, or values times `factor`.
    Pairs with a missing side do not count. A value of -1 or less that no floor lifts has no finite logarithm:
    the error of its group is infinite, as it is for the whole set in the original formula.
    """
    t = clip_range(col(truth) * F.lit(factor), truth_floor, None)
    p = clip_range(col(pred) * F.lit(factor), pred_floor, None)
    log = lambda c: F.when(c <= -1, F.lit(float("-inf"))).otherwise(F.log1p(c))
    gap = F.when((t <= -1) & (p <= -1), F.lit(0.0)).otherwise(log(t) - log(p))
    return F.sqrt(F.avg(gap * gap))


def log_rmse(truth_log, pred_log, bound: float = 20.0) -> Column:
    """RMSE in log space with clipped predictions."""
    return rmse(truth_log, clip(pred_log, bound))


def evaluate(
    df: DataFrame,
    truth: str,
    pred: str,
    by: Sequence[str] = (),
    drop_invalid: bool = True,
    factor: float = 1.0,
    pred_floor: float = 0.0,
) -> DataFrame:
    """RMSE, MAE, R2 and RMSLE per group.

    RMSE, MAE and R2 take every pair of finite numbers, however far off the prediction; `n_rows` counts them and
    `n_dropped` the others. RMSLE leaves out, by default, pairs with a negative truth or a prediction below -1, and these only
    for itself.
    """
    finite = is_finite(F.col(truth)) & is_finite(F.col(pred))
    t, p = F.when(finite, F.col(truth)), F.when(finite, F.col(pred))
    usable = (F.col(truth) >= 0) & (F.col(pred) >= -1) if drop_invalid else F.lit(True)
    return df.groupBy(*by).agg(
        F.count(F.when(finite, True)).alias("n_rows"),
        F.count(F.when(F.coalesce(~finite, F.lit(True)), True)).alias("n_dropped"),
        mse(t, p).alias("mse"),
        rmse(t, p).alias("rmse"),
        mae(t, p).alias("mae"),
        r2(t, p).alias("r2"),
        rmsle(F.when(usable, t), F.when(usable, p), pred_floor=pred_floor, factor=factor).alias("rmsle"),
    )


def back_transform(df: DataFrame, pred: str, undo, out: str, scale: str | None = None) -> DataFrame:
    """Prediction in price space: `undo` on the column, times the stored size scale if there is one."""
    value = undo(F.col(pred))
    if scale:
        value = value * F.col(scale)
    return df.withColumn(out, value)


def ensemble_mean(predictions: DataFrame, key: Sequence[str], pred: str = "prediction", out: str = "ensemble") -> DataFrame:
    """Row mean over the models' predictions (long table)."""
    return predictions.groupBy(*key).agg(F.avg(pred).alias(out), F.count(pred).alias("n_models"))
