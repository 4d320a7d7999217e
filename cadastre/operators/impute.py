"""Imputers: statistics from training rows, applied to every row as literals."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.functions.numeric import finite_or, pick_number_columns, pick_text_columns
from cadastre.operators.quantiles import median
from cadastre.operators.rows import TRAIN, where
from cadastre.session import materialize


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """Replace or add several columns in one projection."""
    return df.withColumns(dict(new)) if new else df


@dataclass(frozen=True)
class Fill:
    """Literal fill values per column."""

    values: Mapping[str, float | str | None]

    def apply(self, df: DataFrame) -> DataFrame:
        types = dict(df.dtypes)
        new = {}
        for c, v in self.values.items():
            if c in types and v is not None:
                value = F.lit(v) if types[c] == "string" else F.lit(float(v))
                new[c] = F.coalesce(F.col(f"`{c}`"), value)
        return replace_columns(df, new)


def fit_median(df: DataFrame, columns: Sequence[str] | None = None, fit_on: str | Column | None = TRAIN) -> Fill:
    columns = pick_number_columns(df) if columns is None else columns
    return Fill(median(where(df, fit_on), columns))


def fit_constant(df: DataFrame, columns: Sequence[str] | None = None, value: str = "None") -> Fill:
    columns = pick_text_columns(df, skip=("split",)) if columns is None else columns
    return Fill(dict.fromkeys(columns, value))


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per text column, smallest on a tie.

    Counting is grouped by (column, value), so nothing is gathered per column; only one row
    per column comes back.
    """
    if not columns:
        return {}
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
        ).alias("e")
    ).select("e.c", "e.v")
    counted = long.filter(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count("*").alias("n"))
    top = counted.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("m"))
    found = {r["c"]: r["m"]["v"] for r in top.collect()}
    return {c: found.get(c) for c in columns}


def fit_mode(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    fit_on: str | Column | None = TRAIN,
    default: str = "unknown",
) -> Fill:
    columns = pick_text_columns(df, skip=("split",)) if columns is None else columns
    found = modes(where(df, fit_on), columns)
    return Fill({c: default if v is None else v for c, v in found.items()})


@dataclass(frozen=True)
class Chain:
    """Several fits applied in order."""

    steps: Sequence

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.apply(df)
        return df


def fit_clean(
    df: DataFrame,
    numeric: Sequence[str] | None = None,
    text: Sequence[str] | None = None,
    fit_on: str | Column | None = TRAIN,
) -> Chain:
    """Median for numbers and "None" for text; `fit_on=None` fits on the whole table."""
    return Chain([fit_median(df, numeric, fit_on), fit_constant(df, text)])


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL, NaN and infinities become 0."""
    return replace_columns(df, {c: finite_or(f"`{c}`") for c in columns})


@dataclass(frozen=True)
class TreeFill:
    """Predicted fills, one depth-5 regression tree per column that needs it, in column order."""

    medians: Mapping[str, float | None]
    trees: Sequence[tuple[str, Sequence[str], object]] = field(default_factory=tuple)

    def apply(self, df: DataFrame) -> DataFrame:
        for target, features, model in self.trees:
            df = _predict(df, target, features, model, self.medians)
        return Fill(self.medians).apply(df)


def _features(df: DataFrame, features: Sequence[str], medians: Mapping[str, float | None]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    filled = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(medians[c] or 0.0))) for c in features]
    return df.withColumn("__x", array_to_vector(F.array(*filled)))


def _predict(df, target, features, model, medians) -> DataFrame:
    scored = model.transform(_features(df, features, medians))
    value = F.coalesce(F.col(f"`{target}`").cast("double"), F.col("__p"))
    return scored.withColumn(target, value).drop("__x", "__p")


def fit_tree(
    df: DataFrame,
    columns: Sequence[str],
    fit_on: str | Column | None = TRAIN,
    min_known: int = 11,
    depth: int = 5,
    seed: int = 42,
) -> TreeFill:
    """Columns are visited in order, so later trees see earlier fills.

    A column gets a tree when training rows miss it, enough of them carry it, and at least one other
    column is known in more than half of them; otherwise, or where Spark cannot fit the tree, its training median
    is used.
    """
    from pyspark.ml.regression import DecisionTreeRegressor

    train = materialize(where(df, fit_on).select(*columns), "tree-fill")  # read once per fit, columns only
    medians = median(train, columns)
    row = train.agg(
        F.count("*").alias("n"), *[F.count(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)]
    ).first()
    known = {c: row[f"k{i}"] for i, c in enumerate(columns)}
    trees = []
    for target in columns:
        features = [c for c in columns if c != target and 2 * known[c] > row["n"]]
        if known[target] == row["n"] or known[target] < min_known or not features:
            continue
        try:
            rows = _features(train.filter(F.col(f"`{target}`").isNotNull()), features, medians)
            model = DecisionTreeRegressor(
                featuresCol="__x", labelCol="__y", predictionCol="__p", maxDepth=depth, seed=seed
            ).fit(rows.select("__x", F.col(f"`{target}`").cast("double").alias("__y")))
        except (PySparkException, Py4JJavaError) as error:
            warnings.warn(f"tree fill of {target} failed, median used: {error}", stacklevel=2)
            continue
        trees.append((target, features, model))
        train = _predict(train, target, features, model, medians)
    return TreeFill(medians, trees)
