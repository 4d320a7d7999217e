"""Linear models of many feature sets, folds and seeds from one pass: sums of products by fold.

One job adds up the products of all columns (and the label) within each fold. The fit of any subset of columns is
then the solution of a sub-matrix, the training side of a held-out fold is the total less that fold, and the held-out
error is a quadratic form of the fold's own matrix, so no further pass over the rows is needed. What reaches the driver is a matrix
a fold, bounded by the columns and not by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.operators.models import mode_columns, parse_modes
from cadastre.session import small_table

WIDEST = 1_000  # columns; a task holds a matrix of their square a fold


@dataclass(frozen=True)
class LinearFit:
    """price = intercept + sum of coefficients x columns; `rmse` over the held-out rows (None without any)."""

    columns: list[str]
    intercept: float
    coefficients: list[float]
    n_train: int
    n_held: int
    rmse: float | None

    def predict(self) -> Column:
        terms = [F.col(f"`{c}`").cast("double") * F.lit(b) for c, b in zip(self.columns, self.coefficients)]
        return sum(terms, F.lit(self.intercept))


@dataclass(frozen=True)
class FoldGrams:
    """columns, then the label; (assignment, fold) -> sums of products of 1, the shifted columns and the shifted label."""

    columns: list[str]
    shift: np.ndarray
    sums: dict[tuple[str, int], np.ndarray]

    def folds(self, assignment: str) -> list[int]:
        return sorted(fold for name, fold in self.sums if name == assignment)

    def ridge(self, columns: Sequence[str], assignment: str, held: Sequence[int] = (), penalty: float = 0.0) -> LinearFit:
        """Least squares on the rows outside the `held` folds, with `penalty` on the standardised coefficients.

        Columns that are constant there get the coefficient 0, repeated columns share theirs.
        """
        size = len(self.columns) + 1
        zero = np.zeros((size, size))
        out = sum((self.sums[assignment, f] for f in self.folds(assignment) if f in held), zero)
        used = sum((self.sums[assignment, f] for f in self.folds(assignment) if f not in held), zero)
        at = [self.columns.index(c) + 1 for c in columns]
        n, label = used[0, 0], size - 1
        if not n:
            raise ValueError("no training rows outside the held-out folds")
        centred = used - np.outer(used[0], used[0]) / n
        spread = np.sqrt(np.maximum(centred.diagonal(), 0.0) / n)
        width = np.array([spread[i] if spread[i] > 1e-12 * np.sqrt(used[i, i] / n) else 0.0 for i in at])
        divisor = np.where(width > 0, width, 1.0)
        matrix = centred[np.ix_(at, at)] / np.outer(divisor, divisor) / n
        target = np.where(width > 0, centred[at, label] / divisor / n, 0.0)
        matrix[width == 0], matrix[:, width == 0] = 0.0, 0.0
        slopes = np.linalg.pinv(matrix + penalty * np.eye(len(at)), hermitian=True) @ target / divisor
        level = (used[0, label] - slopes @ used[0, at]) / n
        error = None
        if out[0, 0]:
            weights = np.zeros(size)
            weights[[0, *at]], weights[label] = [-level, *-slopes], 1.0
            error = float(np.sqrt(max(weights @ out @ weights, 0.0) / out[0, 0]))
        intercept = level + self.shift[-1] - slopes @ self.shift[[i - 1 for i in at]]
        return LinearFit(list(columns), float(intercept), slopes.tolist(), round(n), round(out[0, 0]), error)


def fit_grams(df: DataFrame, columns: Sequence[str], label: str, folds: Mapping[str, Column]) -> FoldGrams:
    """Sums of products by fold, for every assignment of rows to folds (one a seed, say), in one pass after the means.

    Rows with a NULL or not finite number in any column or the label are left out, as are rows of a NULL fold in that assignment.
    """
    if len(columns) > WIDEST:
        raise ValueError(f"{len(columns)} columns, at most {WIDEST}")
    names, size = list(folds), len(columns) + 2  # with 1 and the label
    values = [F.col(f"`{c}`").cast("double") for c in [*columns, label]]
    rows = df.select(*[v.alias(f"x{i}") for i, v in enumerate(values)], *[c.cast("int").alias(f"f{k}") for k, c in enumerate(folds.values())])
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    for i in range(size - 1):
        rows = rows.filter(finite(F.col(f"x{i}")))
    means = rows.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(size - 1)]).first()
    shift = np.array([m or 0.0 for m in means])
    upper = np.triu_indices(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            numbers = np.column_stack([np.ones(batch.num_rows), *[batch.column(i).to_numpy() for i in range(len(shift))]])
            numbers[:, 1:] -= shift
            for k in range(len(names)):
                fold = batch.column(len(shift) + k).fill_null(-1).to_numpy()
                for f in np.unique(fold[fold >= 0]):
                    some = numbers[fold == f]
                    sums[k, int(f)] = sums.get((k, int(f)), 0.0) + some.T @ some
        for (k, f), matrix in sums.items():
            flat = matrix[upper]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), k, np.int32)), pa.array(np.full(len(flat), f, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["k", "fold", "at", "v"]
            )

    added = rows.mapInArrow(add, "k int, fold int, at int, v double").groupBy("k", "fold", "at").agg(F.sum("v").alias("v")).toArrow()
    found: dict[tuple[str, int], np.ndarray] = {}
    k, fold, at, v = (added.column(c).to_numpy() for c in ("k", "fold", "at", "v"))
    for i, f in sorted(set(zip(k.tolist(), fold.tolist()))):
        here, matrix = (k == i) & (fold == f), np.zeros((size, size))
        matrix[upper[0][at[here]], upper[1][at[here]]] = v[here]
        found[names[i], int(f)] = matrix + np.triu(matrix, 1).T
    return FoldGrams([*columns, label], shift, found)


def linear_modes(
    df: DataFrame, groups: Mapping[str, Sequence[str]], modes: str | Sequence[str], label: str, folds: Mapping[str, Column], penalty: float = 0.0
) -> DataFrame:
    """(mode, assignment, fold, n_train, n_held, rmse): every mode with every fold held out in turn; a mode that lacks a group gives no rows."""
    chosen = {m: cols for m in parse_modes(modes) if (cols := mode_columns(m, groups))}
    grams = fit_grams(df, list(dict.fromkeys(c for cols in chosen.values() for c in cols)), label, folds)
    rows = []
    for mode, columns in chosen.items():
        for name in folds:
            for fold in grams.folds(name) if len(grams.folds(name)) > 1 else []:
                fit = grams.ridge(columns, name, [fold], penalty)
                rows.append((mode, name, fold, fit.n_train, fit.n_held, fit.rmse))
    return small_table(df.sparkSession, rows, "mode string, assignment string, fold int, n_train long, n_held long, rmse double")
