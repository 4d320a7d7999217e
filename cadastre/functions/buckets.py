"""Threshold buckets: ordered bands compiled to one CASE expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadastre.functions.numeric import col


def cascade(rules: Sequence[tuple[Column, str | Column]], default: str | Column | None = None) -> Column:
    """First rule that holds wins; `default` when none does."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = None
    for condition, label in rules:
        out = F.when(condition, as_col(label)) if out is None else out.when(condition, as_col(label))
    return out.otherwise(as_col(default))


def bucket(
    value: str | Column,
    bands: Sequence[tuple[float, str]],
    above: str | None = None,
    closed: str = "left",
    missing: str | None = "unknown",
) -> Column:
    """Label of the first band that holds the value.

    `closed="left"` compares with `<` (a band ends before its threshold), `closed="right"`
    with `<=`, `closed="mixed"` takes `<` for the first band and `<=` for later ones.
    Without `above`, values past the last threshold take the last label.
    """
    if closed not in ("left", "right", "mixed"):
        raise ValueError(f"closed must be left, right or mixed, not {closed!r}")
    c = col(value)
    rules: list[tuple[Column, str | Column]] = [(c.isNull(), F.lit(missing))]
    for position, (threshold, label) in enumerate(bands):
        strict = closed == "left" or (closed == "mixed" and position == 0)
        rules.append((c < threshold if strict else c <= threshold, label))
    return cascade(rules, bands[-1][1] if above is None else above)
