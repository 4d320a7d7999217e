"""Row and column housekeeping: dedup, profiles, column choice, alignment, validity, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.functions.numeric import is_finite, pick_number_columns, pick_text_columns  # noqa: F401
from cadastre.session import small_table

TRAIN = "split = 'train'"


def where(df: DataFrame, condition: str | Column | None) -> DataFrame:
    if condition is None:
        return df
    return df.filter(F.expr(condition) if isinstance(condition, str) else condition)


def dedup(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct whole rows (or distinct by a column list)."""
    return df.dropDuplicates(list(columns) if columns else None)


def dedup_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows went away."""
    counts = [before.agg(F.count("*").alias("n")).select(F.lit("before").alias("stage"), "n"),
              after.agg(F.count("*").alias("n")).select(F.lit("after").alias("stage"), "n")]
    both = counts[0].unionByName(counts[1])
    n = lambda stage: F.sum(F.when(F.col("stage") == stage, F.col("n")).otherwise(0))
    return both.agg(n("before").alias("rows_before"), n("after").alias("rows_after"),
                    (n("before") - n("after")).alias("removed"))


def null_profile(df: DataFrame, columns: Sequence[str], by: str | None = "split") -> DataFrame:
    """NULL count per column (per group), one pass."""
    aggs = [F.count("*").alias("n_rows")] + [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in columns]
    return (df.groupBy(by) if by else df.groupBy()).agg(*aggs)


def needs_imputing(df: DataFrame, columns: Sequence[str]) -> bool:
    row = df.agg(*[F.max(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return any(row[f"m{i}"] for i in range(len(columns)))


def filled_share(df: DataFrame, columns: Sequence[str], fit_on: str | Column | None = TRAIN) -> dict[str, float]:
    row = where(df, fit_on).agg(
        *[F.try_divide(F.count(f"`{c}`"), F.count("*")).alias(f"s{i}") for i, c in enumerate(columns)]
    ).first()
    return {c: row[f"s{i}"] or 0.0 for i, c in enumerate(columns)}


def keep_filled(
    df: DataFrame, columns: Sequence[str], share: float = 0.5, fit_on: str | Column | None = TRAIN
) -> DataFrame:
    """Drop the listed columns unless more than `share` of the training rows carry a value."""
    filled = filled_share(df, columns, fit_on)
    return df.drop(*[c for c in columns if not filled[c] > share])


def drop_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop key, target or leaking columns, ignoring absent ones."""
    return df.drop(*columns)


def align(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), fill: float = 0) -> DataFrame:
    """Exactly `keys` + `columns` in that order: absent ones added as `fill`, extra ones dropped."""
    have = set(df.columns)
    return df.select(
        *[F.col(f"`{k}`") for k in keys],
        *[
            (F.coalesce(F.col(f"`{c}`"), F.lit(fill)) if c in have else F.lit(fill)).alias(c)
            for c in columns
        ],
    )


def valid_pairs(df: DataFrame, truth: str, pred: str, truth_floor: float | None = 0, pred_floor: float | None = -1) -> DataFrame:
    """Rows with finite truth and prediction at or above their floors."""
    condition = is_finite(truth) & is_finite(pred)
    if truth_floor is not None:
        condition = condition & (F.col(truth) >= truth_floor)
    if pred_floor is not None:
        condition = condition & (F.col(pred) >= pred_floor)
    return df.filter(condition)


def replace_where(df: DataFrame, column: str, condition: Column, value: Column | float | str) -> DataFrame:
    value = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def gather(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is listed (repeated keys repeat the row)."""
    return keys.select(on).join(df, on)


def stack(*frames: DataFrame, order: str | None = None) -> DataFrame:
    """Union by name; with `order`, a column tells the position of each part."""
    out = None
    for position, frame in enumerate(frames):
        part = frame.withColumn(order, F.lit(position)) if order else frame
        out = part if out is None else out.unionByName(part)
    return out


def key_union(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys present on either side."""
    return left.select(*keys).unionByName(right.select(*keys)).distinct()


def unseen_values(df: DataFrame, column: str, fit_on: str = TRAIN) -> DataFrame:
    """Values outside the training rows only; one pass with partial aggregation."""
    flagged = df.groupBy(column).agg(F.max(F.expr(fit_on)).alias("seen"), F.count("*").alias("n_rows"))
    return flagged.filter(~F.col("seen") & F.col(column).isNotNull()).select(column, "n_rows")


def join_blocks(blocks: Sequence[DataFrame], key: str = "row_id", how: str = "left") -> DataFrame:
    """Feature blocks side by side by key, never by position."""
    out = blocks[0]
    for block in blocks[1:]:
        out = out.join(block, key, how)
    return out


def column_statistics(df: DataFrame, columns: Sequence[str], fit_on: str | Column | None = TRAIN) -> DataFrame:
    """One row per column: count, min, quartiles, max, biased skewness."""
    from cadastre.operators.quantiles import exact_quantiles

    rows = where(df, fit_on)
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.skewness(v).alias(f"sk{i}")]
    row = rows.agg(*aggs).first()
    quartiles = exact_quantiles(rows, {c: [0.25, 0.5, 0.75] for c in columns})
    out = [
        (c, row[f"n{i}"], row[f"lo{i}"], *quartiles[c], row[f"hi{i}"], row[f"sk{i}"]) for i, c in enumerate(columns)
    ]
    return small_table(
        df.sparkSession, out, "column string, n_filled bigint, low double, q25 double, mid double, q75 double, high double, skew double"
    )
