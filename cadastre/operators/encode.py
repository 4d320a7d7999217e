"""Category encoders fitted on training rows.

Codes follow the sorted order of the training values. Few categories become a literal map;
many become a code table for `lookup_join`, numbered without sorting the values in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.operators.impute import fit_median, modes
from cadastre.operators.joins import lookup_join
from cadastre.operators.rows import TRAIN, where

LITERAL_LIMIT = 256  # categories held as a literal map
SPLIT_POINTS = 255


def text_value(column: str) -> Column:
    """Category as text; a missing one is the category "None"."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("None"))


def _literal_map(table: Mapping[str, float], out: str) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*entries).cast(f"map<string,{out}>")


def categories(df: DataFrame, column: str) -> DataFrame:
    return df.select(text_value(column).alias("value")).distinct()


def value_counts(df: DataFrame, columns: Sequence[str], limit: int = LITERAL_LIMIT) -> dict[str, dict[str, int] | None]:
    """{column: {category: rows}} in sorted order, None for a column with more than `limit` categories.

    One job for all columns; at most limit + 1 categories per column come back.
    """
    if not columns:
        return {}
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), text_value(c).alias("v")) for c in columns])).alias("e")
    ).select("e.c", "e.v")
    counted = long.groupBy("c", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("c").orderBy("v")
    rows = counted.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit + 1).collect()
    found: dict[str, dict[str, int]] = {c: {} for c in columns}
    for r in sorted(rows, key=lambda r: r["v"]):
        found[r["c"]][r["v"]] = r["n"]
    return {c: counts if len(counts) <= limit else None for c, counts in found.items()}


def most_frequent(counts: Mapping[str, int]) -> str | None:
    return min(counts, key=lambda v: (-counts[v], v)) if counts else None


def numbered(values: DataFrame) -> DataFrame:
    """(value, code) with codes 0.. in sorted order over a distinct `value` column.

    A bounded sample gives split points; values are counted per range, ranked inside their
    range, and shifted by the counts before it.
    """
    sample = sorted(r["value"] for r in values.orderBy(F.xxhash64("value")).limit(16 * SPLIT_POINTS).collect())
    points = sorted({sample[len(sample) * i // (SPLIT_POINTS + 1)] for i in range(1, SPLIT_POINTS + 1)}) if sample else []
    if not points:
        return values.select("value", F.lit(0).alias("code"))
    cuts = F.array(*[F.lit(p) for p in points])
    placed = values.withColumn("part", F.size(F.filter(cuts, lambda p: p <= F.col("value"))))
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in range(len(points) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    offset = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("part") + 1)
    rank = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    return placed.select("value", (rank + offset).cast("int").alias("code"))


@dataclass(frozen=True)
class Ordinal:
    """value -> code with a code for unseen values."""

    column: str
    default: int
    table: Mapping[str, int] | None = None  # few categories
    codes: DataFrame | None = None  # many categories

    def apply(self, df: DataFrame, out: str | None = None) -> DataFrame:
        out = out or self.column
        if self.table is not None:
            if not self.table:
                return df.withColumn(out, F.lit(self.default))
            code = F.element_at(_literal_map(self.table, "int"), text_value(self.column))
            return df.withColumn(out, F.coalesce(code, F.lit(self.default)))
        codes = self.codes.select(F.col("value").alias("__key"), F.col("code").alias("__code"))
        joined = lookup_join(df.withColumn("__key", text_value(self.column)), codes, "__key")
        return joined.withColumn(out, F.coalesce(F.col("__code"), F.lit(self.default))).drop("__key", "__code")

    def restore(self, df: DataFrame, code: str, out: str) -> DataFrame:
        """Code back to its category; unknown codes give NULL."""
        if self.table is not None:
            names = [v for v, _ in sorted(self.table.items(), key=lambda kv: kv[1])]
            position = F.when(F.col(code) >= 0, F.col(code).cast("int") + 1)
            return df.withColumn(out, F.try_element_at(F.array(*[F.lit(n) for n in names]), position))
        codes = self.codes.select(F.col("value").alias(out), F.col("code").alias("__code"))
        return lookup_join(df.withColumn("__code", F.col(code).cast("int")), codes, "__code").drop("__code")


def fit_ordinals(
    df: DataFrame,
    columns: Sequence[str],
    unseen: str = "mode",
    fit_on: str | Column | None = TRAIN,
    literal_limit: int = LITERAL_LIMIT,
) -> dict[str, Ordinal]:
    """`unseen`: "mode" (most frequent training value), "none" ("None" if it is a class, else the
    first), "zero" ("None" if it is a class, else 0) or "minus_one"."""
    if unseen not in ("mode", "none", "zero", "minus_one"):
        raise ValueError(f"unknown rule for unseen values: {unseen!r}")
    train = where(df, fit_on)
    out = {}
    for column, counts in value_counts(train, columns, literal_limit).items():
        if counts is not None:
            table, codes = {v: i for i, v in enumerate(counts)}, None
            top, code_of = most_frequent(counts), table.get
        else:
            table, codes = None, numbered(categories(train, column))
            top = modes(train.select(text_value(column).alias(column)), [column])[column] if unseen == "mode" else None

            def code_of(value, default=0, codes=codes):
                row = codes.filter(F.col("value") == F.lit(value)).first()
                return default if row is None else row["code"]

        if unseen == "minus_one":
            default = -1
        else:
            default = code_of(top if unseen == "mode" else "None", 0) if top is not None or unseen != "mode" else 0
        out[column] = Ordinal(column, default, table, codes)
    return out


def fit_ordinal(
    df: DataFrame,
    column: str,
    unseen: str = "mode",
    fit_on: str | Column | None = TRAIN,
    literal_limit: int = LITERAL_LIMIT,
) -> Ordinal:
    return fit_ordinals(df, [column], unseen, fit_on, literal_limit)[column]


@dataclass(frozen=True)
class OneHot:
    """0/1 columns `<column>_<value>` for the training categories; an unseen value is all zeros."""

    column: str
    names: Sequence[str]

    @property
    def columns(self) -> list[str]:
        return [f"{self.column}_{v}" for v in self.names]

    def exprs(self) -> dict[str, Column]:
        value = text_value(self.column)
        return {f"{self.column}_{v}": (value == F.lit(v)).cast("int") for v in self.names}

    def apply(self, df: DataFrame, drop: bool = True) -> DataFrame:
        out = df.withColumns(self.exprs()) if self.names else df
        return out.drop(self.column) if drop else out


def fit_onehots(
    df: DataFrame, columns: Sequence[str], fit_on: str | Column | None = TRAIN, max_columns: int = 2_000
) -> list[OneHot]:
    out = []
    for column, counts in value_counts(where(df, fit_on), columns, max_columns).items():
        if counts is None:
            raise ValueError(f"{column} has more than {max_columns} categories: use sparse_onehot or an ordinal code")
        out.append(OneHot(column, list(counts)))
    return out


def fit_onehot(df: DataFrame, column: str, fit_on: str | Column | None = TRAIN, max_columns: int = 2_000) -> OneHot:
    return fit_onehots(df, [column], fit_on, max_columns)[0]


def sparse_onehot(df: DataFrame, ordinal: Ordinal, out: str) -> DataFrame:
    """Wide one-hot as a sparse ML vector from an ordinal code fitted with `unseen="minus_one"`."""
    from pyspark.ml.feature import OneHotEncoder

    coded = ordinal.apply(df, "__ord")
    size = len(ordinal.table) if ordinal.table is not None else ordinal.codes.count()
    coded = coded.withColumn("__ord", F.when(F.col("__ord") < 0, F.lit(size)).otherwise(F.col("__ord")).cast("double"))
    probe = df.sparkSession.range(1).select(F.lit(float(size)).alias("__ord"))
    model = OneHotEncoder(inputCols=["__ord"], outputCols=[out], dropLast=True).fit(probe)
    return model.transform(coded).drop("__ord")


@dataclass(frozen=True)
class Frequency:
    """Training share of a category; unseen values get 0."""

    column: str
    table: Mapping[str, float] | None
    shares: DataFrame | None = None

    def apply(self, df: DataFrame, out: str) -> DataFrame:
        if self.table is not None:
            if not self.table:
                return df.withColumn(out, F.lit(0.0))
            share = F.element_at(_literal_map(self.table, "double"), text_value(self.column))
            return df.withColumn(out, F.coalesce(share, F.lit(0.0)))
        joined = lookup_join(df.withColumn("__key", text_value(self.column)), self.shares, "__key")
        return joined.withColumn(out, F.coalesce(F.col("__share"), F.lit(0.0))).drop("__key", "__share")


def fit_frequency(df: DataFrame, column: str, fit_on: str | Column | None = TRAIN, literal_limit: int = LITERAL_LIMIT) -> Frequency:
    train = where(df, fit_on)
    counts = value_counts(train, [column], literal_limit)[column]
    if counts is not None:
        total = sum(counts.values())
        return Frequency(column, {v: n / total for v, n in counts.items()})
    total = train.count()
    shares = train.groupBy(text_value(column).alias("__key")).agg((F.count("*") / F.lit(total)).alias("__share"))
    return Frequency(column, None, shares)


def relative_frequency(df: DataFrame, column: str) -> DataFrame:
    """Share per category of the whole frame."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.count()
    return counted.select(column, "n", (F.col("n") / F.lit(total)).alias("share"))


@dataclass(frozen=True)
class NeighborEncoding:
    ordinals: Mapping[str, Ordinal]
    fill: object

    def apply(self, df: DataFrame) -> DataFrame:
        for ordinal in self.ordinals.values():
            df = ordinal.apply(df)
        return self.fill.apply(df)


def fit_neighbor_encoding(
    df: DataFrame, text: Sequence[str], numeric: Sequence[str], fit_on: str | Column | None = TRAIN
) -> NeighborEncoding:
    """Neighbour features to numbers: text to codes ("None" or 0 when unseen), numbers to median-filled."""
    return NeighborEncoding(fit_ordinals(df, text, "zero", fit_on), fit_median(df, numeric, fit_on))
