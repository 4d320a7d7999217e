"""Vector columns: lookup of stored vectors, checks, reduction and clustering."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastre import kernels
from cadastre.operators.rows import TRAIN, where


def zero_vector(dims: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dims)


def add_local_vectors(df: DataFrame, text: str, dims: int, out: str) -> DataFrame:
    """Hashed term counts of every text as a float array, for texts no store knows."""
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    terms = RegexTokenizer(inputCol="__text", outputCol="__terms", pattern="\\W+")
    counts = HashingTF(inputCol="__terms", outputCol="__counts", numFeatures=dims)
    ready = terms.transform(df.withColumn("__text", F.coalesce(F.col(text), F.lit(""))))
    return counts.transform(ready).withColumn(out, vector_to_array("__counts", "float32")).drop("__text", "__terms", "__counts")


def block_report(df: DataFrame, vector: str, by: str | None = None) -> DataFrame:
    """Rows, largest absolute component and an all-zero flag per block."""
    largest = F.array_max(F.transform(F.col(vector), lambda x: F.abs(x)))
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(F.count("*").alias("n_rows"), F.max(largest).alias("largest")).withColumn(
        "all_zero", (F.coalesce("largest", F.lit(0.0)) == 0).cast("int")
    )


def to_columns(df: DataFrame, vector: str, dims: int, prefix: str = "emb_") -> DataFrame:
    """One column per component; missing components are NULL."""
    return df.withColumns({f"{prefix}{i}": F.try_element_at(F.col(vector), F.lit(i + 1)) for i in range(dims)})


def gram(df: DataFrame, vector: str, dims: int, offset: np.ndarray | None = None) -> tuple[np.ndarray, int, np.ndarray]:
    """Gram matrix, row count and column sums of (optionally shifted) vectors.

    Partitions sum their own part; rows of the matrix are then added across partitions.
    """
    v = F.col(vector).cast("array<double>")
    if offset is not None:
        v = F.zip_with(v, F.array(*[F.lit(float(x)) for x in offset]), lambda a, b: a - b)
    rows = df.select(v.alias("vec"))
    head = rows.agg(F.count("*").alias("n"), Summarizer.sum(array_to_vector("vec")).alias("s")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism  # partial matrices a core, not a partition
    parts = rows.coalesce(cores).mapInArrow(kernels.partial_gram(dims), "i int, row array<double>")
    sums = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row")).collect()
    out = np.zeros((dims, dims))
    for r in sums:
        out[r["i"]] = r["row"].toArray()
    return out, head["n"], head["s"].toArray()


@dataclass(frozen=True)
class Reduction:
    """Linear reduction (x - offset) @ components; None components leave the vectors as they are."""

    components: np.ndarray | None
    offset: np.ndarray | None
    explained: float | None

    def apply(self, df: DataFrame, vector: str, out: str = "reduced") -> DataFrame:
        if self.components is None:
            return df.withColumn(out, F.col(vector).cast("array<double>"))
        keep = [c for c in df.columns if c != out]
        fields = [df.schema[c] for c in keep] + [T.StructField("reduced", T.ArrayType(T.DoubleType()))]
        schema = T.StructType(fields)
        rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(vector).cast("array<double>").alias("vec"))
        return rows.mapInArrow(kernels.project(self.components, self.offset), schema).withColumnRenamed("reduced", out)


def _fixed_signs(components: np.ndarray) -> np.ndarray:
    """Largest loading of every component positive."""
    top = np.abs(components).argmax(0)
    signs = np.sign(components[top, np.arange(components.shape[1])])
    return components * np.where(signs == 0, 1.0, signs)


def dimension(df: DataFrame, vector: str) -> int:
    row = df.select(F.size(vector).alias("d")).filter("d > 0").first()
    if row is None:
        raise ValueError("no vectors to fit on")
    return row["d"]


def fit_pca(df: DataFrame, vector: str, dims: int, fit_on: str | Column | None = TRAIN) -> Reduction:
    """Centred principal components of the training vectors; dims is clamped to min(n, d)."""
    train = where(df, fit_on)
    width = dimension(train, vector)
    mean = train.agg(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).first()[0].toArray()
    scatter, n, _ = gram(train, vector, width, mean)
    values, basis = np.linalg.eigh(scatter)
    order = np.argsort(values)[::-1][: min(dims, n, width)]
    total = max(values.sum(), 0.0)
    explained = float(values[order].sum() / total) if total > 0 else None
    return Reduction(_fixed_signs(basis[:, order]), mean, explained)


def fit_svd(df: DataFrame, vector: str, dims: int, fit_on: str | Column | None = TRAIN) -> Reduction:
    """Truncated, uncentred SVD; at most min(n - 1, d); a request >= d leaves vectors unchanged."""
    train = where(df, fit_on)
    width = dimension(train, vector)
    if dims >= width:
        return Reduction(None, None, None)
    product, n, total = gram(train, vector, width)
    values, basis = np.linalg.eigh(product)
    order = np.argsort(values)[::-1][: max(1, min(dims, n - 1, width))]
    components = _fixed_signs(basis[:, order])
    mean = total / n
    kept = (components * (product @ components)).sum(0) / n - (mean @ components) ** 2
    overall = np.trace(product) / n - (mean @ mean)
    return Reduction(components, np.zeros(width), float(kept.sum() / overall) if overall > 0 else None)


def fit_geo_clusters(df: DataFrame, columns: Sequence[str], k: int = 12, fit_on: str | Column | None = TRAIN, seed: int = 42):
    """k-means over coordinates, fitted on training rows; k is capped by their number."""
    from pyspark.ml.clustering import KMeans

    train = where(df, fit_on).dropna(subset=list(columns))
    k = min(k, train.select(columns[0]).limit(k).count())
    points = train.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])).alias("__geo"))
    model = KMeans(k=k, seed=seed, featuresCol="__geo", predictionCol="geo_cluster").fit(points)

    def apply(frame: DataFrame) -> DataFrame:
        ready = frame.withColumn(
            "__geo", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]))
        )
        return model.transform(ready).drop("__geo")

    apply.centers = model.clusterCenters()
    return apply


__all__ = [
    "add_local_vectors", "block_report", "dimension", "fit_geo_clusters", "fit_pca", "fit_svd", "gram",
    "to_columns", "vector_to_array", "zero_vector", "Reduction",
]
