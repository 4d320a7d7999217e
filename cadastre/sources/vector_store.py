"""Content-addressed vectors, text fingerprints and reusable artifacts, all as parquet tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cadastre.operators.joins import lookup_join
from cadastre.operators.vectors import add_local_vectors, zero_vector
from cadastre.session import small_table

MANIFEST = "name string, dims int, seed int, fingerprint string, path string, written double"


def text_key(text: str | Column, model: str) -> Column:
    """sha256 of "model|text"."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.concat(F.lit(model + "|"), text), 256)


def hits(texts: DataFrame, store: DataFrame, model: str, text: str = "text", dims: int = 64) -> DataFrame:
    """Rows with their stored vector; NULL where the store has none."""
    keyed = texts.withColumn("key", text_key(text, model))
    return lookup_join(keyed, store.select("key", "vector"), "key", "left", 4 * dims + 96)


def misses(texts: DataFrame, store: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Distinct texts the store lacks; copies of a text are merged before the shuffle."""
    keyed = texts.filter(F.col(text).isNotNull()).select(text_key(text, model).alias("key"), F.col(text).alias("text"))
    unique = keyed.groupBy("key").agg(F.min("text").alias("text"))
    return unique.join(store.select("key"), "key", "left_anti")


def add(store_path: str, vectors: DataFrame) -> None:
    vectors.select("key", "vector").write.mode("append").parquet(store_path)


def complete(
    texts: DataFrame, store: DataFrame, model: str, dims: int, text: str = "text", compute: bool = True
) -> DataFrame:
    """A vector for every row: stored, else computed from its terms, else zeros."""
    found = hits(texts, store, model, text, dims)
    usable = F.lit(compute) & (F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0)
    made = F.lit(None).cast("array<float>")
    if compute:
        found, made = add_local_vectors(found, text, dims, "__made"), F.col("__made")
    source = F.when(F.col("vector").isNotNull(), "stored").when(usable, "computed").otherwise("zero")
    filled = F.coalesce(F.col("vector"), F.when(usable, made), zero_vector(dims))
    return found.withColumn("vector_source", source).withColumn("vector", filled).drop("__made")


def fingerprint(df: DataFrame, key: str, text: str) -> DataFrame:
    """Row count and an order-free digest of (key, text) pairs, combined by xor across tasks."""
    digest = F.md5(F.concat_ws("\u0000", F.col(key).cast("string"), F.coalesce(F.col(text), F.lit(""))))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("n_texts"), F.coalesce(F.bit_xor(number), F.lit(0)).alias("digest"))


def ordered_fingerprint(df: DataFrame, key: str, text: str) -> DataFrame:
    """Row count and a digest of the texts in the order of their keys.

    Each row's number comes from its key and its text, both with their lengths (-1 for NULL), so texts that change places change the digest;
    numbers are added, so repeated rows count. Sums of parts add up in any order: tasks and row ranges combine before the shuffle.
    """
    sized = lambda c: F.concat(F.coalesce(F.length(c), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))
    digest = F.md5(F.concat(sized(F.col(key).cast("string")), sized(F.col(text))))
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20, 0)")).cast("decimal(38, 0)")
    return df.agg(F.count("*").alias("n_texts"), *[F.coalesce(half(at), F.lit(0)).cast("string").alias(n) for at, n in ((1, "high"), (17, "low"))])


def fingerprint_text(df: DataFrame, key: str, text: str) -> str:
    row = ordered_fingerprint(df, key, text).first()
    return f"{row['n_texts']}-{int(row['high']):x}-{int(row['low']):x}"


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException:
        return small_table(spark, [], MANIFEST)


def find_artifact(spark: SparkSession, root: str, name: str, dims: int, seed: int, digest: str) -> DataFrame | None:
    """The stored table, only when name, dimension, seed and text fingerprint all match."""
    match = _manifest(spark, root).filter(
        (F.col("name") == name) & (F.col("dims") == dims) & (F.col("seed") == seed) & (F.col("fingerprint") == digest)
    )
    row = match.orderBy(F.desc("written")).first()
    return None if row is None else spark.read.parquet(row["path"])


def reuse_or_build(
    spark: SparkSession, root: str, name: str, dims: int, seed: int, digest: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Reuse a valid artifact or build, store and register it (data first, manifest last)."""
    found = find_artifact(spark, root, name, dims, seed, digest)
    if found is not None:
        return found
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    build().write.parquet(path)
    row = [(name, dims, seed, digest, path, time.time())]
    small_table(spark, row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return spark.read.parquet(path)
