"""A vector store that grows: batches of buckets by key prefix, listed in a manifest when they are complete.

A lookup reads only the buckets that its keys fall into. Texts that the store lacks are computed once, however often they
occur, and appended as one batch; a batch that was not finished is not listed and never read.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cadastre.operators.joins import lookup_join
from cadastre.operators.vectors import add_local_vectors, zero_vector
from cadastre.session import materialize, small_table
from cadastre.sources.vector_store import text_key

MANIFEST = "model string, dims int, path string, rows bigint, written double"
VECTORS = "key string, vector array<float>, bucket string"


@dataclass(frozen=True)
class Lookup:
    """Rows with `vector` and `vector_source`, how many texts were computed, and how many files of the store were read of how many."""

    rows: DataFrame
    computed: int
    files_read: int
    files: int


def batches(spark: SparkSession, root: str, model: str, dims: int) -> list[str]:
    try:
        lines = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException:
        return []
    return [r["path"] for r in lines.filter((F.col("model") == model) & (F.col("dims") == dims)).select("path").collect()]


def stored(spark: SparkSession, root: str, model: str, dims: int) -> DataFrame:
    paths = batches(spark, root, model, dims)
    if not paths:
        return small_table(spark, [], VECTORS)
    found = spark.read.schema(VECTORS).option("basePath", paths[0]).parquet(paths[0])
    for path in paths[1:]:
        found = found.unionByName(spark.read.schema(VECTORS).option("basePath", path).parquet(path))
    return found


def append(root: str, vectors: DataFrame, model: str, dims: int) -> int:
    """Write one batch and list it; an empty one is not listed."""
    spark, path = vectors.sparkSession, f"{root}/batch-{uuid.uuid4().hex}"
    vectors.select("key", "vector", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(path)
    rows = spark.read.schema(VECTORS).parquet(path).count()
    if rows:
        small_table(spark, [(model, dims, path, rows, time.time())], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return rows


def look_up(texts: DataFrame, root: str, model: str, dims: int, text: str = "text", digits: int = 2) -> Lookup:
    """A vector for every row: stored, or computed from its terms and stored now, or zeros for a text without words.

    `digits` hexadecimal digits of the key are its bucket: 16 ** digits buckets bound the list of those in demand.
    """
    spark = texts.sparkSession
    filled = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0
    keyed = materialize(texts.withColumn("key", F.when(filled, text_key(text, model))).withColumn("bucket", F.substring("key", 1, digits)), "keyed")
    wanted = [r["bucket"] for r in keyed.filter("bucket IS NOT NULL").select("bucket").distinct().collect()]
    everything = stored(spark, root, model, dims)
    known = everything.filter(F.col("bucket").isin(wanted)).select("key", "vector") if wanted else everything.limit(0).select("key", "vector")
    lacking = keyed.filter("key IS NOT NULL").groupBy("key", "bucket").agg(F.min(text).alias("text")).join(known.select("key"), "key", "left_anti")
    computed = append(root, add_local_vectors(lacking, "text", dims, "vector"), model, dims)
    read = len([f for f in everything.inputFiles() if f.rsplit("bucket=", 1)[-1].split("/")[0] in set(wanted)])
    fresh = stored(spark, root, model, dims).filter(F.col("bucket").isin(wanted)).select("key", "vector", F.lit(True).alias("there")) if wanted else small_table(spark, [], "key string, vector array<float>, there boolean")
    old = known.select("key", F.lit("stored").alias("vector_source"))
    rows = lookup_join(lookup_join(keyed.drop("bucket"), fresh, "key", "left", 4 * dims + 96), old, "key", "left", 96)
    source = F.when(F.col("key").isNull(), "zero").otherwise(F.coalesce("vector_source", F.lit("computed")))
    rows = rows.withColumn("vector_source", source).withColumn("vector", F.coalesce("vector", zero_vector(dims))).drop("there")
    return Lookup(rows, computed, read, len(everything.inputFiles()))
