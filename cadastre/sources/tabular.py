"""Table sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastre.functions.numeric import nan_to_null


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """CSV with a header; give a schema to avoid the inference scan. NaN becomes NULL."""
    reader = spark.read.option("header", True).options(**options)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(f"{folder}/{name}.parquet"))


_ATTRIBUTE = re.compile(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.+)", re.IGNORECASE)


def _field(line: str) -> tuple[str, str]:
    name, kind = _ATTRIBUTE.match(line.strip()).groups()
    kind = kind.strip().lower()
    if kind.startswith(("numeric", "real")):
        sql = "double"
    elif kind.startswith("integer"):
        sql = "bigint"
    else:
        sql = "string"
    return name.strip("'\""), sql


def read_attribute_relation(spark: SparkSession, path: str) -> DataFrame:
    """Attribute-relation text: columns from the @attribute lines, rows parsed as CSV, "?" is NULL.

    Only the header lines reach the driver; the rows are split by line and parsed in the tasks.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    header = lines.filter(F.lower(F.substring("value", 1, 10)) == "@attribute").collect()
    if not header:
        raise ValueError(f"{path} has no @attribute lines")
    fields = [_field(r["value"]) for r in header]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields)
    data = lines.filter((F.col("value") != "") & ~F.substring("value", 1, 1).isin("@", "%"))
    options = {"nullValue": "?", "quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return nan_to_null(data.select(F.from_csv("value", schema, options).alias("r")).select("r.*"))


def write_attribute_relation(df: DataFrame, path: str, relation: str = "table") -> None:
    """Rows as text lines, preceded by the header in a first file of the same folder."""
    kinds = {"string": "string", "bigint": "integer", "int": "integer"}
    header = [f"@relation {relation}"] + [f"@attribute '{n}' {kinds.get(t, 'numeric')}" for n, t in df.dtypes] + ["@data"]
    spark = df.sparkSession
    spark.createDataFrame([(line,) for line in header], "value string").coalesce(1).write.mode("overwrite").text(path)
    quoted = {n for n, t in df.dtypes if t == "string"}
    cells = [
        F.when(F.col(f"`{n}`").isNull(), F.lit("?")).otherwise(
            F.concat(F.lit("'"), F.regexp_replace(F.col(f"`{n}`"), "(['\\\\])", "\\\\$1"), F.lit("'"))
            if n in quoted else F.col(f"`{n}`").cast("string")
        )
        for n in df.columns
    ]
    df.select(F.concat_ws(",", *cells).alias("value")).write.mode("append").text(path)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite", suffix: str = ""
) -> str:
    """Write predictions or leaderboards; returns the path with its configuration suffix."""
    target = path + suffix
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(target)
    return target


def scored_export(
    rows: DataFrame, price: DataFrame, predictions: DataFrame, row_id: str, truth: str,
    pred_name: str = "pred_rag_price", neighbor_price: str = "neighbour_price",
) -> DataFrame:
    """Key, split, neighbour price, truth, and the test prediction (NULL elsewhere)."""
    base = rows.select(row_id, "split", F.col(truth).alias(f"{truth}_true"))
    near = price.select(F.col("query_id").alias(row_id), neighbor_price)
    test = predictions.select(row_id, F.col("prediction").alias(f"{truth}_{pred_name}"))
    out = base.join(near, row_id, "left").join(test, row_id, "left")
    return out.select(row_id, "split", neighbor_price, f"{truth}_true", f"{truth}_{pred_name}")


def training_matrix(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Feature columns plus `target`."""
    return df.select(*[F.col(f"`{c}`") for c in features], F.col(label).alias("target"))
