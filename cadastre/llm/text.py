"""Column helpers for words, shared by the corpus operators that stay inside the JVM."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def indexes(count: Column) -> Column:
    """0 .. count-1, empty where count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def each_value(values: pa.Array, at_once: int = 200) -> Iterator:
    """Values of an Arrow array as Python objects, of which only a few are held at a time."""
    for at in range(0, len(values), at_once):
        yield from values.slice(at, at_once).to_pylist()
