"""Exact quantiles of many columns in many groups by radix selection.

Doubles have an order as 64-bit numbers. Four passes count the values of each group by 16 of these bits, from the highest on,
and each wanted rank keeps the digit it falls into. All groups, columns and ranks share the four passes; what is held
per group is one row a rank, and no value is fetched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastre.operators.joins import fits_broadcast
from cadastre.session import materialize

DIGIT = 16
SIGN = np.int64(-(1 << 63))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column `v` as numbers whose unsigned order is that of the doubles."""
    for batch in batches:
        b = (batch.column("v").to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
        at = batch.schema.get_field_index("v")
        yield batch.set_column(at, "v", pa.array(np.where(b < 0, ~b, b ^ -(1 << 63)), pa.int64()))


def _doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b = batch.column("v").to_numpy(zero_copy_only=False)
        at = batch.schema.get_field_index("v")
        yield batch.set_column(at, "v", pa.array(np.where(b < 0, b ^ -(1 << 63), ~b).view(np.float64)))


def _typed(df: DataFrame, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f.name, kind if f.name == "v" else f.dataType) for f in df.schema])


def grouped_quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], points: Sequence[float]) -> DataFrame:
    """(by.., column, point, value): quantiles with linear interpolation of the values that are numbers; groups without any have no row.

    A NULL group is a group. `by` may be empty: then the whole table is one group.
    """
    group = F.struct(*[F.col(f"`{c}`") for c in by], F.lit(0).alias("__all"))
    values = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    long = df.select(group.alias("g"), F.explode(values).alias("x")).select("g", "x.c", "x.v").filter("v IS NOT NULL AND NOT isnan(v)")
    keyed = materialize(long.mapInArrow(_bits, _typed(long, T.LongType())), "bits")
    wanted = keyed.groupBy("g", "c").agg(F.count("*").alias("n")).withColumn("point", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    place = F.col("point") * (F.col("n") - 1)
    sides = F.array(F.floor(place), F.least(F.floor(place) + 1, F.col("n") - 1))
    wanted = wanted.withColumn("part", place - F.floor(place)).select("g", "c", "point", "part", F.posexplode(sides).alias("side", "rank"), F.lit(0).cast("bigint").alias("head"))
    wanted = materialize(wanted, "ranks")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        head = F.shiftrightunsigned("v", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("bigint")
        digit = F.shiftrightunsigned("v", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        heads = wanted.select("g", "c", "head").distinct()
        heads = F.broadcast(heads) if fits_broadcast(wanted.select("g", "c", "head"), 128) else heads
        counted = keyed.select("g", "c", head.alias("head"), digit.alias("digit")).join(heads, ["g", "c", "head"]).groupBy("g", "c", "head", "digit").agg(F.count("*").alias("m"))
        before = F.coalesce(F.sum("m").over(Window.partitionBy("g", "c", "head").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 65,536 digits at most
        running = counted.withColumn("before", before)
        met = wanted.join(running, ["g", "c", "head"]).filter("rank >= before AND rank < before + m")
        wanted = materialize(met.select("g", "c", "point", "part", "side", (F.col("rank") - F.col("before")).alias("rank"), F.shiftleft("head", DIGIT).bitwiseOR(F.col("digit")).alias("head")), "ranks")
    found = wanted.select("g", "c", "point", "part", "side", F.col("head").alias("v"))
    found = found.mapInArrow(_doubles, _typed(found, T.DoubleType()))
    low, high = (F.max(F.when(F.col("side") == k, F.col("v"))) for k in (0, 1))
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    rows = found.groupBy("g", "c", "point", "part").agg(low.alias("low"), high.alias("high"))
    return rows.select(*[F.col("g").getField(c).alias(c) for c in by], F.col("c").alias("column"), "point", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(value).alias("value"))
