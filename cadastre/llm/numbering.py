"""Consecutive numbers for the rows of a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.session import materialize, small_table


def numbered(rows: DataFrame, order: list[Column | str], out: str, label: str) -> tuple[DataFrame, int]:
    """`rows` with `out` = 0, 1, .. in the given order, and their number: ranges sorted apart, shifted by the totals before them."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialize(sorted_.withColumn("__at", F.monotonically_increasing_id()), label)
    part = F.shiftright("__at", 33)
    totals = sorted((r["part"], r["n"]) for r in written.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    shifts, total = [], 0
    for k, n in totals:
        shifts.append((k, total - (k << 33)))
        total += n
    shift = F.broadcast(small_table(rows.sparkSession, shifts, "part bigint, shift bigint"))
    return written.withColumn("part", part).join(shift, "part").withColumn(out, F.col("__at") + F.col("shift")).drop("part", "shift", "__at"), total
