"""Key lookups that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
HOT_ROWS = 1_000_000


def fits_broadcast(table: DataFrame, row_bytes: int = 64) -> bool:
    """Whether the table's rows, at `row_bytes` each besides their texts, and its texts as they are, stay below the limit.

    Reading stops at the number of rows that would exceed the limit by themselves.
    """
    limit = BROADCAST_BYTES // row_bytes
    texts = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, kind in table.dtypes if kind in ("string", "binary")]
    width = sum(texts, F.lit(row_bytes).cast("bigint"))
    rows, size = table.select(width.alias("bytes")).limit(limit + 1).agg(F.count("*"), F.sum("bytes")).head()
    return rows <= limit and (size or 0) <= BROADCAST_BYTES


def lookup_join(
    rows: DataFrame, table: DataFrame, key: str, how: str = "left", row_bytes: int = 64, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """`rows` with the columns of `table` (unique on `key`).

    A table of checked size is broadcast. Otherwise keys that more than `hot_rows` rows share are
    joined apart: there are few of them by construction, so their side of the table is small and
    is broadcast when the same check passes; everything else shuffles without a hot key.
    """
    if how not in ("left", "inner"):
        raise ValueError("a lookup is a left or an inner join")
    if fits_broadcast(table, row_bytes):
        return rows.join(F.broadcast(table), key, how)
    counted = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    hot = [r[0] for r in counted.filter(F.col("n") > hot_rows).select(key).limit(BROADCAST_BYTES // row_bytes).collect()]
    if not hot:
        return rows.join(table, key, how)
    keys = rows.sparkSession.createDataFrame([(h,) for h in hot], rows.select(key).schema)
    crowded = rows.join(F.broadcast(keys), key, "left_semi")
    others = rows.join(F.broadcast(keys), key, "left_anti")
    hot_table = table.join(F.broadcast(keys), key, "left_semi")
    hot_table = F.broadcast(hot_table) if fits_broadcast(hot_table, row_bytes) else hot_table
    return crowded.join(hot_table, key, how).unionByName(others.join(table, key, how))
