"""Sharding by sampled splitters: near equal bytes a shard, equal texts side by side.

Every row gets the sort key (hash of its text, hash of its id, number of the row as it is stored). A sample of keys, drawn with a
probability in proportion to the row's size, gives the quantile boundaries of many small ranges;
ranges that turn out overfull are subdivided by a denser sample of their own rows. Exact byte
totals of the ranges (a bounded list) then cut the line of ranges into shards. A group of equal
texts is one run of keys: it stays together, unless it is larger than a range; then it is
subdivided by the id's hash and, where rows repeat as a whole, by their numbers, so one group may hold any share of the rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastre.llm.text import table
from cadastre.session import materialize, small_table

LAST = "g"  # sorts after every hexadecimal key


def _draw(rows: DataFrame, rate: Column) -> list[tuple[str, float]]:
    """(key, weight) of rows kept with probability min(1, size * rate); the draw is a hash, so a rerun repeats it."""
    p = F.least(F.lit(1.0), F.col("size") * rate)
    uniform = F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    kept = rows.withColumn("p", p).filter(uniform < F.col("p"))
    return sorted((r["key"], r["size"] / r["p"]) for r in kept.select("key", "size", "p").collect())


def _quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    """Keys that cut the weighted sample into `parts` parts of about equal weight."""
    step, run, cuts = sum(w for _, w in sample) / parts, 0.0, []
    for key, weight in sample:
        if run >= step * (len(cuts) + 1) and len(cuts) < parts - 1 and (not cuts or key > cuts[-1]):
            cuts.append(key)
        run += weight
    return cuts


def _range_of(splitters: list[str]) -> Column:
    """Number of splitters up to the key, by binary search over a literal array."""
    if not splitters:
        return F.lit(0)
    bits = len(splitters).bit_length()
    padded = F.lit(splitters + [LAST] * ((1 << bits) - len(splitters)))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(padded, at + step - 1) <= F.col("key"), at + step).otherwise(at))


def shard_by_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, ranges_per_shard: int = 64, samples_per_range: int = 16, rounds: int = 4
) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    size: UTF-8 bytes plus 1; a NULL text counts as an empty one (size 1, crc32 0). Slots run from 0
    without gaps in each shard, ordered by the sort key. Repeated rows each get a slot of their own; NULL ids are
    placed like any other; an empty table gives no rows. Other columns of `docs` are not read.
    Driver memory: about shards * ranges_per_shard * samples_per_range sampled keys, at any input size.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.col(id_col), F.lit("tie")), F.monotonically_increasing_id())]).alias("key"),
    )
    rows = materialize(rows, "shard-keys")
    total = rows.agg(F.sum("size")).head()[0] or 0
    parts = shards * ranges_per_shard
    target = max(1.0, total / parts)

    splitters = _quantiles(_draw(rows, F.lit(samples_per_range / target)), parts)
    bounds: dict[int, tuple[int, int]] = {}
    for turn in range(rounds + 1):
        ranged = rows.withColumn("range", _range_of(splitters))
        bounds = {r["range"]: (r["n"], r["bytes"]) for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
        overfull = [k for k, (n, size) in bounds.items() if size > 2 * target and n > 1]
        if turn == rounds or not overfull:
            break
        inside = ranged.join(F.broadcast(small_table(spark, [(k,) for k in overfull], "range int")), "range")  # at most `parts` ranges
        extra = _draw(inside, F.lit(samples_per_range * 2.0 ** (turn + 1) / target))
        of: dict[int, list] = {}
        for key, weight in extra:
            of.setdefault(bisect_right(splitters, key), []).append((key, weight))
        cuts = {c for k, sample in of.items() for c in _quantiles(sample, math.ceil(bounds[k][1] / target))}
        splitters = sorted({*splitters, *cuts})

    places, before, slots = [], 0, [0] * shards
    for k in sorted(bounds):
        n, size = bounds[k]
        at = min(shards - 1, int((before + size / 2) * shards / max(1, total)))
        places.append((k, at, slots[at]))
        slots[at] += n
        before += size
    where = F.broadcast(small_table(spark, places, "range int, shard int, base bigint"))  # one row per range
    in_range = F.row_number().over(Window.partitionBy("range").orderBy("key", "id"))
    return (
        rows.withColumn("range", _range_of(splitters))
        .join(where, "range")
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + in_range - 1).alias("slot"))
    )


def op10_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
