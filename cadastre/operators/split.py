"""Seeded splits and samples that depend on row keys only, never on partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.functions.numeric import col

PREFIX = 4  # hex digits per refinement step: 65,536 buckets
SMALL = 20_000


def seeded_hash(key: str | Column, seed: int | Column = 42) -> Column:
    """md5 of "seed:key" as 32 hex digits."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed.cast("string"), col(key).cast("string")))


def hash_unit(key: str | Column, seed: int | Column = 42) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the seeded hash."""
    return F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def split_label(
    key: str | Column, seed: int | Column = 42, train: float = 0.7, val: float = 0.1
) -> Column:
    """train / val / test by thresholds of `hash_unit`; map-only. Hex digits have the order of their number, so nothing is converted."""
    h = seeded_hash(key, seed)

    def below(share: float) -> Column:
        limit = math.ceil(share * 2**32)
        return F.lit(limit > 0) if not 0 < limit < 2**32 else h < F.lit(f"{limit:08x}")

    return F.when(below(train), "train").when(below(train + val), "val").otherwise("test")


def hash_split(df: DataFrame, key: str, seed: int = 42, train: float = 0.7, val: float = 0.1) -> DataFrame:
    return df.withColumn("split", split_label(key, seed, train, val))


def over_seeds(df: DataFrame, key: str, seeds: Sequence[int], train: float = 0.7, val: float = 0.1) -> DataFrame:
    """One copy of every row per seed with its own split; `seed` is then a grouping key."""
    repeated = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    return repeated.withColumn("split", split_label(key, F.col("seed"), train, val))


def _rank_cut(hashed: DataFrame, rank: int) -> str:
    """Hash value at 1-based `rank`, by refining prefixes; brings back bucket counts only."""
    prefix, left = "", rank
    while True:
        rows = hashed if not prefix else hashed.filter(F.col("h").startswith(prefix))
        width = len(prefix) + PREFIX
        counts = sorted(
            (r["p"], r["n"]) for r in rows.groupBy(F.substring("h", 1, width).alias("p")).agg(F.count("*").alias("n")).collect()
        )
        for bucket, n in counts:
            if left <= n:
                break
            left -= n
        prefix = bucket
        if n <= SMALL or width >= 32:
            inside = hashed.filter(F.col("h").startswith(prefix)).groupBy("h").agg(F.count("*").alias("n"))
            for h, n in sorted((r["h"], r["n"]) for r in inside.collect()):
                if left <= n:
                    return h
                left -= n


def exact_sample(
    df: DataFrame, key: str, ratio: float | None = None, size: int | None = None, seed: int = 42
) -> DataFrame:
    """Exactly `size` (or int(n * ratio)) rows without replacement; `key` must be unique.

    The rows with the smallest hashes are kept through one threshold, so no global sort and
    no single-task top-n is needed whatever the size.
    """
    if (ratio is None) == (size is None):
        raise ValueError("give either ratio or size")
    if ratio is not None and not 0 < ratio <= 1:
        raise ValueError("ratio must be in (0, 1]")
    total = df.count()
    size = int(total * ratio) if size is None else size
    if size >= total:
        return df
    h = seeded_hash(key, seed)
    if size <= 0:
        return df.filter(F.lit(False))
    cut = _rank_cut(df.select(h.alias("h")), size)
    return df.filter(h <= cut)


def exact_split(df: DataFrame, key: str, seed: int = 42, held_out: float = 0.3, test_share: float = 2 / 3) -> DataFrame:
    """Split with exact sizes: held out = ceil(.3 n), test = ceil(2/3 of it), val the rest of it."""
    total = df.count()
    held = math.ceil(held_out * total)
    test = math.ceil(test_share * held)
    h = seeded_hash(key, seed)
    hashed = df.select(h.alias("h"))
    if total == held or test == 0:
        raise ValueError("too few rows to split")
    cut_train = _rank_cut(hashed, total - held)
    if held == test:
        return df.withColumn("split", F.when(h <= cut_train, "train").otherwise("test"))
    cut_val = _rank_cut(hashed, total - test)
    return df.withColumn("split", F.when(h <= cut_train, "train").when(h <= cut_val, "val").otherwise("test"))


def parameter_grid(spark, **axes: Sequence) -> DataFrame:
    """Product of the axes as a frame, first axis varying slowest."""
    df = spark.range(1).select(*[F.array(*[F.lit(v) for v in values]).alias(name) for name, values in axes.items()])
    for name in axes:
        df = df.withColumn(name, F.explode(name))
    return df.select(*axes)
