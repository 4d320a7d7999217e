"""Exact top-k similarity join through a metric tree whose cells keep their size at any number of rows.

1. Every cell above `cell_rows` is divided among up to `fanout` pivots, which are rows of its own, level by level. Pivots
   and the distance shells of the cells are tables; the driver holds none of them.
2. Queries go down to their nearest leaves and search these; the k-th distance found is their reach.
3. Queries with a reach go down again, to all cells whose shell it touches. Only (query, cell, bound) is kept.
4. Best-first rounds: each query meets its next nearest open leaves, its reach shrinks, and leaves beyond it are closed.

Categories may stand beside the vector as codes: a mismatch adds 2 to the squared distance (1 if one side is unseen), as one-hot columns
would, at any number of categories. Wide vectors may be rotated first (`rotated`), so that a prefix of them bounds most distances.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre import kernels
from cadastre.functions.numeric import is_finite
from cadastre.operators import knn, vectors
from cadastre.operators.joins import lookup_join
from cadastre.session import materialize

ROUTED = "id bigint, cell bigint"


@dataclass(frozen=True)
class TreeLimits:
    cell_rows: int = 1024  # rows a leaf aims at
    fanout: int = 256  # most children of a cell
    first: int = 2  # leaves a query searches before it has a reach
    widen: int = 4  # open leaves of the first round; each round takes this many times more
    block_rows: int = 32768  # most rows of a cell in one block
    query_rows: int = 16384

    def blocks(self) -> knn.Limits:
        return knn.Limits(self.cell_rows, block_rows=self.block_rows, query_rows=self.query_rows)


@dataclass
class Report:
    """What a join did: levels of the tree, leaves, (query, leaf) rows routed beyond the first leaves, and rounds."""

    levels: int = 0
    leaves: int = 0
    routed: int = 0
    searched: int = 0
    rounds: int = 0


def _points(df: DataFrame, id_col: str, vec: Column, codes: str | None) -> DataFrame:
    usable = F.coalesce(F.forall(vec, is_finite), F.lit(False))
    extra = [F.col(codes).cast("array<double>").alias("codes")] if codes else []
    return df.filter(usable).select(F.col(id_col).cast("bigint").alias("id"), F.lit("").alias("stratum"), vec.alias("vec"), *extra)


def _met(rows: DataFrame, tables: DataFrame, kernel, schema: str, block_rows: int) -> DataFrame:
    """Rows with a `cell` against the rows of `tables` with that `parent`, at most `fanout` of them; crowded cells are salted."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("salts"))
    crowded = materialize(sizes.filter("salts > 1"), "crowded")
    salted = lookup_join(rows, crowded, "cell").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(11)), F.coalesce("salts", F.lit(1))).cast("int"))
    spread = lookup_join(tables.withColumnRenamed("parent", "cell"), crowded, "cell")
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = salted.drop("salts", "stratum").repartition(tasks, "cell", "salt").groupBy("cell", "salt")
    return left.cogroup(spread.drop("salts").repartition(tasks, "cell", "salt").groupBy("cell", "salt")).applyInArrow(kernel, schema)


def grow(points: DataFrame, limits: TreeLimits) -> tuple[DataFrame, list[DataFrame]]:
    """(points with their leaf `cell`, the tree's levels): nodes (parent, child, pivot, low, high, n) of non-empty cells."""
    placed, nodes = points.withColumn("cell", F.lit(0).cast("bigint")), []
    while True:
        sizes = materialize(placed.groupBy("cell").agg(F.count("*").alias("n")), "sizes")
        most = sizes.agg(F.max("n")).head()[0] or 0
        if most <= limits.cell_rows or (nodes and _stuck(nodes[-1], limits)):
            return placed, nodes
        wanted = lookup_join(placed.select("cell", "id", "vec"), sizes, "cell", "inner").withColumn("want", F.least(F.lit(limits.fanout), F.ceil(F.col("n") / limits.cell_rows)))
        order = Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(len(nodes))), "id")
        picked = wanted.withColumn("r", F.row_number().over(order)).filter(f"r <= {limits.fanout}").filter("r <= want")  # a bounded number leaves each task
        pivots = picked.select(F.col("cell").alias("parent"), (F.col("cell") * limits.fanout + F.col("r") - 1).alias("child"), F.col("vec").alias("pivot"))
        pivots = materialize(pivots, "pivots")
        homes = materialize(_met(placed.select("cell", "id", "vec"), pivots, kernels.nearest_children(1), f"{ROUTED}, gap double", limits.block_rows), "homes")
        shells = homes.groupBy(F.col("cell").alias("child")).agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count("*").alias("n"))
        nodes.append(materialize(pivots.join(shells, "child"), "nodes"))
        placed = materialize(placed.drop("cell").join(homes.select("id", "cell"), "id"), "placed")


def _stuck(nodes: DataFrame, limits: TreeLimits) -> bool:
    """Whether no crowded cell can be divided further: all its rows stand on one spot."""
    return nodes.filter((F.col("n") > limits.cell_rows) & (F.col("high") > 0)).isEmpty()


def rotated(queries: DataFrame, candidates: DataFrame, vec_col: str, share: float = 0.85) -> tuple[DataFrame, DataFrame, int]:
    """Both sides in the principal axes of the candidates, and how many axes hold `share` of their squared length. Distances stay as they are."""
    width = vectors.dimension(candidates, vec_col)
    product, _, _ = vectors.gram(candidates, vec_col, width)
    values, basis = np.linalg.eigh(product)
    held = np.cumsum(values[::-1]) / max(values.sum(), 1e-300)
    turn = vectors.Reduction(np.ascontiguousarray(basis[:, ::-1]), np.zeros(width), None)
    apply = lambda df: turn.apply(df.withColumnRenamed(vec_col, "__raw"), "__raw", "__turned").drop("__raw").withColumnRenamed("__turned", vec_col)
    return apply(queries), apply(candidates), min(width, int(np.searchsorted(held, share)) + 1)


def tree_join(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    id_col: str = "row_id",
    vec_col: str = "features",
    codes_col: str | None = None,
    metric: str = "euclidean",
    exclude_self: bool = True,
    decimals: int = 9,
    limits: TreeLimits = TreeLimits(),
    rotate: bool = False,
    report: Report | None = None,
) -> DataFrame:
    """Edges (query_id, rank, neighbor_id, distance) to the k nearest candidates by (rounded distance, id); ids are unique on each side.

    Rows whose vector is NULL or has a NULL, NaN or infinite component take no part. Copies of one point count as often as they occur, but no
    more than k + 1 of them are compared. An empty side gives no rows.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    if metric == "cosine" and codes_col:
        raise ValueError("categories have codes in Euclidean space only")
    if k <= 0:
        raise ValueError("k must be positive")
    asked, report = report is not None, report or Report()
    plain = F.col(vec_col).cast("array<double>")
    vec = {side: plain if metric == "euclidean" else knn.unit_vector(vec_col, side) for side in ("query", "candidate")}
    finite = lambda df: df.filter(F.coalesce(F.forall(plain, is_finite), F.lit(False)))
    q, c = _points(finite(queries), id_col, vec["query"], codes_col), _points(finite(candidates), id_col, vec["candidate"], codes_col)
    prefix = 0
    if rotate and not c.isEmpty():
        q, c, prefix = rotated(q, c, "vec")
    same = ["vec", *(["codes"] if codes_col else [])]
    copies = F.row_number().over(Window.partitionBy(*same).orderBy("id"))
    q, c = materialize(q, "queries"), materialize(c.withColumn("copy", copies).filter(F.col("copy") <= k + 1).drop("copy"), "candidates")
    points = knn.shared_queries(q)
    if points is not None:
        found = _climb(points, c, k + exclude_self, False, decimals, limits, prefix, report, asked)
        return knn._finish(knn.for_every_query(found, points, q, k, exclude_self), metric)
    return knn._finish(_climb(q, c, k, exclude_self, decimals, limits, prefix, report, asked), metric)


def _climb(
    q: DataFrame, c: DataFrame, k: int, exclude_self: bool, decimals: int, limits: TreeLimits, prefix: int, report: Report, asked: bool
) -> DataFrame:
    """Ranked edges of stored queries and candidates. Wide vectors (those with a `prefix`) close hardly any cell and meet block by block."""
    placed, levels = (c.withColumn("cell", F.lit(0).cast("bigint")), []) if prefix else grow(c, limits)
    report.levels = len(levels)
    blocks = limits.blocks()
    over = lambda df, most: {("", r["cell"]): r["n"] for r in df.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > most).collect()}  # noqa: E731  crowded cells only
    if not levels:
        zero = q.withColumn("cell", F.lit(0).cast("bigint"))
        return knn._ranked(knn._search(zero, placed, over(placed, limits.block_rows), {("", 0): q.count()}, k, exclude_self, decimals, blocks, prefix=prefix), k)
    cells = over(placed, limits.block_rows)
    report.leaves = levels[-1].count() if asked else 0

    def search(pairs: DataFrame, reach: bool) -> DataFrame:
        report.searched += pairs.count() if asked else 0
        return knn._search(pairs, placed, cells, over(pairs, limits.query_rows), k, exclude_self, decimals, blocks, reach, prefix)

    at = q.select("id", "vec", F.lit(0).cast("bigint").alias("cell"))
    for level, nodes in enumerate(levels):
        last = level == len(levels) - 1
        homes = _met(at, nodes.select("parent", "child", "pivot"), kernels.nearest_children(limits.first if last else 1), f"{ROUTED}, gap double", limits.block_rows)
        homes = materialize(homes.select("id", "cell"), "homes")
        at = q.select("id", "vec").join(homes, "id")
    best = materialize(knn._ranked(search(q.join(homes, "id"), False), k), "best")

    def reached(found: DataFrame) -> DataFrame:
        return found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("reach"))

    known = q.select("id", "vec").join(reached(best), "id", "left").na.fill(math.inf, ["reach"])
    known = materialize(known, "reach")
    routes = known.select("id", F.lit(0).cast("bigint").alias("cell"))
    for nodes in levels:
        rows = known.join(routes, "id").select("cell", "id", "vec", "reach")
        routes = materialize(_met(rows, nodes.select("parent", "child", "pivot", "low", "high"), kernels.open_children(), f"{ROUTED}, bound double", limits.block_rows), "routes")
    open_ = materialize(routes.join(homes, ["id", "cell"], "left_anti"), "open")
    report.routed = open_.count() if asked else 0
    take = limits.widen
    while not open_.isEmpty():
        report.rounds += 1
        ranked = open_.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("bound", "cell")))
        now = ranked.filter(F.col("r") <= take).select("id", "cell").join(reached(best), "id", "left").na.fill(math.inf, ["reach"])
        found = search(q.join(now, "id"), True)
        best = materialize(knn._ranked(best.unionByName(found), k), "best")
        left = ranked.filter(F.col("r") > take).drop("r").join(reached(best), "id", "left")
        open_ = materialize(left.filter(F.col("bound") <= F.coalesce("reach", F.lit(math.inf))).drop("reach"), "open")
        take *= limits.widen
    return best
