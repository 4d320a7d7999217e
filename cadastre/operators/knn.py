"""Exact top-k similarity join.

Every row of `queries` meets its k nearest rows of `candidates`, ranked by (distance rounded to
nine decimals, id). The plan is a sequence of equi-joins between bounded blocks:

1. Copies of one vector keep their k+1 smallest ids, all a rank can ever need, so a vector that
   fills a third of the table costs no more than any other. Queries that share a vector are
   searched once, for k+1 neighbours, and each takes from these the first k that are not itself.
2. Candidates go to cells made by halving cuts (fitted on a bounded hash sample). Cells above
   `block_rows` are cut into sub-blocks, and crowded query sides are salted, so no group that
   reaches Python outgrows a fixed number of rows.
3. Queries search their home cell first; the k-th distance found there closes all cells whose
   box lies past it, and only the open ones are searched. Vectors of more than `widest` places
   close hardly any box: they meet all candidates, block by block.

Nothing is sampled away or capped: the bounds are exact, and a query that cannot close any cell
visits all of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre import kernels
from cadastre.functions.numeric import is_finite
from cadastre.operators.joins import lookup_join
from cadastre.session import materialize, small_table

EDGES = "query_id bigint, neighbor_id bigint, distance double, rank int"


@dataclass(frozen=True)
class Limits:
    cell_rows: int = 1024  # candidates a cell aims at: decides the number of cells
    max_pivots: int = 65536  # most cells
    pivot_from: int = 32  # cells from which on they are worth it
    widest: int = 32  # places from which on cells are not worth it
    sample: int = 16  # sampled candidates a cell is cut by
    block_rows: int = 32768  # most candidates in one block; fuller cells are cut
    query_rows: int = 16384  # most queries in one block


def unit_vector(vec: str | Column, side: str) -> Column:
    """Unit vector plus two marker coordinates.

    Squared Euclidean distance between two of them is twice the cosine distance; the markers
    put a zero vector at cosine distance 1 from everything, other zero vectors included.
    """
    v = (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))

    def unit(s: Column) -> Column:
        zero = F.when(s["norm"] == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        scaled = F.transform(s["v"], lambda x: F.when(s["norm"] == 0, F.lit(0.0)).otherwise(x / s["norm"]))
        return F.concat(scaled, F.array(zero, F.lit(0.0)) if side == "candidate" else F.array(F.lit(0.0), zero))

    # the norm is bound to a variable, or it would be summed again for every place
    return F.when(v.isNotNull(), F.transform(F.array(F.struct(v.alias("v"), norm.alias("norm"))), unit)[0])


def _prepare(df: DataFrame, id_col: str, vec_col: str, codes_col: str | None, by: str | None, metric: str, side: str) -> DataFrame:
    vec = F.col(vec_col).cast("array<double>") if metric == "euclidean" else unit_vector(vec_col, side)
    stratum = F.coalesce(F.col(by).cast("string"), F.lit("None")) if by else F.lit("")
    usable = F.forall(F.col(vec_col).cast("array<double>"), is_finite)
    codes = [F.col(codes_col).cast("array<double>").alias("codes")] if codes_col else []
    return df.filter(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("id"), stratum.alias("stratum"), vec.alias("vec"), *codes
    )


def _spot(df: DataFrame) -> list[str]:
    """The columns in which copies of a point agree."""
    return ["stratum", "vec", *(["codes"] if "codes" in df.columns else [])]


def shared_queries(queries: DataFrame) -> DataFrame | None:
    """One query per point under the least of their ids, where that leaves at most half of them."""
    points = materialize(queries.groupBy(*_spot(queries)).agg(F.min("id").alias("id"), F.count("*").alias("n")), "points")
    rows, spots = points.agg(F.sum("n"), F.count("*")).head()
    return points.drop("n") if rows and 2 * spots <= rows else None


def for_every_query(edges: DataFrame, points: DataFrame, queries: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Edges of all queries from those of their points, which have a neighbour to spare."""
    near = edges.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "distance"))).alias("near"))
    spot = F.struct(*_spot(queries)).alias("spot")
    found = materialize(points.join(near, F.col("id") == F.col("query_id")).select(spot, "near"), "near")
    width = queries.select(sum([F.size(c) for c in ("vec", "codes") if c in queries.columns], F.lit(0))).head()
    # the points are looked up: there are at most half as many as queries, which stay where they are where the points fit into memory
    rows = lookup_join(queries.select("id", spot), found, "spot", "inner", 64 + 32 * (k + 1) + 8 * (width[0] if width else 0))
    others = F.filter("near", lambda e: e["neighbor_id"] != F.col("id")) if exclude_self else F.col("near")
    rows = rows.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "e"))
    return rows.select("query_id", "e.neighbor_id", "e.distance", (F.col("at") + 1).alias("rank"))


def _first_copies(candidates: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy(*_spot(candidates)).orderBy("id")
    return candidates.withColumn("copy", F.row_number().over(order)).filter(F.col("copy") <= keep).drop("copy")


def _boxes(candidates: DataFrame, large: dict[str, int], limits: Limits) -> dict[str, kernels.Boxes]:
    """Cells of the large strata, cut by a bounded hash sample of their candidates."""
    wanted = {s: n for s, n in large.items() if n > limits.pivot_from * limits.cell_rows}
    if not wanted:
        return {}
    total = sum(wanted.values())
    cells = min(limits.max_pivots, max(1, total // limits.cell_rows))
    rate = min(1.0, limits.sample * cells / total)
    resolution = 1 << 40
    codes = ["codes"] if "codes" in candidates.columns else []
    rows = (
        candidates.filter(F.col("stratum").isin(*wanted))
        .filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(resolution)) < F.lit(int(rate * resolution)))
        .select("stratum", "id", "vec", *codes)
        .toArrow()
        .sort_by([("stratum", "ascending"), ("id", "ascending")])
    )
    out = {}
    for s in wanted:
        picked = rows.filter(pc.equal(rows["stratum"], s))
        if picked.num_rows:
            x = kernels.matrix(picked["vec"])
            plain = x.shape[1]
            x = np.concatenate([x, kernels.matrix(picked["codes"])], axis=1) if codes else x
            grown = kernels.Boxes(x, max(1, math.ceil(rate * total / cells)), plain)
            if len(grown.dim) > 1:
                out[s] = grown
    return out


def _search(
    queries: DataFrame, candidates: DataFrame, cells: dict[tuple[str, int], int], crowd: dict[tuple[str, int], int],
    k: int, exclude_self: bool, decimals: int, limits: Limits, reach: bool = False, prefix: int = 0,
) -> DataFrame:
    """Blocks of queries against blocks of candidates with the same (stratum, cell).

    `cells` and `crowd` give the candidate and query counts of the cells that need cutting.
    """
    spark = queries.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts_of = {key: math.ceil(cells.get(key, 1) / limits.block_rows) for key in set(cells) | set(crowd)}
    # small inputs still use every core: several blocks per task, none below 256 queries
    rows = max(256, min(limits.query_rows, sum(n * parts_of[key] for key, n in crowd.items()) // (3 * tasks) + 1))
    shape = []
    for key, parts in parts_of.items():
        salts = math.ceil(crowd.get(key, 1) / rows)
        if parts > 1 or salts > 1:
            shape.append((*key, parts, salts))
    keys = ["stratum", "cell", "part", "salt"]
    if shape:
        table = F.broadcast(small_table(spark, shape, "stratum string, cell bigint, parts int, salts int"))
        spread = lambda df: df.join(table, ["stratum", "cell"], "left").fillna(1, ["parts", "salts"])
        queries = (
            spread(queries)
            .withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.col("salts")).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        )
        candidates = (
            spread(candidates)
            .withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        )
    else:
        queries = queries.withColumn("part", F.lit(0)).withColumn("salt", F.lit(0))
        candidates = candidates.withColumn("part", F.lit(0)).withColumn("salt", F.lit(0))
    # an explicit count: blocks are small in bytes but heavy in work, so they must not be coalesced
    codes = ["codes"] if "codes" in queries.columns else []
    left = queries.select(*keys, "id", "vec", *codes, *(["reach"] if reach else [])).repartition(tasks, *keys)
    right = candidates.select(*keys, "id", "vec", *codes).repartition(tasks, *keys)
    return (
        left.groupBy(*keys).cogroup(right.groupBy(*keys))
        .applyInArrow(kernels.block_search(k, exclude_self, decimals, prefix), EDGES)
    )


def _ranked(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _counts(df: DataFrame, names, *extra) -> list:
    return df.filter(F.col("stratum").isin(*names)).groupBy("stratum", "cell").agg(F.count("*").alias("n"), *extra).collect()


def _crowded(queries: DataFrame, limits: Limits) -> dict[tuple[str, int], int]:
    """Query counts of the cells that hold more than one block of them, whatever the size of their stratum."""
    counted = queries.groupBy("stratum", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > limits.query_rows)
    return {(r["stratum"], r["cell"]): r["n"] for r in counted.collect()}


def knn_join(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    id_col: str = "row_id",
    vec_col: str = "features",
    metric: str = "euclidean",
    by: str | None = None,
    exclude_self: bool = True,
    decimals: int = 9,
    limits: Limits = Limits(),
    codes_col: str | None = None,
) -> DataFrame:
    """Edges (query_id, rank, neighbor_id, distance); `by` restricts candidates to the same stratum.

    `codes_col` may hold category codes that count as one-hot columns would: a mismatch adds 2 to the squared distance, 1 if one
    side is unseen (below 0).

    `k` is capped by what exists: a query with fewer candidates gets fewer rows. Rows whose vector is NULL or has a
    NULL, NaN or infinite component have no distance to anything: they are neither queries nor candidates.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    if k <= 0:
        raise ValueError("k must be positive")
    if metric == "cosine" and codes_col:
        raise ValueError("categories have codes in Euclidean space only")
    q = _prepare(queries, id_col, vec_col, codes_col, by, metric, "query")
    c = _prepare(candidates, id_col, vec_col, codes_col, by, metric, "candidate")
    total = c.count()
    roof = limits.block_rows
    if by:
        sizes = c.groupBy("stratum").agg(F.count("*").alias("n"))
        large = {r["stratum"]: r["n"] for r in sizes.filter(F.col("n") > roof).collect()}
    else:
        large = {"": total} if total > roof else {}

    if not large:
        crowd = {}
        if not by:
            crowd = {("", 0): q.count()}
        else:
            busy = q.groupBy("stratum").agg(F.count("*").alias("n")).filter(F.col("n") > limits.query_rows)
            crowd = {(r["stratum"], 0): r["n"] for r in busy.collect()}
        zero = F.lit(0)
        edges = _search(q.withColumn("cell", zero), c.withColumn("cell", zero), {}, crowd, k, exclude_self, decimals, limits)
        return _finish(edges, metric)

    c = materialize(_first_copies(c, k + 1), "candidates")
    q = materialize(q, "queries")
    points = shared_queries(q)
    if points is not None:
        found = _search_cells(points, c, large, k + exclude_self, False, decimals, limits)
        return _finish(for_every_query(found, points, q, k, exclude_self), metric)
    return _finish(_search_cells(q, c, large, k, exclude_self, decimals, limits), metric)


def _search_cells(
    q: DataFrame, c: DataFrame, large: dict[str, int], k: int, exclude_self: bool, decimals: int, limits: Limits
) -> DataFrame:
    """Ranked edges of stored queries and candidates, the strata of `large` through cells."""
    large = {r["stratum"]: r["n"] for r in c.filter(F.col("stratum").isin(*large)).groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    codes = ["codes"] if "codes" in c.columns else []
    widths = c.select(F.size("vec"), *[F.size(x) for x in codes]).head() or [0]
    boxes = _boxes(c, large, limits) if sum(widths) <= limits.widest else {}
    if boxes:
        point = f"stratum string, id bigint, vec array<double>, {'codes array<double>, ' if codes else ''}"
        assign = kernels.assign_cells(boxes)
        c = materialize(c.select("stratum", "id", "vec", *codes).mapInArrow(assign, point + "cell bigint"), "cells")
        q = materialize(q.select("stratum", "id", "vec", *codes).mapInArrow(assign, point + "cell bigint"), "homes")
    else:
        c, q = c.withColumn("cell", F.lit(0)), q.withColumn("cell", F.lit(0))
    places = [F.col(x)[i] for x, n in zip(["vec", *codes], widths) for i in range(n)] if boxes else []
    stats = _counts(c, large, *[f(x).alias(f"{name}{i}") for i, x in enumerate(places) for name, f in (("low", F.min), ("high", F.max))])
    cells = {(r["stratum"], r["cell"]): r["n"] for r in stats}
    crowd = _crowded(q, limits) | {(r["stratum"], r["cell"]): r["n"] for r in _counts(q, large)}
    home = _search(q, c, cells, crowd, k, exclude_self, decimals, limits)
    if not boxes:
        return _ranked(home, k)

    home = materialize(home, "home-edges")
    for name, tree in boxes.items():
        own = [r for r in stats if r["stratum"] == name]
        low, high = (np.array([[r[f"{side}{i}"] for i in range(len(places))] for r in own]) for side in ("low", "high"))
        tree.fit([r["cell"] for r in own], low, high)
    # the k-th distance of any one block bounds the k-th distance
    reach = home.filter(F.col("rank") == k).groupBy(F.col("query_id").alias("id")).agg(F.min("distance").alias("reach"))
    open_queries = (
        q.filter(F.col("stratum").isin(*boxes)).join(reach, "id", "left")
        .select("stratum", "id", "vec", *codes, F.coalesce("reach", F.lit(math.inf)).alias("reach"), "cell")
    )
    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = materialize(open_queries.repartition(tasks).mapInArrow(kernels.route_queries(boxes), point + "reach double, cell bigint"), "routed")
    crowd = {(r["stratum"], r["cell"]): r["n"] for r in _counts(routed, boxes)}  # routed queries are of these strata only
    away = _search(routed, c, cells, crowd, k, exclude_self, decimals, limits, reach=True)
    return materialize(_ranked(home.unionByName(away), k), "edges")


def _finish(edges: DataFrame, metric: str) -> DataFrame:
    distance = F.col("distance")
    if metric == "cosine":
        distance = distance * distance / F.lit(2.0)
    return edges.select("query_id", "rank", "neighbor_id", distance.alias("distance"))
