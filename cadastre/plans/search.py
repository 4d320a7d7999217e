"""Queries: similarity joins, neighbour features and what is built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.operators import encode, metrics, neighbors, rows
from cadastre.operators.knn import Limits, knn_join
from cadastre.operators.neighbors import SearchSpace
from cadastre.operators.tree_join import TreeLimits, tree_join
from cadastre.plans.registry import query, r6, rounded, s6
from cadastre.plans.views import LISTING, PARTS, listing, medians_sql, parts, stored
from cadastre.session import materialize
from cadastre.sources import tabular

K = 8
SPACE = SearchSpace(numeric=["size", "retail"])
HYBRID = SearchSpace(numeric=["size", "retail"], text=["brand", "kind"])
STRATA = SearchSpace(numeric=["size", "retail"], stratify=["kind", "brand"])
LISTING_SPACE = SearchSpace(numeric=["n_lines", "sum_qty", "gross", "acctbal"])

# Named search modes of the probe table.
SEARCH_MODES = {
    "hybrid": HYBRID,
    "numbers": SPACE,
    "labels": SearchSpace(text=["brand", "kind"]),
    "stratified": STRATA,
}


def standard_sql(columns: list[str], table: str, name: str = "pts", extra: str = "") -> str:
    """CTE with standardised columns x1.. over the training rows of `table`."""
    fit = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(columns))
    out = ", ".join(f"({c} - m{i}) / coalesce(nullif(s{i}, 0), 1) AS x{i}" for i, c in enumerate(columns))
    return (f"{name}_fit AS (SELECT {fit} FROM {table} WHERE split = 'train'), "
            f"{name} AS (SELECT row_id, split, {out}{extra} FROM {table}, {name}_fit)")


def distance_sql(dims: int) -> str:
    return "round(sqrt(" + " + ".join(f"(q.x{i} - c.x{i}) * (q.x{i} - c.x{i})" for i in range(dims)) + "), 9)"


def edges_sql(dims: int, k: int = K, pts: str = "pts", name: str = "edges", where: str = "") -> str:
    """CTE with the k nearest training rows of every row, by (distance, id)."""
    return f"""{name}_top AS (SELECT q.row_id AS query_id, min(struct_pack(d := {distance_sql(dims)}, i := c.row_id), {k}) AS near
FROM {pts} q, {pts} c WHERE c.split = 'train' AND q.row_id <> c.row_id {where} GROUP BY q.row_id),
{name} AS (SELECT query_id, unnest(range(1, len(near) + 1)) AS rank, unnest(near).i AS neighbor_id, unnest(near).d AS distance FROM {name}_top)"""


EDGE_COLUMNS = f"query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, {s6('distance', 'distance')}"
PART_PTS = f"{PARTS}, {standard_sql(['size', 'retail'], 'parts')}"


def _edges(df, space=SPACE, k=K, **options):
    return neighbors.neighbor_edges(df, k, space, **options)


@query("knn_euclid", f"WITH {PART_PTS}, {edges_sql(2)} SELECT {EDGE_COLUMNS} FROM edges")
def knn_euclid(spark, sf):
    return rounded(_edges(parts(spark, sf)), "distance")


@query("knn_euclid_cells", f"WITH {PART_PTS}, {edges_sql(2)} SELECT {EDGE_COLUMNS} FROM edges")
def knn_euclid_cells(spark, sf):
    """The same search through pivot cells, as larger tables run it."""
    limits = Limits(cell_rows=128, block_rows=100, query_rows=512, pivot_from=2)
    return rounded(_edges(parts(spark, sf), limits=limits), "distance")


COSINE_SQL = f"""WITH v AS (SELECT vec_id AS row_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, {{split}} AS split FROM embeddings),
top AS (SELECT q.row_id AS query_id, min(struct_pack(d := round(sqrt(greatest(0, 2 * (1 - list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e)))))), 9), i := c.row_id), {K}) AS near
FROM v q, v c WHERE c.split = 'train' AND q.row_id <> c.row_id GROUP BY q.row_id),
edges AS (SELECT query_id, unnest(range(1, len(near) + 1)) AS rank, unnest(near).i AS neighbor_id, pow(unnest(near).d, 2) / 2 AS distance FROM top)
SELECT {EDGE_COLUMNS} FROM edges"""


def _cosine_sql() -> str:
    from cadastre.plans.views import split_sql

    return COSINE_SQL.format(split=split_sql("vec_id"))


@query("knn_cosine", _cosine_sql())
def knn_cosine(spark, sf):
    from cadastre.operators.split import hash_split

    v = hash_split(tabular.read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding"), "row_id")
    edges = knn_join(v, v.filter("split = 'train'"), K, vec_col="embedding", metric="cosine")
    return rounded(edges, "distance")


@query("knn_hybrid", f"""WITH {PARTS}, b AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS bc FROM (SELECT DISTINCT brand FROM parts WHERE split = 'train')),
t AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS tc FROM (SELECT DISTINCT kind FROM parts WHERE split = 'train')),
coded AS (SELECT p.*, coalesce(bc, 0) AS bc, coalesce(tc, 0) AS tc FROM parts p LEFT JOIN b USING (brand) LEFT JOIN t USING (kind)),
{standard_sql(['size', 'retail', 'bc', 'tc'], 'coded')}, {edges_sql(4)} SELECT {EDGE_COLUMNS} FROM edges""")
def knn_hybrid(spark, sf):
    return rounded(_edges(parts(spark, sf), SEARCH_MODES["hybrid"]), "distance")


@query("knn_onehot", f"""WITH {PART_PTS.replace('AS x1 FROM', 'AS x1, kind FROM')},
edges_top AS (SELECT q.row_id AS query_id, min(struct_pack(d := round(sqrt((q.x0 - c.x0) * (q.x0 - c.x0) + (q.x1 - c.x1) * (q.x1 - c.x1) + CASE WHEN q.kind <> c.kind THEN 2 ELSE 0 END), 9), i := c.row_id), {K}) AS near
FROM pts q, pts c WHERE c.split = 'train' AND q.row_id <> c.row_id GROUP BY q.row_id),
edges AS (SELECT query_id, unnest(range(1, len(near) + 1)) AS rank, unnest(near).i AS neighbor_id, unnest(near).d AS distance FROM edges_top)
SELECT {EDGE_COLUMNS} FROM edges""")
def knn_onehot(spark, sf):
    return rounded(_edges(parts(spark, sf), SearchSpace(["size", "retail"], ["kind"], category="onehot")), "distance")


STRATIFIED_SQL = f"""{PART_PTS}, {edges_sql(2, name='everywhere')},
sizes AS (SELECT kind, brand, count(*) AS n, avg(size) AS m0, stddev_pop(size) AS s0, avg(retail) AS m1, stddev_pop(retail) AS s1
FROM parts WHERE split = 'train' GROUP BY kind, brand),
own AS (SELECT row_id, split, p.kind || p.brand AS stratum, (size - m0) / coalesce(nullif(s0, 0), 1) AS x0, (retail - m1) / coalesce(nullif(s1, 0), 1) AS x1,
coalesce(n, 0) >= CASE WHEN split = 'test' THEN {K} ELSE 2 END AS enough FROM parts p LEFT JOIN sizes USING (kind, brand)),
{edges_sql(2, pts='own', name='inside', where="AND q.enough AND q.stratum = c.stratum")},
edges AS (SELECT * FROM inside UNION ALL SELECT e.* FROM everywhere e JOIN own o ON e.query_id = o.row_id WHERE NOT o.enough)"""


@query("knn_stratified", f"WITH {STRATIFIED_SQL} SELECT {EDGE_COLUMNS} FROM edges")
def knn_stratified(spark, sf):
    return rounded(_edges(parts(spark, sf), SEARCH_MODES["stratified"]), "distance")


@query("knn_sweep", f"""WITH {PART_PTS}, {edges_sql(2)}, ks AS (SELECT unnest([2, 4, 8]) AS k)
SELECT CAST(k AS INTEGER) AS k, query_id, {s6('avg(price)', 'neighbour_price')} FROM edges JOIN parts ON neighbor_id = row_id JOIN ks ON rank <= k GROUP BY k, query_id""")
def knn_sweep(spark, sf):
    """One edge table at the largest k serves every smaller k."""
    df = parts(spark, sf)
    near = neighbors.lookup_join(_edges(df), df.select(F.col("row_id").alias("neighbor_id"), "price"), "neighbor_id", "inner", 64)
    by_k = near.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in (2, 4, 8)]), lambda k: F.col("rank") <= k)))
    return by_k.groupBy("k", "query_id").agg(r6(F.avg("price")).alias("neighbour_price"))


# ---- search through a tree, codes and rotated vectors --------------------------------------------

CODED = f"""{PARTS}, b AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS bc, count(*) AS bn FROM parts WHERE split = 'train' GROUP BY brand),
t AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS tc, count(*) AS tn FROM parts WHERE split = 'train' GROUP BY kind),
w AS (SELECT DISTINCT name AS seen FROM parts WHERE split = 'train'), total AS (SELECT count(*) AS n FROM parts WHERE split = 'train'),
coded AS (SELECT p.* EXCLUDE (brand, kind), p.brand, p.kind, coalesce(bc, {{unseen}}) AS bc, coalesce(tc, {{unseen}}) AS tc, coalesce(bn, 0) / n AS bf, coalesce(tn, 0) / n AS tf,
bc IS NOT NULL AS bs, tc IS NOT NULL AS ts, seen IS NOT NULL AS ns FROM parts p CROSS JOIN total LEFT JOIN b USING (brand) LEFT JOIN t USING (kind) LEFT JOIN w ON seen = name)"""


@query("knn_tree", f"WITH {PART_PTS}, {edges_sql(2)} SELECT {EDGE_COLUMNS} FROM edges")
def knn_tree(spark, sf):
    """The same search through a tree of several levels."""
    return rounded(_edges(parts(spark, sf), limits=TreeLimits(cell_rows=96, fanout=6, block_rows=200, query_rows=600)), "distance")


@query("knn_wide", _cosine_sql())
def knn_wide(spark, sf):
    """Wide vectors in their principal axes: prefixes and the norms of the rests close most pairs."""
    from cadastre.operators.split import hash_split

    v = hash_split(tabular.read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding"), "row_id")
    edges = tree_join(v, v.filter("split = 'train'"), K, vec_col="embedding", metric="cosine", rotate=True)
    return rounded(edges, "distance")


def _different(c: str, seen: str) -> str:
    return f"CASE WHEN q.{c} = c.{c} THEN 0 WHEN q.{seen} THEN 2 ELSE 1 END"


@query("knn_wide_onehot", f"""WITH {CODED.format(unseen=-1)}, {standard_sql(['size', 'retail'], 'coded', extra=', brand, kind, name, bs, ts, ns')},
edges_top AS (SELECT q.row_id AS query_id, min(struct_pack(d := round(sqrt((q.x0 - c.x0) * (q.x0 - c.x0) + (q.x1 - c.x1) * (q.x1 - c.x1) + {_different('brand', 'bs')} + {_different('kind', 'ts')} + {_different('name', 'ns')}), 9), i := c.row_id), {K}) AS near
FROM pts q, pts c WHERE c.split = 'train' AND q.row_id <> c.row_id GROUP BY q.row_id),
edges AS (SELECT query_id, unnest(range(1, len(near) + 1)) AS rank, unnest(near).i AS neighbor_id, unnest(near).d AS distance FROM edges_top)
SELECT {EDGE_COLUMNS} FROM edges""")
def knn_wide_onehot(spark, sf):
    """One-hot distances over columns of any number of categories, part names among them."""
    space = SearchSpace(["size", "retail"], ["brand", "kind", "name"], category="onehot", widest=16)
    return rounded(_edges(parts(spark, sf), space, limits=TreeLimits(cell_rows=256)), "distance")


@query("knn_apart", f"WITH {CODED.format(unseen=-1)}, {standard_sql(['size', 'retail', 'bc', 'tc'], 'coded')}, {edges_sql(4)} SELECT {EDGE_COLUMNS} FROM edges")
def knn_apart(spark, sf):
    return rounded(_edges(parts(spark, sf), SearchSpace(["size", "retail"], ["brand", "kind"], category="apart")), "distance")


@query("knn_frequency", f"""WITH {CODED.format(unseen=-1)}, {standard_sql(['size', 'retail'], 'coded', extra=', bf AS x2, tf AS x3')}, {edges_sql(4)} SELECT {EDGE_COLUMNS} FROM edges""")
def knn_frequency(spark, sf):
    return rounded(_edges(parts(spark, sf), SearchSpace(["size", "retail"], ["brand", "kind"], category="frequency")), "distance")


@query("knn_labels", f"WITH {CODED.format(unseen=0)}, {standard_sql(['bc', 'tc'], 'coded')}, {edges_sql(2)} SELECT {EDGE_COLUMNS} FROM edges")
def knn_labels(spark, sf):
    return rounded(_edges(parts(spark, sf), SEARCH_MODES["labels"]), "distance")


# ---- neighbour features ------------------------------------------------------------------------

NEAR_SQL = f"WITH {PART_PTS}, {edges_sql(2)}, near AS (SELECT query_id, p.* FROM edges JOIN parts p ON neighbor_id = p.row_id)"


def mode_cte(c: str) -> str:
    return (f"mode_{c} AS (SELECT query_id, {c} FROM (SELECT query_id, {c}, row_number() OVER (PARTITION BY query_id "
            f"ORDER BY count(*) DESC, {c}) AS r FROM near GROUP BY query_id, {c}) WHERE r = 1)")


@query("neighbor_mean", f"{NEAR_SQL} SELECT query_id, {s6('avg(size)', 'rag_mean_size')}, {s6('avg(retail)', 'rag_mean_retail')} FROM near GROUP BY query_id")
def neighbor_mean(spark, sf):
    df = parts(spark, sf)
    out = neighbors.neighbor_features(_edges(df), df, "row_id", ["size", "retail"])
    return rounded(out, "rag_mean_size", "rag_mean_retail")


@query("neighbor_mode", f"{NEAR_SQL}, {mode_cte('brand')}, {mode_cte('kind')} SELECT query_id, b.brand AS rag_mode_brand, t.kind AS rag_mode_kind FROM mode_brand b JOIN mode_kind t USING (query_id)")
def neighbor_mode(spark, sf):
    df = parts(spark, sf)
    return neighbors.neighbor_features(_edges(df), df, "row_id", text=["brand", "kind"])


@query("neighbor_price", f"{NEAR_SQL} SELECT query_id, {s6('avg(price)', 'neighbour_price')} FROM near GROUP BY query_id")
def neighbor_price(spark, sf):
    df = parts(spark, sf)
    return rounded(neighbors.neighbor_features(_edges(df), df, "row_id", target="price"), "neighbour_price")


@query("neighbor_gap", f"{NEAR_SQL} SELECT p.row_id, {s6('p.size - avg(n.size)', 'size_vs_neighbors')} FROM parts p JOIN near n ON p.row_id = n.query_id GROUP BY p.row_id, p.size")
def neighbor_gap(spark, sf):
    df = parts(spark, sf)
    means = neighbors.neighbor_features(_edges(df), df, "row_id", ["size"]).withColumnRenamed("query_id", "row_id")
    joined = df.select("row_id", "size").join(means, "row_id")
    return rounded(neighbors.neighbor_gap(joined, "size", "rag_mean_size", "size_vs_neighbors").select("row_id", "size_vs_neighbors"), "size_vs_neighbors")


@query("neighbor_encode", f"""{NEAR_SQL}, {mode_cte('kind')},
f AS (SELECT p.row_id, p.split, m.kind, a.size FROM parts p LEFT JOIN mode_kind m ON m.query_id = p.row_id LEFT JOIN (SELECT query_id, avg(size) AS size FROM near GROUP BY 1) a ON a.query_id = p.row_id),
c AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS code FROM (SELECT DISTINCT coalesce(kind, 'None') AS kind FROM f WHERE split = 'train'))
SELECT row_id, CAST(coalesce(code, 0) AS INTEGER) AS rag_mode_kind, {s6("coalesce(size, (SELECT quantile_cont(size, 0.5) FROM f WHERE split = 'train'))", 'rag_mean_size')}
FROM f LEFT JOIN c ON coalesce(f.kind, 'None') = c.kind""")
def neighbor_encode(spark, sf):
    df = parts(spark, sf)
    near = neighbors.neighbor_features(_edges(df), df, "row_id", ["size"], ["kind"]).withColumnRenamed("query_id", "row_id")
    features = materialize(df.select("row_id", "split").join(near, "row_id", "left"), "neighbors")
    fitted = encode.fit_neighbor_encoding(features, ["rag_mode_kind"], ["rag_mean_size"])
    return rounded(fitted.apply(features).drop("split"), "rag_mean_size")


LISTING_PTS = f"""{LISTING}, {medians_sql(['n_lines', 'sum_qty', 'gross', 'acctbal'])},
filled AS (SELECT row_id, split, price, coalesce(l.n_lines, m.n_lines) AS n_lines, coalesce(l.sum_qty, m.sum_qty) AS sum_qty,
coalesce(l.gross, m.gross) AS gross, coalesce(l.acctbal, m.acctbal) AS acctbal FROM listing l, med m),
{standard_sql(['n_lines', 'sum_qty', 'gross', 'acctbal'], 'filled')}"""


@query("neighbor_price_metrics", f"""WITH {LISTING_PTS}, {edges_sql(4)},
near AS (SELECT query_id, avg(price) AS p FROM edges JOIN listing ON neighbor_id = row_id GROUP BY query_id),
j AS (SELECT split, price AS t, p FROM listing JOIN near ON row_id = query_id)
SELECT split, CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_dropped, {s6('avg((t - p) * (t - p))', 'mse', 1)}, {s6('sqrt(avg((t - p) * (t - p)))', 'rmse')},
{s6('avg(abs(t - p))', 'mae')}, {s6('1 - sum((t - p) * (t - p)) / (count(*) * var_pop(t))', 'r2', 9)},
{s6('sqrt(avg(pow(ln(1 + t) - ln(1 + p), 2)))', 'rmsle', 9)} FROM j GROUP BY split""")
def neighbor_price_metrics(spark, sf):
    """Flagship: fill, scale, search the training rows, average their price, judge it by split."""
    df = stored(listing(spark, sf), "row_id", "split", "price", *LISTING_SPACE.numeric, *LISTING_SPACE.text, *LISTING_SPACE.stratify)
    near = neighbors.neighbor_features(_edges(df, LISTING_SPACE), df, "row_id", target="price")
    judged = df.select("row_id", "split", "price").join(near.withColumnRenamed("query_id", "row_id"), "row_id")
    out = metrics.evaluate(judged, "price", "neighbour_price", ["split"])
    return rounded(rounded(rounded(out, "mse", digits=1), "rmse", "mae"), "r2", "rmsle", digits=9)


@query("top_rows", f"""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, CAST(rank AS INTEGER) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 3""")
def top_rows(spark, sf):
    lines = tabular.read_table(spark, sf, "lineitem")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return neighbors.top_rows(lines, ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("scored_export", f"""{NEAR_SQL}, np AS (SELECT query_id, avg(price) AS np FROM near GROUP BY query_id)
SELECT row_id, split, {s6('np', 'neighbour_price')}, {s6('price', 'price_true')}, CASE WHEN split = 'test' THEN {s6('price * 1.1', None)} END AS price_pred_rag_price
FROM parts LEFT JOIN np ON query_id = row_id""")
def scored_export(spark, sf):
    df = parts(spark, sf)
    price = neighbors.neighbor_features(_edges(df), df, "row_id", target="price")
    predictions = df.filter("split = 'test'").select("row_id", (F.col("price") * 1.1).alias("prediction"))
    out = tabular.scored_export(df, price, predictions, "row_id", "price")
    return rounded(out, "neighbour_price", "price_true", "price_pred_rag_price")


@query("feature_blocks", f"{NEAR_SQL} SELECT p.row_id, p.size, p.retail, {s6('p.price * 2', 'doubled')}, {s6('avg(n.size)', 'rag_mean_size')} "
       "FROM parts p LEFT JOIN near n ON p.row_id = n.query_id GROUP BY p.row_id, p.size, p.retail, p.price")
def feature_blocks(spark, sf):
    """Blocks side by side by key."""
    df = parts(spark, sf)
    near = neighbors.neighbor_features(_edges(df), df, "row_id", ["size"]).withColumnRenamed("query_id", "row_id")
    blocks = [df.select("row_id", "size", "retail"), df.select("row_id", r6(F.col("price") * 2).alias("doubled")), near]
    return rounded(rows.join_blocks(blocks), "rag_mean_size")
