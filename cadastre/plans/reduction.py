"""Queries: vector columns, reduction, clusters, correlations and feature interactions."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from cadastre.operators import interactions, neighbors, scale, vectors
from cadastre.operators.split import hash_split
from cadastre.plans.registry import query, r6, rounded, s6
from cadastre.plans.search import _edges
from cadastre.plans.views import PARTS, parts, split_sql
from cadastre.session import checkpoint_dir, materialize, small_table
from cadastre.sources import vector_store
from cadastre.sources.tabular import read_table


def _embeddings(spark, sf):
    rows = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", "label")
    return hash_split(rows, "row_id")


@query("emb_columns", "SELECT vec_id AS row_id, " + ", ".join(f"embedding[{i + 1}] AS emb_{i}" for i in range(4)) + ", CAST(NULL AS FLOAT) AS emb_64 FROM embeddings")
def emb_columns(spark, sf):
    wide = vectors.to_columns(_embeddings(spark, sf), "embedding", 65)
    return wide.select("row_id", *[f"emb_{i}" for i in range(4)], "emb_64")


@query("zero_blocks", f"""SELECT label, CAST(count(*) AS BIGINT) AS n_rows, {s6('max(list_max(list_transform(embedding, lambda x: abs(x))))', 'largest')},
CAST(max(list_max(list_transform(embedding, lambda x: abs(x)))) = 0 AS INTEGER) AS all_zero FROM embeddings GROUP BY label""")
def zero_blocks(spark, sf):
    return rounded(vectors.block_report(_embeddings(spark, sf), "embedding", "label"), "largest")


@query("pca_embed")
def pca_embed(spark, sf):
    df = _embeddings(spark, sf)
    fitted = vectors.fit_pca(df, "embedding", 16)
    out = vectors.to_columns(fitted.apply(df, "embedding").drop("embedding"), "reduced", 16, "pc_").drop("reduced")
    return out.withColumn("explained", F.lit(round(fitted.explained, 9)))


@query("svd_embed")
def svd_embed(spark, sf):
    df = _embeddings(spark, sf)
    fitted = vectors.fit_svd(df, "embedding", 16)
    out = vectors.to_columns(fitted.apply(df, "embedding").drop("embedding"), "reduced", 16, "sv_").drop("reduced")
    return out.withColumn("explained", F.lit(round(fitted.explained, 9)))


@query("pca_energy", f"""WITH v AS (SELECT vec_id, embedding AS e, {split_sql('vec_id')} AS split FROM embeddings),
x AS (SELECT vec_id, i, CAST(e[i] AS DOUBLE) AS x FROM v, (SELECT unnest(range(1, 65)) AS i) WHERE split = 'train')
SELECT {s6('sum(var)', 'variance')} FROM (SELECT var_pop(x) AS var FROM x GROUP BY i)""")
def pca_energy(spark, sf):
    """A full-width rotation keeps the total variance of the training vectors."""
    df = _embeddings(spark, sf)
    fitted = vectors.fit_pca(df, "embedding", 64)
    train = vectors.to_columns(fitted.apply(df, "embedding").filter("split = 'train'"), "reduced", 64, "pc_")
    total = None
    for i in range(64):
        term = F.var_pop(f"pc_{i}")
        total = term if total is None else total + term
    return train.agg(r6(total).alias("variance"))


@query("artifact_reuse", f"""WITH n AS (SELECT vec_id AS row_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT row_id, {s6('v[1] / (sqrt(list_dot_product(v, v)) + 1e-8)', 'first', 9)} FROM n""")
def artifact_reuse(spark, sf):
    """Stored once, then found again by dimension, seed and fingerprint."""
    root = os.path.join(checkpoint_dir(spark), "cadastre", f"artifacts-{uuid.uuid4().hex}")
    docs = read_table(spark, sf, "documents")
    digest = vector_store.fingerprint_text(docs, "doc_id", "text")
    build = lambda: _embeddings(spark, sf).select("row_id", scale.l2_normalize("embedding").alias("v"))
    vector_store.reuse_or_build(spark, root, "unit", 64, 42, digest, build)
    again = vector_store.reuse_or_build(spark, root, "unit", 64, 42, digest, lambda: build().limit(0))
    return again.select("row_id", r6(F.col("v")[0], 9).alias("first"))


@query("geo_kmeans")
def geo_kmeans(spark, sf):
    df = parts(spark, sf)
    return vectors.fit_geo_clusters(df, ["size", "retail"])(df).select("row_id", "split", "geo_cluster")


@query("geo_kmeans_nearest", f"WITH {PARTS} SELECT row_id, CAST(1 AS INTEGER) AS nearest, CAST(12 AS BIGINT) AS clusters FROM parts")
def geo_kmeans_nearest(spark, sf):
    """Whether each row's centre is the nearest one, and the number of clusters in use."""
    df = parts(spark, sf)
    assign = vectors.fit_geo_clusters(df, ["size", "retail"])
    at = lambda c: F.pow(F.coalesce("size", F.lit(0.0)) - float(c[0]), 2.0) + F.pow(F.coalesce("retail", F.lit(0.0)) - float(c[1]), 2.0)
    placed = assign(df).select("row_id", "geo_cluster", F.array(*[at(c) for c in assign.centers]).alias("far"))
    near = (F.get("far", F.col("geo_cluster")) <= F.array_min("far") + 1e-9).cast("int")
    used = placed.agg(F.countDistinct("geo_cluster")).first()[0]
    return placed.select("row_id", near.alias("nearest"), F.lit(used).cast("bigint").alias("clusters"))


@query("pca_variances", f"""WITH v AS (SELECT vec_id, embedding AS e, {split_sql('vec_id')} AS split FROM embeddings),
x AS (SELECT i, CAST(e[i] AS DOUBLE) AS x FROM v, (SELECT unnest(range(1, 65)) AS i) WHERE split = 'train'),
d AS (SELECT unnest(range(64)) AS pc) SELECT CAST(pc AS INTEGER) AS pc, CAST(1 AS INTEGER) AS ordered, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS largest_covariance,
{s6('(SELECT sum(var) FROM (SELECT var_pop(x) AS var FROM x GROUP BY i))', 'total')} FROM d""")
def pca_variances(spark, sf):
    """What makes components principal: mean 0, no covariance with the others, variances in falling order that add up to the total."""
    df = _embeddings(spark, sf)
    fitted = vectors.fit_pca(df, "embedding", 64)
    train = fitted.apply(df, "embedding").filter("split = 'train'").select("reduced")
    products, n, sums = vectors.gram(train, "reduced", 64)
    mean = sums / n
    covariance = products / n - np.outer(mean, mean)
    variance = covariance.diagonal()
    apart = np.abs(covariance - np.diag(variance)).max(axis=1)
    rows = [(i, int(i == 0 or variance[i - 1] >= variance[i] - 1e-9), float(round(abs(mean[i]), 6)), float(round(apart[i], 6)), float(variance.sum())) for i in range(64)]
    out = small_table(spark, rows, "pc int, ordered int, mean double, largest_covariance double, total double")
    return rounded(out, "total")


# ---- correlations and interactions -----------------------------------------------------------------

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "days"]
TARGET = "charge"
SOURCE_SQL = f"""src AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
l_extendedprice * (1 - l_discount) AS net, CAST(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS DOUBLE) AS days,
l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, {split_sql('l_orderkey')} AS split FROM lineitem),
fit AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in COLUMNS)} FROM src WHERE split = 'train'),
std AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, split, charge, {", ".join(f"greatest(-3, least(3, ({c} - m_{c}) / s_{c})) AS {c}" for c in COLUMNS)} FROM src, fit)"""
PAIR_COLUMNS = [*COLUMNS, "target"]


def _corr_sql(a: str, b: str) -> str:
    pick = lambda c: "charge" if c == "target" else c
    return (f"SELECT '{a}' AS feature, '{b}' AS other, covar_pop({pick(a)}, {pick(b)}) / (stddev_pop({pick(a)}) * stddev_pop({pick(b)})) AS corr "
            "FROM std WHERE split = 'train'")


CORR_SQL = SOURCE_SQL + ", corr AS (" + " UNION ALL ".join(_corr_sql(a, b) for a in COLUMNS for b in PAIR_COLUMNS if a != b) + ")"
POSITIONS = ", ".join(f"('{c}', {i})" for i, c in enumerate(COLUMNS))
FNI_EDGES_SQL = f"""{CORR_SQL}, pos(other, pos) AS (VALUES {POSITIONS}), pull AS (SELECT feature AS other, abs(corr) AS pull FROM corr WHERE other = 'target'),
pairs AS (SELECT feature, c.other, corr, pull, pos, CASE WHEN corr > 0.15 THEN 0 ELSE 1 END AS tier,
round(CASE WHEN corr > 0.15 THEN abs(corr) + 0.3 * pull ELSE abs(corr) END, 12) AS score
FROM corr c JOIN pos USING (other) JOIN pull USING (other) WHERE c.other <> 'target'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY tier, score DESC, pos) AS rank FROM pairs),
top AS (SELECT *, greatest(0.1, abs(corr)) * (0.5 + 0.5 * least(1, pull)) AS raw FROM ranked WHERE rank <= 3),
fni AS (SELECT feature, rank, other, corr, tier, raw / (sum(raw) OVER (PARTITION BY feature) + 1e-10) AS weight FROM top)"""


def _lines(spark, sf):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        net.alias("net"), F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double").alias("days"),
        (net * (1 + F.col("l_tax"))).alias("charge"),
    )
    df = materialize(hash_split(rows, "l_orderkey"), "lines")  # read by the fit and by what follows
    return scale.fit_standard(df, COLUMNS).apply(df)


@query("corr_matrix", f"WITH {CORR_SQL} SELECT feature, other, {s6('corr', 'corr')} FROM corr")
def corr_matrix(spark, sf):
    return rounded(interactions.correlation_table(_lines(spark, sf), COLUMNS, TARGET, clip_input=3.0), "corr")


@query("fni_edges", f"WITH {FNI_EDGES_SQL} SELECT feature, CAST(rank AS INTEGER) AS rank, other, {s6('corr', 'corr')}, CAST(tier AS INTEGER) AS tier, {s6('weight', 'weight')} FROM fni")
def fni_edges(spark, sf):
    table = interactions.correlation_table(_lines(spark, sf), COLUMNS, TARGET, clip_input=3.0)
    return rounded(interactions.choose_edges(table, COLUMNS, 3), "corr", "weight")


def _fni_value(c: str) -> str:
    total = " + ".join(
        f"{c} * {o} * coalesce((SELECT weight FROM fni WHERE feature = '{c}' AND other = '{o}'), 0)" for o in COLUMNS if o != c)
    return f"({total})"


FNI_ROOTS = ", ".join(f"sign({_fni_value(c)}) * sqrt(abs({_fni_value(c)}) + 1) AS fni_{c}" for c in COLUMNS)
FNI_FIT = ", ".join(f"quantile_cont(fni_{c}, 0.25) AS a_{c}, quantile_cont(fni_{c}, 0.5) AS b_{c}, quantile_cont(fni_{c}, 0.75) AS c_{c}" for c in COLUMNS)


@query("fni_values", f"""WITH {FNI_EDGES_SQL}, v AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, split, {FNI_ROOTS} FROM std),
q AS (SELECT {FNI_FIT} FROM v WHERE split = 'train') SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, """
       + ", ".join(s6(f"(fni_{c} - b_{c}) / coalesce(nullif(c_{c} - a_{c}, 0), 1)", f"fni_{c}", 5) for c in COLUMNS) + " FROM v, q")
def fni_values(spark, sf):
    df = _lines(spark, sf)
    fitted = interactions.fit_interactions(df, COLUMNS, TARGET, k=3)
    out = fitted.apply(df).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *fitted.names)
    return rounded(out, *fitted.names, digits=5)


@query("fni_variants")
def fni_variants(spark, sf):
    """Interactions on numbers and neighbour means, separately (dual) and together."""
    df = parts(spark, sf)
    near = neighbors.neighbor_features(_edges(df), df, "row_id", ["size", "retail"]).withColumnRenamed("query_id", "row_id")
    df = df.join(near, "row_id", "left").fillna(0.0, ["rag_mean_size", "rag_mean_retail", "price"])
    df = materialize(df, "neighbors")
    means = ["rag_mean_size", "rag_mean_retail"]
    df = scale.fit_standard(df, ["size", "retail", *means]).apply(df)
    dual, dual_names = interactions.interaction_variants(df, ["size", "retail"], means, "price", "fni_dual")
    joint = interactions.fit_interactions(dual, ["size", "retail", *means], "price", prefix="joint_")
    return joint.apply(dual).select("row_id", "split", *dual_names, *joint.names)
