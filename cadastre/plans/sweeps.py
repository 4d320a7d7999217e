"""Queries over stored runs and growing stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.operators import metrics, neighbors, runs
from cadastre.operators.neighbors import SearchSpace
from cadastre.operators.split import hash_split
from cadastre.plans.registry import query, rounded, s6
from cadastre.plans.search import edges_sql, standard_sql
from cadastre.plans.views import PARTS, parts, split_sql
from cadastre.session import materialize, shared_folder
from cadastre.sources import growing_store as store
from cadastre.sources.tabular import read_table

SEEDS, KS = (42, 7), (2, 8)
SETTINGS = {"seed": "int", "rag_k": "int"}


def _evaluated(spark, sf, root) -> int:
    """Neighbour prices for each seed and k: one edge table a seed, at the largest k, and prices that are summed once for all seeds."""
    made = []

    def prepare(config):
        if not made:
            made.append(materialize(parts(spark, sf).select("row_id", "price", "size", "retail"), "prices"))
        df = materialize(hash_split(made[0], "row_id", config["seed"]), "parts")
        return df, materialize(neighbors.neighbor_edges(df, max(KS), SearchSpace(["size", "retail"])), "edges")

    def evaluate(config, ready):
        df, edges = ready
        near = neighbors.neighbor_features(edges, df, "row_id", target="price", k=config["rag_k"])
        judged = df.join(near.withColumnRenamed("query_id", "row_id"), "row_id")
        return metrics.evaluate(judged, "price", "neighbour_price", ["split"])

    return runs.sweep(spark, root, [{"seed": s, "rag_k": k} for s in SEEDS for k in KS], lambda c: c["seed"], prepare, evaluate)


def _seed_sql(seed: int) -> str:
    named = PARTS.replace("parts AS", f"parts{seed} AS").replace("prices", f"prices{seed}").replace(split_sql("p_partkey"), split_sql("p_partkey", str(seed)))
    near = f"near{seed} AS (SELECT k, query_id, avg(price) AS p FROM edges{seed} JOIN parts{seed} ON neighbor_id = row_id JOIN ks ON rank <= k GROUP BY k, query_id)"
    return f"{named}, {standard_sql(['size', 'retail'], f'parts{seed}', f'pts{seed}')}, {edges_sql(2, pts=f'pts{seed}', name=f'edges{seed}')}, {near}"


RUNS_SQL = f"""WITH ks AS (SELECT unnest({list(KS)}) AS k), {', '.join(map(_seed_sql, SEEDS))},
judged AS ({' UNION ALL '.join(f'SELECT {s} AS seed, k, split, price AS t, p FROM near{s} JOIN parts{s} ON row_id = query_id WHERE price IS NOT NULL AND p IS NOT NULL' for s in SEEDS)}),
runs AS (SELECT CAST(seed AS INTEGER) AS seed, CAST(k AS INTEGER) AS rag_k, split, count(*) AS n_rows, sqrt(avg((t - p) * (t - p))) AS rmse, avg(abs(t - p)) AS mae FROM judged GROUP BY ALL)"""


@query("sweep_runs", f"{RUNS_SQL} SELECT seed, rag_k, split, n_rows, {s6('rmse', 'rmse')}, {s6('mae', 'mae')} FROM runs")
def sweep_runs(spark, sf):
    """A sweep over seeds and k, read from its table of runs; a second start finds nothing to do."""
    root = shared_folder(spark, "runs")
    _evaluated(spark, sf, root)
    if _evaluated(spark, sf, root):
        raise RuntimeError("finished runs were computed again")
    return rounded(runs.results(spark, root, SETTINGS).select("seed", "rag_k", "split", "n_rows", "rmse", "mae"), "rmse", "mae")


@query("sweep_best", f"""{RUNS_SQL}, means AS (SELECT rag_k, avg(rmse) FILTER (split = 'val') AS val, avg(rmse) FILTER (split = 'test') AS test FROM runs GROUP BY rag_k)
SELECT rag_k, {s6('val', 'val_rmse')}, {s6('test', 'test_rmse')} FROM means QUALIFY row_number() OVER (ORDER BY val, rag_k) = 1""")
def sweep_best(spark, sf):
    """The k whose stored runs have the least mean validation error, with its test error."""
    root = shared_folder(spark, "runs")
    _evaluated(spark, sf, root)
    board = runs.results(spark, root, SETTINGS).groupBy("rag_k").agg(*[F.avg(F.when(F.col("split") == s, F.col("rmse"))).alias(f"{s}_rmse") for s in ("val", "test")])
    return rounded(board.orderBy("val_rmse", "rag_k").limit(1), "val_rmse", "test_rmse")


@query("growing_store", """SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'zero' WHEN text IN (SELECT text FROM documents WHERE lang = 'en' AND text IS NOT NULL) THEN 'stored' ELSE 'computed' END AS vector_source,
CAST(64 AS INTEGER) AS dims FROM documents""")
def growing_store(spark, sf):
    """Vectors of all documents from a store that English ones have filled before."""
    root, docs = shared_folder(spark, "store"), read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    store.look_up(docs.filter("lang = 'en'"), root, "terms", 64)
    return store.look_up(docs, root, "terms", 64).rows.select("doc_id", "vector_source", F.size("vector").alias("dims"))
