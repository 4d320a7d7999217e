"""Queries: metrics, ensembles, leaderboards, best configurations.

Predictions are the true price with seeded noise whose width depends on the configuration, for
every listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.functions import numeric
from cadastre.operators import boxcox, leaderboard, metrics, rows, split
from cadastre.plans.registry import query, r6, rounded, s6
from cadastre.plans.views import LISTING, listing, unit_sql

MODELS = ["gbt", "forest", "linear"]
SEEDS = [0, 1, 2]
MODES = ["baseline", "emb", "rag@hybrid", "emb+rag", "rag_price", "other"]
RAG_KS = [4, 8]
PCA_DIMS = [12, 16]
METRICS = ["rmsle", "rmse", "mae"]


def _values(values) -> str:
    return "(SELECT unnest([" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]) AS v)"


PRED_SQL = f"""{LISTING}, preds AS (SELECT row_id, split, price AS truth, model.v AS model,
price * (0.8 + 0.4 * {unit_sql('row_id', "' || model.v || '")}) - CASE WHEN row_id % 50 = 0 THEN 3 * price ELSE 0 END AS prediction
FROM listing, {_values(MODELS)} model)"""


def predictions(spark, sf) -> DataFrame:
    """Long table of three models' predictions; one in fifty is far below zero."""
    df = listing(spark, sf).withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    wobble = F.lit(0.8) + F.lit(0.4) * split.hash_unit("row_id", F.col("model"))
    off = F.when(F.col("row_id") % 50 == 0, F.lit(3) * F.col("price")).otherwise(F.lit(0.0))
    return df.select("row_id", "split", F.col("price").alias("truth"), "model", (F.col("price") * wobble - off).alias("prediction"))


WIDTH_SQL = "0.2 + 0.02 * (mi + 2 * oi) + 0.3 / k.v + 0.4 / p.v"
RESULT_SQL = f"""{LISTING}, runs AS (SELECT CAST(seed.v AS INTEGER) AS seed, m.v AS mode, mo.v AS model, CAST(k.v AS INTEGER) AS rag_k, CAST(p.v AS INTEGER) AS pca_dim, split, price AS t,
price * (1 + ({unit_sql('row_id', "' || CAST(seed.v AS VARCHAR) || '")} - 0.5) * ({WIDTH_SQL})) AS p
FROM listing, {_values(SEEDS)} seed, (SELECT unnest({MODES}) AS v, unnest(range({len(MODES)})) AS mi) m, (SELECT unnest({MODELS}) AS v, unnest(range({len(MODELS)})) AS oi) mo,
{_values(RAG_KS)} k, {_values(PCA_DIMS)} p WHERE split <> 'train'),
scored AS (SELECT seed, mode, model, rag_k, pca_dim, split, round(sqrt(avg(pow(ln(1 + t) - ln(1 + p), 2))), 9) AS rmsle, round(sqrt(avg(pow(t - p, 2))), 4) AS rmse, round(avg(abs(t - p)), 4) AS mae
FROM runs GROUP BY seed, mode, model, rag_k, pca_dim, split),
results AS (SELECT v.seed, v.mode, v.model, v.rag_k, v.pca_dim, v.rmsle AS val_rmsle, t.rmsle AS test_rmsle, v.rmse AS val_rmse, t.rmse AS test_rmse
FROM (SELECT * FROM scored WHERE split = 'val') v JOIN (SELECT * FROM scored WHERE split = 'test') t USING (seed, mode, model, rag_k, pca_dim))"""


def scored_runs(spark, sf) -> DataFrame:
    """Metrics of a sweep (seed, mode, model, rag_k, pca_dim) by split."""
    struct = lambda values, name: F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(i).alias("i")) for i, v in enumerate(values)])).alias(name)
    df = listing(spark, sf).filter("split <> 'train'").select("row_id", "split", F.col("price").alias("t"))
    df = df.select("*", F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed"))
    df = df.withColumn("u", split.hash_unit("row_id", F.col("seed")) - 0.5)
    df = df.select("*", struct(MODES, "m")).select("*", struct(MODELS, "mo")).select("*", F.explode(F.array(*[F.lit(k) for k in RAG_KS])).alias("rag_k"))
    df = df.select("*", F.explode(F.array(*[F.lit(p) for p in PCA_DIMS])).alias("pca_dim"))
    width = F.lit(0.2) + F.lit(0.02) * (F.col("m.i") + F.lit(2) * F.col("mo.i")) + F.lit(0.3) / F.col("rag_k") + F.lit(0.4) / F.col("pca_dim")
    df = df.withColumn("p", F.col("t") * (F.lit(1) + F.col("u") * width))
    keys = ["seed", F.col("m.v").alias("mode"), F.col("mo.v").alias("model"), "rag_k", "pca_dim", "split"]
    return df.groupBy(*keys).agg(
        F.round(metrics.rmsle("t", "p"), 9).alias("rmsle"), F.round(metrics.rmse("t", "p"), 4).alias("rmse"), F.round(metrics.mae("t", "p"), 4).alias("mae")
    )


def sweep_results(spark, sf) -> DataFrame:
    """One row per run, validation and test side by side (a pivot in the same aggregation)."""
    scored = scored_runs(spark, sf)
    at = lambda s, m: F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}")
    return scored.groupBy("seed", "mode", "model", "rag_k", "pca_dim").agg(at("val", "rmsle"), at("test", "rmsle"), at("val", "rmse"), at("test", "rmse"))


RMSE = "sqrt(avg(pow(truth - prediction, 2)))"


OWN_RMSLE = "sqrt(avg(CASE WHEN truth >= 0 AND prediction >= -1 THEN pow(ln(1 + truth) - ln(1 + greatest(prediction, 0)), 2) END))"


@query("metrics_by_split", f"""WITH {PRED_SQL}
SELECT model, split, CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_dropped, {s6('avg(pow(truth - prediction, 2))', 'mse', 1)}, {s6(RMSE, 'rmse', 5)}, {s6('avg(abs(truth - prediction))', 'mae', 5)},
{s6('1 - sum(pow(truth - prediction, 2)) / (count(*) * var_pop(truth))', 'r2', 9)}, {s6(OWN_RMSLE, 'rmsle', 9)} FROM preds GROUP BY model, split""")
def metrics_by_split(spark, sf):
    """Every prediction counts in RMSE, MAE and R2, the far negative ones too; only RMSLE leaves those out."""
    out = metrics.evaluate(predictions(spark, sf), "truth", "prediction", ["model", "split"])
    return rounded(rounded(rounded(out, "mse", digits=1), "rmse", "mae", digits=5), "r2", "rmsle", digits=9)


@query("rmsle_variants", f"""WITH {PRED_SQL} SELECT model,
{s6('sqrt(avg(pow(ln(1 + greatest(truth, 0)) - ln(1 + greatest(prediction, 0)), 2)))', 'both_floored', 9)},
{s6('sqrt(avg(pow(ln(1 + greatest(truth, 0)) - ln(1 + greatest(prediction, -0.5)), 2)))', 'low_floor', 9)},
{s6("sqrt(avg(CASE WHEN prediction <= -1 THEN CAST('inf' AS DOUBLE) ELSE pow(ln(1 + greatest(truth, 0)) - ln(1 + greatest(prediction, -0.999999)), 2) END))", 'floor_at_pole', 9)},
{s6('sqrt(avg(pow(ln(1 + greatest(truth * 1000, 0)) - ln(1 + greatest(prediction * 1000, 0)), 2)))', 'scaled', 9)},
{s6('sqrt(avg(CASE WHEN prediction >= -1 AND truth >= 0 THEN pow(ln(1 + truth) - ln(1 + greatest(prediction, 0)), 2) END))', 'filtered', 9)} FROM preds GROUP BY model""")
def rmsle_variants(spark, sf):
    df = predictions(spark, sf)
    usable = (F.col("prediction") >= -1) & (F.col("truth") >= 0)
    return df.groupBy("model").agg(
        r6(metrics.rmsle("truth", "prediction"), 9).alias("both_floored"),
        r6(metrics.rmsle("truth", "prediction", pred_floor=-0.5), 9).alias("low_floor"),
        r6(metrics.rmsle("truth", "prediction", pred_floor=-1.0), 9).alias("floor_at_pole"),
        r6(metrics.rmsle("truth", "prediction", factor=1000.0), 9).alias("scaled"),
        r6(metrics.rmsle(F.when(usable, F.col("truth")), F.when(usable, F.col("prediction"))), 9).alias("filtered"),
    )


BACK_SQL = f"""{PRED_SQL}, b AS (SELECT row_id, split, model, truth, greatest(pow(greatest(prediction / 1e5 * 0.5 + 1, 1e-12), 2) - 1, 0) AS root_price,
exp(greatest(-20, least(20, prediction / 1e5))) - 1 AS log_price, ln(1 + truth) AS t_log, greatest(-20, least(20, prediction / 1e4)) AS p_log FROM preds)"""


@query("metrics_back_transform", f"""WITH {BACK_SQL} SELECT model, split, {s6('sqrt(avg(pow(truth / 1e5 - root_price, 2)))', 'root_rmse')},
{s6('avg(abs(truth / 1e5 - log_price))', 'log_mae')}, {s6('sqrt(avg(pow(t_log - p_log, 2)))', 'log_rmse')} FROM b GROUP BY model, split""")
def metrics_back_transform(spark, sf):
    """Scores in price space after undoing a Box-Cox or a log, and in log space with clipped predictions."""
    df = predictions(spark, sf).withColumn("z", F.col("prediction") / 1e5)
    df = metrics.back_transform(df, "z", lambda c: boxcox.inverse(c, 0.5, 1.0), "root_price")
    df = metrics.back_transform(df, "z", numeric.unlog, "log_price")
    unit = F.col("truth") / 1e5
    return df.groupBy("model", "split").agg(
        r6(metrics.rmse(unit, F.col("root_price"))).alias("root_rmse"),
        r6(metrics.mae(unit, F.col("log_price"))).alias("log_mae"),
        r6(metrics.log_rmse(F.log1p("truth"), F.col("prediction") / 1e4)).alias("log_rmse"),
    )


@query("ensemble_mean", f"WITH {PRED_SQL} SELECT row_id, split, {s6('avg(prediction)', 'ensemble', 4)}, CAST(count(*) AS BIGINT) AS n_models FROM preds GROUP BY row_id, split")
def ensemble_mean(spark, sf):
    return rounded(metrics.ensemble_mean(predictions(spark, sf), ["row_id", "split"]), "ensemble", digits=4)


@query("truth_join", f"""WITH {PRED_SQL} SELECT l.row_id, p.model, {s6('l.price - p.prediction', 'residual', 4)} FROM listing l JOIN preds p ON l.row_id = p.row_id WHERE p.split = 'test'""")
def truth_join(spark, sf):
    truth = listing(spark, sf).select("row_id", "price")
    test = predictions(spark, sf).filter("split = 'test'").select("row_id", "model", "prediction")
    return truth.join(test, "row_id").select("row_id", "model", r6(F.col("price") - F.col("prediction"), 4).alias("residual"))


@query("leaderboard", f"""WITH {RESULT_SQL}, a AS (SELECT model, split, avg(rmsle) AS rmsle, avg(rmse) AS rmse, avg(mae) AS mae, count(*) AS n FROM scored GROUP BY model, split)
SELECT model, split, CAST(CASE split WHEN 'val' THEN 0 ELSE 1 END AS INTEGER) AS part, {s6('rmsle', 'rmsle')}, {s6('rmse', 'rmse', 3)}, {s6('mae', 'mae', 3)} FROM a""")
def leaderboard_mean(spark, sf):
    """Mean per model and split, validation rows stacked before test rows."""
    scored = scored_runs(spark, sf)
    table = scored.groupBy("model", "split").agg(*[F.avg(m).alias(m) for m in METRICS])
    board = rows.stack(table.filter("split = 'val'"), table.filter("split = 'test'"), order="part")
    return rounded(rounded(board, "rmsle"), "rmse", "mae", digits=3).orderBy("part", "rmsle")


@query("leaderboard_std", f"""WITH {RESULT_SQL}, a AS (SELECT mode, model, 'p' || pca_dim || '_k' || rag_k || '_rp16' AS config, avg(val_rmsle) AS m, coalesce(stddev_samp(val_rmsle), 0) AS s
FROM results GROUP BY mode, model, pca_dim, rag_k)
SELECT mode, model, config, {s6('m', 'val_rmsle_mean')}, {s6('s', 'val_rmsle_std')},
regexp_replace(printf('%.4f', round(m, 4)), '(\\.\\d+?)0*$', '\\1') || ' ± ' || regexp_replace(printf('%.4f', round(s, 4)), '(\\.\\d+?)0*$', '\\1') AS val_rmsle_text FROM a""")
def leaderboard_std(spark, sf):
    results = sweep_results(spark, sf).withColumn("rag_pca_dim", F.lit(16))
    labelled = results.withColumn("config", leaderboard.config_label(fni=None))
    out = leaderboard.mean_std(labelled, ["mode", "model", "config"], ["val_rmsle"])
    return rounded(out, "val_rmsle_mean", "val_rmsle_std")


@query("seed_means", f"""WITH {RESULT_SQL} SELECT rag_k, pca_dim, mode, model, {s6('avg(val_rmsle)', 'val_rmsle')}, {s6('avg(test_rmsle)', 'test_rmsle')}
FROM results GROUP BY rag_k, pca_dim, mode, model""")
def seed_means(spark, sf):
    return leaderboard.mean_by(sweep_results(spark, sf), ["rag_k", "pca_dim", "mode", "model"], ["val_rmsle", "test_rmsle"], 6)


@query("mode_order", f"""WITH {RESULT_SQL} SELECT mode, model, CAST(coalesce(nullif(list_position({list(leaderboard.MODE_ORDER)}, split_part(mode, '@', 1)), 0), {len(leaderboard.MODE_ORDER) + 1}) AS INTEGER) AS mode_rank,
CAST(coalesce(nullif(list_position({MODELS}, model), 0), 4) AS INTEGER) AS model_rank, {s6('avg(val_rmsle)', 'val_rmsle')} FROM results GROUP BY mode, model""")
def mode_order(spark, sf):
    table = leaderboard.mean_by(sweep_results(spark, sf), ["mode", "model"], ["val_rmsle"])
    return leaderboard.in_order(table.withColumns({"mode_rank": leaderboard.mode_rank(), "model_rank": leaderboard.model_rank()}))


@query("best_config", f"""WITH {RESULT_SQL}, m AS (SELECT mode, model, rag_k, pca_dim, round(avg(val_rmsle), 9) AS val_rmsle, avg(test_rmsle) AS test_rmsle FROM results GROUP BY ALL)
SELECT mode, model, {s6('val_rmsle', 'val_rmsle')}, rag_k, pca_dim, {s6('test_rmsle', 'test_rmsle')} FROM m
QUALIFY row_number() OVER (PARTITION BY mode, model ORDER BY val_rmsle, rag_k, pca_dim) = 1""")
def best_config(spark, sf):
    """Best (rag_k, pca_dim) by validation per mode and model; its test value is reported once."""
    table = leaderboard.mean_by(sweep_results(spark, sf), ["mode", "model", "rag_k", "pca_dim"], ["val_rmsle", "test_rmsle"], 9)
    best = leaderboard.best_config(table, ["mode", "model"], "val_rmsle", ["test_rmsle"], ["rag_k", "pca_dim"])
    return rounded(best, "val_rmsle", "test_rmsle")


BEST = {"gbt": {"rag_k": 8, "pca_dim": 16, "rag_pca_dim": 16}, "forest": {"rag_k": 4, "pca_dim": 12, "rag_pca_dim": 16}}


@query("config_filter", f"""WITH {RESULT_SQL} SELECT seed, mode, model, rag_k, pca_dim, {s6('val_rmsle', 'val_rmsle')} FROM results WHERE CASE model WHEN 'gbt' THEN
CASE mode WHEN 'emb' THEN pca_dim = 16 WHEN 'rag_price' THEN rag_k = 8 WHEN 'emb+rag' THEN pca_dim = 16 AND rag_k = 8 ELSE TRUE END WHEN 'forest' THEN
CASE mode WHEN 'emb' THEN pca_dim = 12 WHEN 'rag_price' THEN rag_k = 4 WHEN 'emb+rag' THEN pca_dim = 12 AND rag_k = 4 ELSE TRUE END ELSE TRUE END""")
def config_filter(spark, sf):
    results = sweep_results(spark, sf).withColumn("rag_pca_dim", F.lit(16))
    kept = leaderboard.keep_best_config(results, BEST)
    return rounded(kept.select("seed", "mode", "model", "rag_k", "pca_dim", "val_rmsle"), "val_rmsle")


@query("key_union", f"""WITH {RESULT_SQL} SELECT mode, model FROM results WHERE val_rmsle < 0.08 UNION SELECT mode, model FROM results WHERE test_rmsle > 0.12""")
def key_union(spark, sf):
    results = sweep_results(spark, sf)
    return rows.key_union(results.filter("val_rmsle < 0.08"), results.filter("test_rmsle > 0.12"), ["mode", "model"])


@query("refit_union", f"WITH {LISTING} SELECT CASE WHEN split = 'test' THEN 'test' ELSE 'refit' END AS part, CAST(count(*) AS BIGINT) AS n_rows, {s6('sum(price)', 'total', 2)} FROM listing GROUP BY 1")
def refit_union(spark, sf):
    """Training rows of the refit (train and validation together) beside the test rows."""
    df = listing(spark, sf).select("row_id", "split", "price")
    both = rows.stack(df.filter("split = 'train'"), df.filter("split = 'val'")).withColumn("part", F.lit("refit"))
    out = both.unionByName(df.filter("split = 'test'").withColumn("part", F.lit("test")))
    return out.groupBy("part").agg(F.count("*").alias("n_rows"), r6(F.sum("price"), 2).alias("total"))
