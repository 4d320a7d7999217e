import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastre.operators import interactions, leaderboard, metrics, models, split, vectors
from cadastre.session import small_table
from cadastre.sources import tabular, vector_store


def test_reductions_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6)) @ rng.normal(size=(6, 6)) + 3
    df = spark.createDataFrame([(i, "train" if i < 80 else "test", [float(v) for v in r]) for i, r in enumerate(x)], "row_id int, split string, v array<double>")
    train = x[:80]
    pca = vectors.fit_pca(df, "v", 3)
    values = np.linalg.svd(train - train.mean(0), compute_uv=False) ** 2
    assert np.isclose(pca.explained, values[:3].sum() / values.sum())
    got = np.array([r["reduced"] for r in pca.apply(df, "v").orderBy("row_id").collect()])
    assert np.allclose(got, (x - train.mean(0)) @ pca.components)
    svd = vectors.fit_svd(df, "v", 2)
    _, s, vt = np.linalg.svd(train, full_matrices=False)
    assert np.allclose(np.abs(svd.components), np.abs(vt[:2].T))
    moved = train @ vt[:2].T
    assert np.isclose(svd.explained, moved.var(0).sum() / train.var(0).sum())
    same = vectors.fit_svd(df, "v", 6)
    assert same.explained is None and same.apply(df, "v").first()["reduced"] == df.first()["v"]


def test_interactions_match_numpy(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 1))
    x = np.hstack([base + 0.5 * rng.normal(size=(400, 1)) for _ in range(4)] + [rng.normal(size=(400, 1))])
    y = x[:, 0] + rng.normal(size=400)
    cols = [f"x{i}" for i in range(5)]
    data = [(i, "train" if i % 4 else "test", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "row_id int, split string, " + ", ".join(f"{c} double" for c in cols) + ", y double")
    fitted = interactions.fit_interactions(df, cols, "y", k=2)
    got = np.array([[r[f"fni_{c}"] for c in cols] for r in fitted.apply(df).orderBy("row_id").collect()])
    tr = np.array([i % 4 != 0 for i in range(400)])
    z = np.clip(x, -3, 3)
    corr = np.corrcoef(z[tr].T)
    pull = np.abs([np.corrcoef(z[tr][:, j], y[tr])[0, 1] for j in range(5)])
    want = np.zeros_like(x)
    for i in range(5):
        others = [j for j in range(5) if j != i]
        passing = sorted((j for j in others if corr[i, j] > 0.15), key=lambda j: -(abs(corr[i, j]) + 0.3 * pull[j]))
        rest = sorted((j for j in others if j not in passing), key=lambda j: -abs(corr[i, j]))
        chosen = (passing + rest)[:2]
        w = np.array([max(0.1, abs(corr[i, j])) * (0.5 + 0.5 * min(1, pull[j])) for j in chosen])
        total = (z[:, [i]] * z[:, chosen]) @ (w / w.sum())
        want[:, i] = np.sign(total) * np.sqrt(np.abs(total) + 1)
    q1, q2, q3 = np.quantile(want[tr], [0.25, 0.5, 0.75], axis=0)
    assert np.allclose(got, (want - q2) / (q3 - q1), atol=1e-6)
    assert interactions.fit_interactions(df, ["x0"], "y").names == []


def test_constant_column_correlates_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert {v for v in interactions.correlations(df, {c: F.col(c) for c in "ab"}).values()} == {0.0}


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 1.0), (2.0, float("nan")), (4.0, -5.0)], "t double, p double")
    row = metrics.evaluate(df, "t", "p").first()
    truth, pred = np.array([1.0, 3.0, 4.0]), np.array([2.0, 3.0, -5.0])  # every finite pair; RMSLE leaves out the prediction below -1
    assert row["n_rows"] == 3 and row["n_dropped"] == 2 and np.isclose(row["mse"], 82 / 3) and np.isclose(row["mae"], 10 / 3)
    assert np.isclose(row["r2"], 1 - ((truth - pred) ** 2).sum() / ((truth - truth.mean()) ** 2).sum())
    assert np.isclose(row["rmsle"], np.sqrt(0.5 * (np.log(2) - np.log(3)) ** 2))


def test_modes_and_failing_model(spark):
    assert models.parse_modes("all") == list(models.MODE_GROUPS)
    with pytest.raises(ValueError):
        models.parse_modes("nope")
    rows = split.hash_split(spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 17).cast("double").alias("x")), "row_id")
    df = rows.withColumn("price", F.col("x") * 3 + 1).withColumn("label", F.log1p("price"))
    results, predictions = models.run_modes(df, {"base": ["x"]}, "baseline,emb", ["linear", "broken"], "label", "price", F.expm1)
    got = {(r["mode"], r["model"], r["split"]): r for r in results.collect()}
    assert got[("baseline", "linear", "test")]["n_rows"] > 0 and got[("baseline", "broken", None)]["error"]
    assert got[("emb", "linear", None)]["error"] and predictions.filter("split = 'train'").count() == 0


def test_leaderboards(spark):
    rows = [("emb", "gbt", 8, 16, 20, None, 0.15), ("emb", "gbt", 8, 16, 20, None, 0.25), ("fni", "gbt", None, None, None, 5, 0.3), ("x", "gbt", None, None, None, None, 1.0)]
    df = small_table(spark, rows, "mode string, model string, rag_k int, pca_dim int, rag_pca_dim int, fni_k int, v double")
    out = leaderboard.mean_std(df.withColumn("config", leaderboard.config_label()), ["mode", "config"], ["v"])
    assert {(r["mode"], r["config"], r["v_text"]) for r in out.collect()} == {
        ("emb", "p16_k8_rp20", "0.2 ± 0.0707"), ("fni", "fk5", "0.3 ± 0.0"), ("x", "-", "1.0 ± 0.0")}
    tied = small_table(spark, [("m", 2, 0.1, 0.5), ("m", 1, 0.1, 0.7), ("m", 3, None, 0.1)], "model string, k int, val double, test double")
    best = leaderboard.best_config(tied, ["model"], "val", ["test"], ["k"]).first()
    assert (best["k"], best["test"]) == (1, 0.7)


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "it's, a", 2.5), (2, None, None)], "id bigint, name string, x double")
    tabular.write_attribute_relation(df, str(tmp_path / "rel"))
    assert sorted(map(tuple, tabular.read_attribute_relation(spark, str(tmp_path / "rel")).collect())) == sorted(map(tuple, df.collect()))
    path = tabular.write_table(df, str(tmp_path / "t"), "csv", suffix="_k8")
    assert path.endswith("_k8") and tabular.read_csv(spark, path, "id bigint, name string, x double").count() == 2


def test_artifacts_need_matching_dimension_seed_and_fingerprint(spark, tmp_path):
    root, calls = str(tmp_path), []

    def build(n):
        calls.append(n)
        return spark.range(n)

    get = lambda dims, seed, digest, n: vector_store.reuse_or_build(spark, root, "a", dims, seed, digest, lambda: build(n)).count()
    assert [get(8, 1, "x", 3), get(8, 1, "x", 4), get(9, 1, "x", 5), get(8, 2, "x", 6), get(8, 1, "y", 7)] == [3, 3, 5, 6, 7]
    assert calls == [3, 5, 6, 7]


def test_vector_completion(spark):
    texts = spark.createDataFrame([(1, "known"), (2, "two words"), (3, "  "), (4, None)], "id int, text string")
    store = texts.filter("id = 1").select(vector_store.text_key("text", "m").alias("key"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("vector"))
    got = {r["id"]: r for r in vector_store.complete(texts, store, "m", 2).collect()}
    assert [got[i]["vector_source"] for i in (1, 2, 3, 4)] == ["stored", "computed", "zero", "zero"]
    assert got[1]["vector"] == [1.0, 2.0] and sum(got[2]["vector"]) == 2.0 and got[3]["vector"] == [0.0, 0.0]
    assert {r["text"] for r in vector_store.misses(texts, store, "m").collect()} == {"two words", "  "}


def test_interactions_of_many_columns_stay_compiled(spark):
    """The JVM never compiles methods above 8,000 bytes; cleaning, standardising and interacting eight columns stays below."""
    import re

    names = [f"c{i}" for i in range(8)]
    df = spark.range(40).select("id", *[F.sin(F.col("id") * (i + 2)).alias(c) for i, c in enumerate(names)])
    edges = {c: [(o, 0.3) for o in names if o != c][:3] for c in names}
    plain = interactions.Interactions(names, edges, 3.0, True, True, None, "fni_")
    shifted = df.withColumns({c: (F.col(c) - 0.5) / 0.7 for c in names})
    out = plain.apply(shifted).select("id", *[(F.round(F.col(n), 5) + 0.0).alias(n) for n in plain.names])
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", out._jdf.queryExecution().explainString(mode))
    assert sizes and max(map(int, sizes)) < 8000


def test_cleaned_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (None, float("nan"), inf, -inf, 5.0, -5.0, 0.25)], "x double")
    assert [r[0] for r in df.select(interactions.cleaned("x", 3.0)).collect()] == [0.0, 0.0, 0.0, 0.0, 3.0, -3.0, 0.25]
    assert [r[0] for r in df.select(interactions.cleaned("x", 0.0)).collect()] == [0.0, 0.0, 0.0, 0.0, 5.0, -5.0, 0.25]


def test_split_follows_the_hash_unit(spark):
    df = spark.range(3000).withColumn("u", split.hash_unit("id", 7))
    for train, val in ((0.7, 0.1), (1.0, 0.0), (0.0, 0.5), (0.25, 0.75)):
        plain = F.when(F.col("u") < train, "train").when(F.col("u") < train + val, "val").otherwise("test")
        assert split.hash_split(df, "id", 7, train, val).filter(F.col("split") != plain).isEmpty()
