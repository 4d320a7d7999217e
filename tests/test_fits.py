import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastre.operators import boxcox, encode, impute, rows, scale, split
from cadastre.operators.quantiles import exact_quantiles


def frame(spark, n=5000, seed=1, parts=7):
    rng = np.random.default_rng(seed)
    x = np.round(rng.lognormal(2, 1, n), 3)
    tied = np.where(rng.random(n) < 0.4, 5.0, np.round(rng.random(n) * 10, 1))
    data = [(int(i), float(a), float(b) if i % 11 else None, "abc"[int(b) % 3]) for i, (a, b) in enumerate(zip(x, tied))]
    return split.hash_split(spark.createDataFrame(data, "row_id bigint, x double, tied double, c string").repartition(parts), "row_id")


@pytest.mark.parametrize("small", [10, 10**9])
def test_quantiles_match_numpy(spark, small):
    df = frame(spark)
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, {"x": probs, "tied": probs}, small_rows=small, fetch_cap=100, accuracy=200)
    pdf = df.toPandas()
    for c in ("x", "tied"):
        assert np.allclose(got[c], np.quantile(pdf[c].dropna(), probs), rtol=0, atol=1e-12)


def test_splits_do_not_depend_on_partitioning(spark):
    keys = spark.range(1003).select(F.col("id").alias("row_id"))
    a = {tuple(r) for r in split.exact_split(keys.repartition(3), "row_id").collect()}
    b = {tuple(r) for r in split.exact_split(keys.repartition(11), "row_id").collect()}
    assert a == b
    held = math.ceil(0.3 * 1003)
    test = math.ceil(2 / 3 * held)
    sizes = {s: sum(1 for _, t in a if t == s) for s in ("train", "val", "test")}
    assert sizes == {"train": 1003 - held, "val": held - test, "test": test}
    assert split.exact_sample(keys, "row_id", 0.25).count() == 250
    assert split.exact_sample(keys, "row_id", size=5000).count() == 1003
    with pytest.raises(ValueError):
        split.exact_sample(keys, "row_id", 1.5)


def test_fits_ignore_validation_and_test_rows(spark):
    df = frame(spark)
    spoiled = df.withColumn("x", F.when(F.col("split") == "train", F.col("x")).otherwise(F.lit(1e9))).withColumn(
        "c", F.when(F.col("split") == "train", F.col("c")).otherwise("zzz"))
    for fit in (impute.fit_median, scale.fit_minmax, scale.fit_robust):
        assert fit(df, ["x"]) == fit(spoiled, ["x"])
    # sums depend on task order in their last digits only
    assert scale.fit_standard(df, ["x"]).params["x"] == pytest.approx(scale.fit_standard(spoiled, ["x"]).params["x"], rel=1e-12)
    assert scale.fit_winsor(df, ["x"]).limits == scale.fit_winsor(spoiled, ["x"]).limits
    assert boxcox.fit_boxcox(df, "x", rounds=2).lam == pytest.approx(boxcox.fit_boxcox(spoiled, "x", rounds=2).lam, rel=1e-6)
    assert encode.fit_ordinal(df, "c") == encode.fit_ordinal(spoiled, "c")


def test_imputers(spark):
    data = [(1, "train", 1.0, "b", None), (2, "train", 3.0, "a", None), (3, "train", None, "b", None), (4, "train", 8.0, "a", None), (5, "test", None, None, None)]
    df = spark.createDataFrame(data, "row_id int, split string, x double, c string, empty double")
    out = impute.fit_median(df, ["x", "empty"]).apply(df).orderBy("row_id").collect()
    assert [r["x"] for r in out] == [1.0, 3.0, 3.0, 8.0, 3.0] and out[0]["empty"] is None
    assert impute.fit_mode(df, ["c"]).values == {"c": "a"}  # tie: smallest
    assert impute.fit_mode(df.filter("row_id = 5"), ["c"], None).values == {"c": "unknown"}
    assert [r["c"] for r in impute.fit_clean(df, ["x"], ["c"]).apply(df).orderBy("row_id").collect()][-1] == "None"
    assert rows.needs_imputing(df, ["c"]) and "empty" not in rows.keep_filled(df, ["x", "empty"]).columns


def test_tree_fill_predicts_and_falls_back(spark):
    data = [(i, "train" if i % 9 else "test", float(i % 10), 100.0 * (i % 10) if i % 7 else None, None if i else 2.0) for i in range(200)]
    df = spark.createDataFrame(data, "row_id int, split string, a double, b double, rare double")
    fitted = impute.fit_tree(df, ["a", "b", "rare"])
    assert [t[0] for t in fitted.trees] == ["b"]
    out = fitted.apply(df).collect()
    assert all(abs(r["b"] - 100.0 * r["a"]) < 1e-6 for r in out)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, "train", 4.0), (2, "train", 4.0), (3, "test", 6.0)], "row_id int, split string, x double")
    for fit in (scale.fit_standard, scale.fit_minmax, scale.fit_robust):
        assert [r["x"] for r in fit(df, ["x"]).apply(df).orderBy("row_id").collect()] == [0.0, 0.0, 2.0]


def test_winsor_gate(spark):
    just_skewed = [(i, "train", float(i)) for i in range(100)] + [(100, "train", 1e6)]
    df = spark.createDataFrame(just_skewed, "row_id int, split string, x double")
    fitted = scale.fit_winsor(df, ["x"])
    assert fitted.limits["x"] == (25.0 - 3.5 * 50, 75.0 + 3.5 * 50)
    assert fitted.apply(df).agg(F.max("x")).first()[0] == 250.0
    assert scale.fit_winsor(df.filter("row_id < 100"), ["x"]).limits == {}


def test_boxcox_lambda_matches_dense_search(spark):
    df = frame(spark, 2000)
    x = np.array([r["x"] for r in df.filter("split='train'").collect()])
    llf = lambda lam: (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(np.var(np.log(x) if lam == 0 else (x**lam - 1) / lam))
    grid = np.linspace(-1, 1, 20001)
    best = grid[np.argmax([llf(v) for v in grid])]
    fitted = boxcox.fit_boxcox(df, "x")
    assert abs(fitted.lam - best) < 2e-4
    low = spark.createDataFrame([(float(v), "train") for v in range(-5, 50)], "x double, split string")
    assert boxcox.fit_boxcox(low, "x", rounds=1).shift == 6.0
    back = low.select("x", boxcox.BoxCox("x", 0.5, 6.0).undo(boxcox.forward(F.col("x") + 6.0, 0.5)).alias("y")).collect()
    assert all(abs(max(r["x"], 0) - r["y"]) < 1e-9 for r in back)


def test_encoders_unseen_and_many(spark):
    data = [(1, "train", "b"), (2, "train", "a"), (3, "train", "b"), (4, "test", "zzz"), (5, "train", None)]
    df = spark.createDataFrame(data, "row_id int, split string, c string")
    codes = lambda o: [r["k"] for r in o.apply(df, "k").orderBy("row_id").collect()]
    for limit in (256, 1):  # literal map and code table
        assert codes(encode.fit_ordinal(df, "c", "mode", literal_limit=limit)) == [2, 1, 2, 2, 0]
        assert codes(encode.fit_ordinal(df, "c", "none", literal_limit=limit)) == [2, 1, 2, 0, 0]
        assert codes(encode.fit_ordinal(df, "c", "minus_one", literal_limit=limit)) == [2, 1, 2, -1, 0]
        share = encode.fit_frequency(df, "c", literal_limit=limit).apply(df, "s").orderBy("row_id").collect()
        assert [r["s"] for r in share] == [0.5, 0.25, 0.5, 0.0, 0.25]
    hot = encode.fit_onehot(df, "c").apply(df).orderBy("row_id").collect()
    assert [hot[3][f"c_{v}"] for v in ("None", "a", "b")] == [0, 0, 0] and hot[4]["c_None"] == 1
    with pytest.raises(ValueError):
        encode.fit_onehot(df, "c", max_columns=2)


def test_numbering_is_dense_and_sorted(spark):
    values = spark.range(20000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("value")).repartition(13)
    got = sorted((r["code"], r["value"]) for r in encode.numbered(values).collect())
    assert [c for c, _ in got] == list(range(20000)) and [v for _, v in got] == sorted(v for _, v in got)
