import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastre.operators import gram


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e4, [1.0, 30.0, 0.1], (300, 3))
    y = x @ [2.0, -1.0, 5.0] + rng.normal(size=300)
    data = [(i, *map(float, a), 7.0, float(b)) for i, (a, b) in enumerate(zip(x, y))]
    extra = [(900, None, 1.0, 1.0, 7.0, 1.0), (901, 1.0, float("nan"), 1.0, 7.0, 1.0), (902, 1.0, 1.0, 1.0, 7.0, None)]
    df = spark.createDataFrame(data + extra, "id long, a double, `b.c` double, d double, same double, y double")
    return df.repartition(5), x, y


def test_every_fold_and_subset_equals_a_fit_on_the_rows(rows):
    df, x, y = rows
    folds = {"four": F.col("id") % 4, "two": F.when(F.col("id") >= 100, F.col("id") % 2)}
    grams = gram.fit_grams(df, ["a", "b.c", "d", "same"], "y", folds)
    fold = np.arange(300) % 4
    for columns, at in ((["a"], [0]), (["d", "a"], [2, 0]), (["a", "b.c", "d"], [0, 1, 2])):
        for held in ([1], [0, 3]):
            fit, train = grams.ridge(columns, "four", held), ~np.isin(fold, held)
            design = np.c_[np.ones(300), x[:, at] - x.mean(0)[at]]
            best = np.linalg.lstsq(design[train], y[train], rcond=None)[0]
            assert np.allclose(fit.coefficients, best[1:], rtol=1e-7)
            assert np.isclose(fit.rmse, np.sqrt(np.mean((y - design @ best)[~train] ** 2)), rtol=1e-7)
            assert (fit.n_train, fit.n_held) == (train.sum(), (~train).sum())
    assert grams.ridge(["a"], "two", [0]).n_train + grams.ridge(["a"], "two", [0]).n_held == 200
    whole = grams.ridge(["a", "b.c", "d"], "four")
    assert whole.rmse is None
    error = df.filter("id < 300").select(F.avg((F.col("y") - whole.predict()) ** 2)).first()[0]
    assert 0.7 < error < 1.2


def test_constant_and_repeated_columns_and_penalty(rows):
    df, x, y = rows
    grams = gram.fit_grams(df.filter("id < 300").withColumn("again", F.col("a")), ["a", "again", "same"], "y", {"all": F.lit(0)})
    alone, both = grams.ridge(["a"], "all"), grams.ridge(["a", "again", "same"], "all")
    assert both.coefficients[2] == 0 and np.isclose(sum(both.coefficients), alone.coefficients[0]) and np.isclose(*both.coefficients[:2])
    z = (x[:, 0] - x[:, 0].mean()) / x[:, 0].std()
    assert np.isclose(grams.ridge(["a"], "all", penalty=0.5).coefficients[0], (z @ y / 300) / 1.5 / x[:, 0].std(), rtol=1e-6)


def test_empty_tables_wide_tables_and_missing_groups(rows):
    df, *_ = rows
    with pytest.raises(ValueError, match="at most"):
        gram.fit_grams(df, ["a"] * (gram.WIDEST + 1), "y", {"all": F.lit(0)})
    with pytest.raises(ValueError, match="no training rows"):
        gram.fit_grams(df.limit(0), ["a"], "y", {"all": F.lit(0)}).ridge(["a"], "all")
    found = gram.linear_modes(df, {"base": ["a"], "rag": ["d"]}, "all", "y", {"three": F.col("id") % 3})
    assert {r["mode"] for r in found.collect()} == {"baseline", "rag"} and found.count() == 6
    assert gram.linear_modes(df.limit(0), {"base": ["a"]}, "baseline", "y", {"three": F.col("id") % 3}).count() == 0
