import numpy as np
from pyspark.sql import functions as F

from cadastre.operators import boxcox
from cadastre.operators.radix import grouped_quantiles
from cadastre.sources import vector_store

POINTS = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]


def test_quantiles_of_every_group_and_column_equal_numpy(spark):
    rng = np.random.default_rng(1)
    groups = ["hot"] * 300 + [f"g{i % 9}" for i in range(200)] + [None] * 5
    x = np.where(rng.random(505) < 0.3, 5.0, rng.normal(size=505) * 10.0 ** rng.integers(-300, 300, 505))
    y = [None if i % 7 == 0 else float("nan") if i % 11 == 0 else -0.0 if i % 5 == 0 else float(i - 250) for i in range(505)]
    df = spark.createDataFrame(list(zip(groups, x.tolist(), y)), "g string, x double, y double").repartition(5)
    got = {(r["g"], r["column"], r["point"]): r["value"] for r in grouped_quantiles(df, ["g"], ["x", "y"], POINTS).collect()}
    for g in set(groups):
        for name, column in (("x", x), ("y", y)):
            values = [float(v) for v, h in zip(column, groups) if h == g and v is not None and v == v]
            for p in POINTS:
                if values:
                    assert np.isclose(got.pop((g, name, p)), np.quantile(values, p), rtol=1e-9, atol=0)
    assert not got and grouped_quantiles(df.limit(0), [], ["x"], [0.5]).count() == 0


def test_newton_meets_the_derivative_and_ends_on_odd_columns(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.lognormal(3, 0.7, 400), rng.normal(60, 3, 300)])
    df = spark.createDataFrame([(float(v), 7.0, None) for v in x], "x double, same double, none double")
    llf = lambda lam: (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(np.var((x**lam - 1) / lam))
    lam = boxcox.fit_boxcox(df, "x", None).lam
    assert llf(lam) >= max(llf(lam + d) for d in (-1e-4, 1e-4, -1e-2, 1e-2))
    assert boxcox.fit_boxcox(df, "same", None).lam == boxcox.fit_boxcox(df, "none", None).lam == 1.0
    reciprocal = df.select((1 / F.col("x")).alias("x"))
    assert np.isclose(boxcox.fit_boxcox(reciprocal, "x", None).lam, -lam, atol=1e-6)


def test_order_repeats_and_nulls_change_the_digest(spark):
    frame = lambda rows: vector_store.fingerprint_text(spark.createDataFrame(rows, "k string, t string"), "k", "t")
    plain = [("1", "a"), ("2", "b"), ("3", None)]
    digests = [frame(r) for r in (plain, plain[::-1], [("1", "b"), ("2", "a"), ("3", None)], [("1", "a"), ("2", "b"), ("3", "")], [*plain, ("1", "a"), ("1", "a")], [*plain, ("3", None), ("3", None)], [("1", "a"), ("2", "b"), (None, None)])]
    assert digests[0] == digests[1] and len(set(digests[1:])) == 6
    assert frame([("1", "a"), ("1", "a"), ("2", "b")]) != frame([("3", "c"), ("3", "c"), ("2", "b")])
