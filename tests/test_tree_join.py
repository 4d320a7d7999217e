import numpy as np
import pytest

from cadastre import kernels
from cadastre.operators import neighbors
from cadastre.operators.neighbors import SearchSpace
from cadastre.operators.tree_join import Report, TreeLimits, tree_join
from tests.test_search import brute, found, houses, points

TINY = TreeLimits(cell_rows=20, fanout=4, first=1, widen=2, block_rows=50, query_rows=60)


def coded(spark, x, codes):
    data = [(int(i), [float(v) for v in row], [float(c) for c in code]) for i, (row, code) in enumerate(zip(x, codes))]
    return spark.createDataFrame(data, "row_id bigint, features array<double>, codes array<double>").repartition(5)


def brute_coded(x, codes, k):
    gap = np.where(codes[:, None] == codes[None], 0, 2 - (codes[:, None] < 0) - (codes[None] < 0)).sum(-1)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1) + gap), 9)
    return {i: sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:k] for i in range(len(x))}


def test_tree_equals_brute_force_and_leaves_stay_small(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 3)), 8 + rng.normal(size=(50, 3)), np.zeros((100, 3))])  # one vector fills a third of the rows
    train = [i for i in range(300) if i % 3]
    df, report = points(spark, x), Report()
    got = found(tree_join(df, df.filter("row_id % 3 <> 0"), 5, limits=TINY, report=report))
    assert got == brute(x, train, 5)
    assert report.levels >= 2 and report.rounds >= 1 and report.routed < 300 * report.leaves


def test_codes_equal_one_hot_columns(spark):
    rng = np.random.default_rng(4)
    x, codes = rng.normal(size=(120, 2)), rng.integers(-1, 6, size=(120, 2))
    codes[:, 0] += (np.arange(120) > 100) * (codes[:, 0] >= 0) * 7
    df = coded(spark, x, codes)
    assert found(tree_join(df, df, 6, codes_col="codes", limits=TINY)) == brute_coded(x, codes, 6)
    onehot = np.concatenate([x, *[np.eye(20)[c] * (c >= 0)[:, None] for c in codes.T]], axis=1)
    assert brute(onehot, range(120), 6) == brute_coded(x, codes, 6)
    with pytest.raises(ValueError):
        tree_join(df, df, 6, codes_col="codes", metric="cosine")


def test_no_rows_few_rows_and_odd_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [float("nan"), 1.0]), (3, None), (4, [0.0, 3.0])], "row_id bigint, features array<double>")
    assert found(tree_join(df, df, 3, limits=TINY)) == {1: [4], 4: [1]}
    assert tree_join(df, df.limit(0), 3, limits=TINY, rotate=True).count() == 0
    with pytest.raises(ValueError):
        tree_join(df, df, 0)


def test_a_prefix_of_the_principal_axes_closes_most_pairs():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 64)) * np.linspace(2, 0.05, 64) ** 3
    count = np.zeros(2, np.int64)
    ids = np.arange(400)
    q, c, d, r = kernels.near_pairs(ids, x, ids, x, 5, prefix=16, count=count)
    assert [v.tolist() for v in (q, c, d, r)] == [v.tolist() for v in kernels.top_k(ids, x, ids, x, 5)]
    assert count[1] > 0.5 * count[0]


def test_wide_onehot_space_gives_the_distances_of_the_narrow_one(spark):
    df = houses(spark, 150)
    edges = {}
    for widest in (2000, 2):
        space = SearchSpace(["a", "b"], ["c", "g"], category="onehot", widest=widest)
        edges[widest] = {(r["query_id"], r["rank"]): (r["neighbor_id"], round(r["distance"], 6)) for r in neighbors.neighbor_edges(df, 4, space).collect()}
    assert edges[2] == edges[2000] and len(edges[2]) == 600
