import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastre.operators import neighbors, split
from cadastre.operators.knn import Limits, knn_join
from cadastre.operators.neighbors import SearchSpace

TINY = Limits(cell_rows=40, block_rows=50, query_rows=60, pivot_from=2)


def points(spark, x, strata=None, parts=5):
    data = [(int(i), [float(v) for v in row], str(strata[i]) if strata is not None else "s") for i, row in enumerate(x)]
    return spark.createDataFrame(data, "row_id bigint, features array<double>, g string").repartition(parts)


def brute(x, train, k, strata=None, metric="euclidean"):
    out = {}
    if metric == "cosine":
        norm = np.linalg.norm(x, axis=1)
        unit = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
        d = np.round(np.sqrt(np.maximum(2 * (1 - unit @ unit.T), 0)), 9)
    else:
        d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    for i in range(len(x)):
        ok = [j for j in train if j != i and (strata is None or strata[i] == strata[j])]
        out[i] = sorted(ok, key=lambda j: (d[i, j], j))[:k]
    return out


def found(edges):
    out = {}
    for r in sorted(edges.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["neighbor_id"])
    return out


@pytest.mark.parametrize("limits", [Limits(), TINY])
@pytest.mark.parametrize("parts", [2, 9])
def test_join_equals_brute_force(spark, limits, parts):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    x[200:400] = x[200]  # one vector fills a third of the rows
    train = [i for i in range(600) if i % 3]
    df = points(spark, x, parts=parts)
    got = found(knn_join(df, df.filter("row_id % 3 <> 0"), 7, limits=limits))
    assert got == brute(x, train, 7)


def test_join_within_strata_with_a_hot_stratum(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 2))
    strata = np.where(np.arange(500) < 300, "hot", np.char.add("s", (np.arange(500) % 40).astype(str)))
    df = points(spark, x, strata)
    got = found(knn_join(df, df, 5, by="g", limits=TINY))
    want = {i: n for i, n in brute(x, range(500), 5, strata).items() if n}
    assert got == want


def test_cosine_with_zero_vectors(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(60, 8)), 3)
    x[[4, 9]] = 0.0
    df = points(spark, x)
    edges = knn_join(df, df, 59, metric="cosine")
    zero = [r for r in edges.collect() if r["query_id"] == 4]
    assert len(zero) == 59 and all(abs(r["distance"] - 1) < 1e-9 for r in zero)
    got = found(knn_join(df, df, 4, metric="cosine"))
    assert {i: n for i, n in got.items() if i not in (4, 9)} == {i: n for i, n in brute(x, range(60), 4, metric="cosine").items() if i not in (4, 9)}


def test_k_is_capped_and_sole_row_has_no_neighbour(spark):
    df = points(spark, np.array([[0.0], [1.0], [3.0]]))
    assert found(knn_join(df, df, 10)) == {0: [1, 2], 1: [0, 2], 2: [1, 0]}
    assert knn_join(df.filter("row_id = 0"), df.filter("row_id = 0"), 3).count() == 0
    with pytest.raises(ValueError):
        knn_join(df, df, 0)


def houses(spark, n=300):
    rng = np.random.default_rng(6)
    data = [(int(i), float(rng.integers(1, 30)), float(rng.integers(1, 9)), "ABC"[i % 3], f"t{i % 40}", float(i)) for i in range(n)]
    df = spark.createDataFrame(data, "row_id bigint, a double, b double, c string, g string, price double")
    return split.hash_split(df, "row_id")


def test_neighbours_are_training_rows_and_never_the_row_itself(spark):
    df = houses(spark)
    train = {r["row_id"] for r in df.filter("split = 'train'").collect()}
    for space in (SearchSpace(["a", "b"]), SearchSpace(["a"], ["c"]), SearchSpace(["a"], ["c"], category="frequency"),
                  SearchSpace(["a"], ["c"], category="apart"), SearchSpace(["a", "b"], ["c"], metric="cosine", category="onehot")):
        edges = neighbors.neighbor_edges(df, 5, space).collect()
        assert len(edges) == 300 * 5
        assert all(e["neighbor_id"] in train and e["neighbor_id"] != e["query_id"] for e in edges)


def test_stratified_fallback_rules(spark):
    df = houses(spark)
    k = 6
    edges = neighbors.neighbor_edges(df, k, SearchSpace(["a", "b"], stratify=["g"]))
    got = {}
    for e in edges.collect():
        got.setdefault(e["query_id"], []).append(e["neighbor_id"])
    pdf = df.toPandas().set_index("row_id")
    size = pdf[pdf["split"] == "train"].groupby("g").size()
    for i, row in pdf.iterrows():
        n = size.get(row["g"], 0)
        inside = all(pdf.loc[j, "g"] == row["g"] for j in got[i])
        if n >= (k if row["split"] == "test" else 2):
            assert inside and len(got[i]) == min(k, n - (row["split"] == "train"))
        else:
            assert len(got[i]) == k


def test_space_without_columns_is_an_error(spark):
    with pytest.raises(ValueError):
        neighbors.neighbor_edges(houses(spark), 3, SearchSpace(["missing"]))


def test_neighbour_features_skip_nulls_and_break_ties(spark):
    edges = spark.createDataFrame([(1, 1, 10, 0.0), (1, 2, 11, 0.0), (1, 3, 12, 0.0)], "query_id bigint, rank int, neighbor_id bigint, distance double")
    source = spark.createDataFrame([(10, 4.0, "b"), (11, None, "a"), (12, 8.0, None)], "row_id bigint, x double, c string")
    row = neighbors.neighbor_features(edges, source, "row_id", ["x"], ["c"], target="x").first()
    assert row["rag_mean_x"] == 6.0 and row["rag_mode_c"] == "a" and row["neighbour_price"] == 6.0
    assert neighbors.neighbor_features(edges, source, "row_id", ["x"], k=1).first()["rag_mean_x"] == 4.0


def test_lookup_join_with_hot_keys(spark, monkeypatch):
    from cadastre.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_BYTES", 256 * 20)
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 90).alias("k"), "id")
    table = spark.range(50).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    rows = rows.withColumn("k", F.col("k").cast("int"))
    got = {(r["id"], r["v"]) for r in joins.lookup_join(rows, table, "k", hot_rows=100).collect()}
    assert got == {(r["id"], r["k"] * 2 if r["k"] < 50 else None) for r in rows.collect()}


def test_queries_that_share_a_vector_are_searched_once(spark, monkeypatch):
    from cadastre.operators import knn

    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(50, 2)), 12, axis=0)[rng.permutation(600)]
    train, searched, search = [i for i in range(600) if i % 3], [], knn._search
    monkeypatch.setattr(knn, "_search", lambda queries, *rest, **options: (searched.append(queries.select("id").distinct().count()), search(queries, *rest, **options))[1])
    df = points(spark, x)
    assert found(knn_join(df, df.filter("row_id % 3 <> 0"), 7, limits=TINY)) == brute(x, train, 7)
    assert max(searched) <= 50


def test_boxes_leave_few_cells_open(spark):
    from cadastre import kernels

    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(20_000, 3)), rng.integers(0, 5, (20_000, 1))], axis=1)
    boxes = kernels.Boxes(x, 100, 3)
    cell = boxes.leaf(x)
    leaves = np.unique(cell)
    boxes.fit(leaves, *(np.array([f(x[cell == c], axis=0) for c in leaves]) for f in (np.min, np.max)))
    at = rng.integers(0, 20_000, 300)
    bound = np.array([boxes.bound(x[at], np.full(300, c)) for c in leaves]).T
    gap = np.sqrt(((x[at, None, :3] - x[None, :, :3]) ** 2).sum(-1) + 2 * (x[at, None, 3] != x[None, :, 3]))
    least = np.array([gap[:, cell == c].min(1) for c in leaves]).T
    assert (bound <= least + 1e-9).all()
    assert (bound <= np.partition(gap, 8, axis=1)[:, 8:9]).sum(1).mean() < 12  # of some 250 cells


def test_codes_through_cells_equal_one_hot_columns(spark):
    rng = np.random.default_rng(10)
    x, codes = np.round(rng.normal(size=(500, 2)), 1), rng.integers(-1, 4, size=(500, 2))
    data = [(int(i), [float(v) for v in row], [float(c) for c in code]) for i, (row, code) in enumerate(zip(x, codes))]
    df = spark.createDataFrame(data, "row_id bigint, features array<double>, codes array<double>")
    gap = np.where(codes[:, None] == codes[None], 0, 2 - (codes[:, None] < 0) - (codes[None] < 0)).sum(-1)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1) + gap), 9)
    want = {i: sorted((j for j in range(500) if j != i), key=lambda j: (d[i, j], j))[:6] for i in range(500)}
    assert found(knn_join(df, df, 6, limits=TINY, codes_col="codes")) == want


def test_unit_vectors_sum_each_norm_once(spark):
    import time

    from cadastre.operators.knn import unit_vector

    df = spark.range(0, 40, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.rand(1) * 0 + i).alias("v"))
    start = time.time()
    row = df.select(unit_vector("v", "query").alias("u")).agg(F.sum(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)), F.min(F.size("u"))).first()
    assert abs(row[0] - 40) < 1e-9 and row[1] == 3002
    assert time.time() - start < 15


def test_queries_that_share_points_stay_spread(spark):
    """The few points are looked up by the many queries, which no broadcast gathers and no single task answers."""
    x = np.repeat(np.arange(60.0), 50)[:, None] * [1.0, 0.5]
    df = points(spark, x, parts=8)
    edges = knn_join(df, df, 3, limits=TINY)
    assert edges.rdd.getNumPartitions() > 1
    near = found(edges)
    for i in (0, 1, 49, 50, 2999):
        assert near[i] == [j for j in range(i // 50 * 50, i // 50 * 50 + 4) if j != i][:3]
