import pytest
from pyspark.sql import functions as F

from cadastre.operators import runs
from cadastre.sources import growing_store


def test_a_sweep_that_was_killed_goes_on_where_it_stopped(spark, tmp_path):
    root, made, prepared = f"file://{tmp_path}/runs", [], []
    configs = [{"seed": s, "k": k} for s in (1, 2) for k in (3, 4)] + [{"k": 3, "seed": 1}]
    frame = lambda c: spark.range(2).select((F.col("id") * c["seed"] + c["k"]).alias("v"))

    def evaluate(config, ready):
        if len(made) == 2 and not prepared[2:]:
            prepared.append("killed")
            raise KeyboardInterrupt
        made.append(runs.config_id(config))
        return frame(config)

    start = lambda: runs.sweep(spark, root, configs, lambda c: c["seed"], lambda c: prepared.append(c["seed"]), evaluate)
    with pytest.raises(KeyboardInterrupt):
        start()
    assert start() == 2 and start() == 0 and len(set(made)) == len(made) == 4 and prepared == [1, 2, "killed", 2]
    got = {(r["seed"], r["k"], r["v"]) for r in runs.results(spark, root, {"seed": "int", "k": "int"}).collect()}
    assert got == {(s, k, i * s + k) for s in (1, 2) for k in (3, 4) for i in (0, 1)}
    with pytest.raises(ValueError):
        runs.results(spark, f"file://{tmp_path}/none", {})


def test_a_store_computes_each_text_once_and_reads_the_buckets_in_demand(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    docs = spark.createDataFrame([(i, f"text number {i % 40}", "x") for i in range(80)] + [(90, None, "x"), (91, "  ", "x")], "id int, text string, path string")
    first = growing_store.look_up(docs, root, "m", 16)
    assert first.computed == 40 and first.files == 0
    rows = first.rows.collect()
    assert {r["vector_source"] for r in rows if r["id"] < 90} == {"computed"} and {r["vector_source"] for r in rows if r["id"] >= 90} == {"zero"} and len(rows) == 82
    again = growing_store.look_up(docs.filter("id = 5"), root, "m", 16)
    assert again.computed == 0 and 0 < again.files_read < again.files
    row = again.rows.first()
    assert row["vector_source"] == "stored" and row["vector"] == next(r["vector"] for r in rows if r["id"] == 5) and any(row["vector"])
    assert growing_store.look_up(docs.filter("id = 5"), root, "other", 16).computed == 1
    assert growing_store.look_up(docs.limit(0), root, "m", 16).rows.count() == 0


def test_sweep_sums_its_prices_once(spark, monkeypatch):
    from cadastre.plans import sweeps

    made = []
    monkeypatch.setattr(sweeps, "parts", lambda *given, whole=sweeps.parts: made.append(given) or whole(*given))
    assert sweeps.sweep_runs(spark, "/root/testdata/sf0.001").count() == 12
    assert len(made) == 1
