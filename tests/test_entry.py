import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import canonical

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["null_profile", "exact_split", "impute_mode", "boxcox_grid", "ordinal_mode", "text_structured", "vector_misses", "leaderboard", "neighbor_price_metrics"]


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert {r["split"] for r in rows} == {"train", "val", "test"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
