from pyspark.sql import functions as F

from cadastre.functions import buckets, numeric, strings
from cadastre.functions.text import Section, Template, append, delta_phrase, phrase, relative_phrase


def values(df, *exprs):
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_title_case_and_null_tokens(spark):
    df = spark.createDataFrame([(" o'neil port-phillip BAY ",), ("-",), (None,)], "t string")
    got = values(df, strings.title_case("t"), strings.null_tokens("t"))
    assert got[0] == ("O'Neil Port-Phillip Bay", "o'neil port-phillip BAY")
    assert got[1][1] is None and got[2] == (None, None)


def test_buckets_closed_sides_and_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (None,)], "x double")
    bands = [(1, "a"), (2, "b")]
    left = [r[0] for r in values(df, buckets.bucket("x", bands, "c"))]
    right = [r[0] for r in values(df, buckets.bucket("x", bands, closed="right"))]
    mixed = [r[0] for r in values(df, buckets.bucket("x", bands, "c", closed="mixed"))]
    assert left == ["b", "c", "c", "unknown"]
    assert right == ["a", "b", "b", "unknown"]
    assert mixed == ["b", "b", "c", "unknown"]


def test_numbers(spark):
    df = spark.createDataFrame([(6.0, 0.0), (6.0, 4.0), (None, 1.0), (float("inf"), 1.0)], "a double, b double")
    got = values(df, numeric.safe_ratio("a", "b"), numeric.finite_or("a"), numeric.signed_root(F.lit(0.0)), numeric.clip("a", 3))
    assert [g[0] for g in got[:3]] == [None, 1.5, None]
    assert [g[1] for g in got] == [6.0, 6.0, 0.0, 0.0]
    assert got[0][2] == 0.0 and [g[3] for g in got] == [3.0, 3.0, None, 3.0]


def test_bad_date_and_formats(spark):
    df = spark.createDataFrame([("31/02/2016", 3.0), ("3/12/2016", 2.5), (None, None)], "d string, x double")
    parts = numeric.date_parts("d")
    got = values(df, parts["year"], parts["weekday"], strings.show_number("x"))
    assert got == [(None, None, "3"), (2016, 5, "2.50"), (None, None, "unknown")]


def test_template_drops_missing_clauses(spark):
    df = spark.createDataFrame([("x", 2), (None, None)], "a string, n int")
    t = Template([Section([phrase("a ", F.col("a")), phrase("n ", F.col("n").cast("string"), when=F.col("n") > 1)])], empty="nothing")
    assert [r[0] for r in values(df, t.compile())] == ["a x, n 2.", "nothing"]
    assert [r[0] for r in values(df, append(F.lit("base"), phrase("+", F.col("a"))))] == ["base +x", "base"]


def test_neighbour_phrases(spark):
    df = spark.createDataFrame([(110.0, 100.0), (105.0, 100.0), (90.0, 100.0), (5.0, 0.0), (5.0, -1.0), (None, 1.0)], "o double, m double")
    o, m = F.col("o"), F.col("m")
    assert [r[0] for r in values(df, relative_phrase(o, m, "up", "down", "same"))] == ["up", "same", "down", "same", "same", None]
    incl = [r[0] for r in values(df, relative_phrase(o, m, "up", "down", "same", 0.10, inclusive=True))]
    assert incl[3] == "same" and incl[2] == "down" and incl[1] == "same"
    delta = [r[0] for r in values(df.limit(2), delta_phrase(o, m, "area", "more", "less"))]
    assert delta == ["area 10 more", "area 5 more"]
