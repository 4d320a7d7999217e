"""Queries: scalers, distribution transforms, encoders, column statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.operators import boxcox, encode, radix, rows, scale
from cadastre.plans.registry import query, r6, rounded, s6
from cadastre.plans.views import LISTING, NUMBERS, PARTS, listing, medians_sql, stored
from cadastre.sources import tabular

TRAINED = "(SELECT * FROM listing WHERE split = 'train')"


def fit_sql(columns, **aggs) -> str:
    picks = ", ".join(f"{f.format(c)} AS {n}_{c}" for c in columns for n, f in aggs.items())
    return f"fit AS (SELECT {picks} FROM {TRAINED})"


@query("column_statistics", f"WITH {LISTING}, t AS (SELECT * FROM listing WHERE split = 'train') "
       + " UNION ALL ".join(
           f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n_filled, min({c}) AS low, {s6(f'quantile_cont({c}, 0.25)', 'q25')},
{s6(f'quantile_cont({c}, 0.5)', 'mid')}, {s6(f'quantile_cont({c}, 0.75)', 'q75')}, max({c}) AS high,
{s6(f'(SELECT avg(pow({c} - (SELECT avg({c}) FROM t), 3)) / pow(var_pop({c}), 1.5) FROM t)', 'skew')} FROM t""" for c in NUMBERS))
def column_statistics(spark, sf):
    df = stored(listing(spark, sf), "split", *NUMBERS)
    return rounded(rows.column_statistics(df, NUMBERS), "q25", "mid", "q75", "skew")


@query("standardize", f"WITH {LISTING}, {fit_sql(NUMBERS, m='avg({})', s='stddev_pop({})')} SELECT row_id, "
       + ", ".join(s6(f"({c} - m_{c}) / coalesce(nullif(s_{c}, 0), 1)", c, 9) for c in NUMBERS) + " FROM listing, fit")
def standardize(spark, sf):
    df = stored(listing(spark, sf), "row_id", "split", *NUMBERS)
    return rounded(scale.fit_standard(df, NUMBERS).apply(df).select("row_id", *NUMBERS), *NUMBERS, digits=9)


@query("minmax", f"WITH {LISTING}, {fit_sql(NUMBERS, lo='min({})', hi='max({})')} SELECT row_id, "
       + ", ".join(s6(f"({c} - lo_{c}) / coalesce(nullif(hi_{c} - lo_{c}, 0), 1)", c, 9) for c in NUMBERS)
       + ", CAST(0 AS DOUBLE) AS constant FROM listing, fit")
def minmax(spark, sf):
    df = stored(listing(spark, sf), "row_id", "split", *NUMBERS).withColumn("constant", F.lit(7.0))
    columns = [*NUMBERS, "constant"]
    return rounded(scale.fit_minmax(df, columns).apply(df).select("row_id", *columns), *columns, digits=9)


@query("robust", f"WITH {LISTING}, {fit_sql(NUMBERS, q1='quantile_cont({}, 0.25)', q2='quantile_cont({}, 0.5)', q3='quantile_cont({}, 0.75)')} SELECT row_id, "
       + ", ".join(s6(f"({c} - q2_{c}) / coalesce(nullif(q3_{c} - q1_{c}, 0), 1)", c, 9) for c in NUMBERS) + " FROM listing, fit")
def robust(spark, sf):
    df = stored(listing(spark, sf), "row_id", "split", *NUMBERS)
    return rounded(scale.fit_robust(df, NUMBERS).apply(df).select("row_id", *NUMBERS), *NUMBERS, digits=9)


LAMBDAS = [-1.0, -0.5, 0.0, 0.25, 0.5, 1.0, 2.0]


def _llf(lam: float) -> str:
    moved = "ln(x)" if lam == 0 else f"(pow(x, {lam}) - 1) / {lam}"
    return f"SELECT CAST({lam} AS DOUBLE) AS lam, {s6(f'({lam} - 1) * sum(ln(x)) - count(*) / 2 * ln(var_pop({moved}))', 'llf', 4)} FROM x"


@query("boxcox_grid", "WITH low AS (SELECT min(c_acctbal) AS lo FROM customer), "
       "x AS (SELECT c_acctbal + CASE WHEN lo <= 0 THEN abs(lo) + 1 ELSE 0 END AS x FROM customer, low) " + " UNION ALL ".join(_llf(v) for v in LAMBDAS))
def boxcox_grid(spark, sf):
    table = boxcox.likelihood_table(tabular.read_table(spark, sf, "customer"), "c_acctbal", LAMBDAS)
    return rounded(table, "llf", digits=4)


@query("boxcox_roundtrip", f"WITH {LISTING} SELECT row_id, {s6('price', 'price', 2)} FROM listing")
def boxcox_roundtrip(spark, sf):
    df = listing(spark, sf).select("row_id", "split", "price")
    fitted = boxcox.fit_boxcox(df, "price")
    moved = fitted.apply(df, "moved")
    return moved.select("row_id", r6(fitted.undo("moved"), 2).alias("price"))


_ROUGH = "(SELECT unnest(range(-80, 81)) * 0.05 AS lam)"
_LLF = "(lam - 1) * sum(ln(x)) - count(*) / 2.0 * ln(var_pop(CASE WHEN abs(lam) < 1e-9 THEN ln(x) ELSE (pow(x, lam) - 1) / lam END))"


@query("boxcox_fit", f"""WITH {LISTING}, x AS (SELECT price / 1000 AS x FROM listing WHERE split = 'train'),
rough AS (SELECT lam, {_LLF} AS llf FROM x, {_ROUGH} GROUP BY lam), best AS (SELECT arg_max(lam, llf) AS peak FROM rough),
fine AS (SELECT lam, {_LLF} AS llf FROM x, (SELECT peak + d * 0.001 AS lam FROM best, (SELECT unnest(range(-60, 61)) AS d)) GROUP BY lam)
SELECT {s6('arg_max(lam, llf)', 'lam', 3)}, {s6('max(llf)', 'llf', 4)} FROM fine""")
def boxcox_fit(spark, sf):
    """The fitted lambda, to the third digit, and its likelihood."""
    df = listing(spark, sf).select("split", (F.col("price") / 1000).alias("unit"))
    lam = round(boxcox.fit_boxcox(df, "unit").lam, 3)
    return rounded(rounded(boxcox.likelihood_table(df.filter("split = 'train'"), "unit", [lam]), "llf", digits=4), "lam", digits=3)


@query("grouped_quantiles", """SELECT c_nationkey, c_mktsegment, "column", point, round(value, 6) + 0 AS value FROM (
SELECT c_nationkey, c_mktsegment, 'c_acctbal' AS "column", CAST(unnest([0.1, 0.5, 0.75]) AS DOUBLE) AS point, unnest(a) AS value FROM (SELECT c_nationkey, c_mktsegment, quantile_cont(c_acctbal, [0.1, 0.5, 0.75]) AS a FROM customer GROUP BY 1, 2)
UNION ALL SELECT c_nationkey, c_mktsegment, 'c_custkey', CAST(unnest([0.1, 0.5, 0.75]) AS DOUBLE), unnest(a) FROM (SELECT c_nationkey, c_mktsegment, quantile_cont(CAST(c_custkey AS DOUBLE), [0.1, 0.5, 0.75]) AS a FROM customer GROUP BY 1, 2))""")
def grouped_quantiles(spark, sf):
    customers = tabular.read_table(spark, sf, "customer")
    return rounded(radix.grouped_quantiles(customers, ["c_nationkey", "c_mktsegment"], ["c_acctbal", "c_custkey"], [0.1, 0.5, 0.75]), "value")


INVERSES = {"identity": (None, 0.0), "exponential": (0.0, 1.5), "root": (0.5, 3.0), "reciprocal": (-1.0, 0.0)}


@query("boxcox_inverse", f"""WITH y AS (SELECT c_custkey, c_acctbal / 10000 AS y FROM customer) SELECT c_custkey, y AS identity,
{s6('greatest(exp(y) - 1.5, 0)', 'exponential')}, {s6('greatest(pow(greatest(y * 0.5 + 1, 1e-12), 2) - 3, 0)', 'root')},
{s6('greatest(pow(greatest(y * -1 + 1, 1e-12), -1), 0)', 'reciprocal')} FROM y""")
def boxcox_inverse(spark, sf):
    y = tabular.read_table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 10000).alias("y"))
    return y.select("c_custkey", F.col("y").alias("identity"), *[
        r6(boxcox.inverse("y", lam, shift)).alias(n) for n, (lam, shift) in INVERSES.items() if lam is not None])


def winsor_sql(table: str, key: str, column: str) -> str:
    return f"""WITH m AS (SELECT avg({column}) AS mu, var_pop({column}) AS v FROM {table}),
s AS (SELECT avg(pow({column} - mu, 3)) / pow(max(v), 1.5) AS skew, quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1,
quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3 FROM {table}, m)
SELECT {key}, {s6(f'CASE WHEN abs(skew) > 1 THEN least(q3 + 3.5 * (q3 - q1), greatest(q1 - 3.5 * (q3 - q1), {column})) ELSE {column} END', column)} FROM {table}, s"""


@query("winsorize", winsor_sql("events", "event_id", "value"))
def winsorize(spark, sf):
    df = tabular.read_table(spark, sf, "events").select("event_id", "value")
    return rounded(scale.fit_winsor(df, ["value"], None).apply(df), "value")


@query("winsorize_lengths", winsor_sql("documents", "doc_id", "n_chars"))
def winsorize_lengths(spark, sf):
    df = tabular.read_table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return rounded(scale.fit_winsor(df, ["n_chars"], None).apply(df), "n_chars")


@query("l2_norm", f"""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)
SELECT vec_id, {s6('v[1] / (n + 1e-8)', 'first', 9)}, {s6('v[64] / (n + 1e-8)', 'last', 9)},
{s6('n / (n + 1e-8)', 'norm', 9)} FROM n""")
def l2_norm(spark, sf):
    v = tabular.read_table(spark, sf, "embeddings").select("vec_id", scale.l2_normalize("embedding").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    return v.select("vec_id", r6(F.col("v")[0], 9).alias("first"), r6(F.col("v")[63], 9).alias("last"), r6(norm, 9).alias("norm"))


# ---- encoders ----------------------------------------------------------------------------------

# an unseen category in validation and test rows, a missing one everywhere
HELD_SQL = f"""held AS (SELECT row_id, split, CASE WHEN row_id % 10 = 0 THEN NULL WHEN split <> 'train' AND row_id % 3 = 0 THEN 'BRAND NEW' ELSE segment END AS segment FROM listing)"""


def _held(spark, sf):
    value = F.when(F.col("row_id") % 10 == 0, None).when((F.col("split") != "train") & (F.col("row_id") % 3 == 0), "BRAND NEW")
    held = listing(spark, sf).select("row_id", "split", value.otherwise(F.col("segment")).alias("segment"))
    return stored(held, "row_id", "split", "segment")  # read by the fit and by its application


@query("onehot", f"""WITH {LISTING}, {HELD_SQL} SELECT row_id, {", ".join(
    f'''CAST(coalesce(segment, 'None') = '{v}' AS INTEGER) AS "segment_{v}"''' for v in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'None'))} FROM held""")
def onehot(spark, sf):
    df = _held(spark, sf)
    return encode.fit_onehot(df, "segment").apply(df).drop("split")


CODES_SQL = """classes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code, n FROM
(SELECT coalesce(segment, 'None') AS v, count(*) AS n FROM held WHERE split = 'train' GROUP BY 1))"""


def _ordinal_sql(default: str) -> str:
    return f"""WITH {LISTING}, {HELD_SQL}, {CODES_SQL} SELECT row_id, CAST(coalesce(code, {default}) AS INTEGER) AS code
FROM held LEFT JOIN classes ON coalesce(segment, 'None') = v"""


@query("ordinal_mode", _ordinal_sql("(SELECT code FROM classes ORDER BY n DESC, v LIMIT 1)"))
def ordinal_mode(spark, sf):
    df = _held(spark, sf)
    return encode.fit_ordinal(df, "segment", "mode").apply(df, "code").select("row_id", "code")


@query("ordinal_none", _ordinal_sql("(SELECT code FROM classes WHERE v = 'None')"))
def ordinal_none(spark, sf):
    df = _held(spark, sf)
    return encode.fit_ordinal(df, "segment", "none").apply(df, "code").select("row_id", "code")


@query("ordinal_minus1", f"""WITH {LISTING}, {HELD_SQL}, {CODES_SQL} SELECT row_id, CAST(coalesce(code, -1) AS INTEGER) AS code, v AS restored
FROM held LEFT JOIN classes ON coalesce(segment, 'None') = v""")
def ordinal_minus1(spark, sf):
    df = _held(spark, sf)
    fitted = encode.fit_ordinal(df, "segment", "minus_one")
    return fitted.restore(fitted.apply(df, "code"), "code", "restored").select("row_id", "code", "restored")


@query("ordinal_many", f"""WITH {LISTING}, {PARTS}, classes AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS code FROM
(SELECT DISTINCT c_name AS name FROM customer)) SELECT c_custkey, CAST(code AS INTEGER) AS code FROM customer JOIN classes ON c_name = name""")
def ordinal_many(spark, sf):
    """Too many categories for a literal map: numbered by ranges and joined."""
    df = tabular.read_table(spark, sf, "customer").select("c_custkey", "c_name")
    return encode.fit_ordinal(df, "c_name", "minus_one", None).apply(df, "code").select("c_custkey", "code")


@query("freq_encode", f"""WITH {LISTING}, {HELD_SQL}, shares AS (SELECT coalesce(segment, 'None') AS v, count(*) / CAST((SELECT count(*) FROM held WHERE split = 'train') AS DOUBLE) AS s
FROM held WHERE split = 'train' GROUP BY 1) SELECT row_id, {s6('coalesce(s, 0)', 'segment_freq', 9)} FROM held LEFT JOIN shares ON coalesce(segment, 'None') = v""")
def freq_encode(spark, sf):
    df = _held(spark, sf)
    return rounded(encode.fit_frequency(df, "segment").apply(df, "segment_freq").select("row_id", "segment_freq"), "segment_freq", digits=9)


@query("relative_frequency", f"""SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n,
{s6('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)', 'share', 9)} FROM orders GROUP BY o_orderpriority""")
def relative_frequency(spark, sf):
    return rounded(encode.relative_frequency(tabular.read_table(spark, sf, "orders"), "o_orderpriority"), "share", digits=9)


@query("unseen_categories", f"""WITH {LISTING}, {HELD_SQL} SELECT segment, CAST(count(*) AS BIGINT) AS n_rows FROM held
WHERE segment IS NOT NULL AND segment NOT IN (SELECT segment FROM held WHERE split = 'train' AND segment IS NOT NULL) GROUP BY segment""")
def unseen_categories(spark, sf):
    return rows.unseen_values(_held(spark, sf), "segment")


@query("schema_alignment", f"""WITH {LISTING}, {medians_sql(['gross'])} SELECT row_id, coalesce(gross, 0) AS gross,
CAST(0 AS INTEGER) AS added, coalesce(acctbal, 0) AS acctbal FROM listing""")
def schema_alignment(spark, sf):
    return rows.align(listing(spark, sf), ["gross", "added", "acctbal"], keys=["row_id"])
