"""Queries: scans, cleaning, splits, samples, imputation, scalar features."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from cadastre.functions import buckets, numeric, strings
from cadastre.operators import impute, rows, split
from cadastre.plans.registry import query, r6, rounded, s6
from cadastre.plans.views import LISTING, NUMBERS, PARTS, TEXTS, listing, medians_sql, parts, split_sql, stored, unit_sql
from cadastre.session import checkpoint_dir
from cadastre.sources import tabular

BASE = ", ".join(["row_id", *TEXTS, *NUMBERS, "price", "split"])


@query("listing_scan", f"WITH {LISTING} SELECT {BASE} FROM listing")
def listing_scan(spark, sf):
    return listing(spark, sf).select("row_id", *TEXTS, *NUMBERS, "price", "split")


def _scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "cadastre", f"{name}-{uuid.uuid4().hex}")


@query("attribute_relation_roundtrip", "SELECT p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def attribute_relation_roundtrip(spark, sf):
    path = _scratch(spark, "relation")
    part = tabular.read_table(spark, sf, "part").select(
        "p_partkey", "p_name", "p_brand", F.col("p_size").cast("bigint").alias("p_size"), "p_retailprice"
    )
    tabular.write_attribute_relation(part, path, "part")
    return tabular.read_attribute_relation(spark, path)


@query("csv_roundtrip", f"WITH {LISTING} SELECT row_id, segment, n_lines, price, split FROM listing")
def csv_roundtrip(spark, sf):
    rows_ = listing(spark, sf).select("row_id", "segment", "n_lines", "price", "split")
    path = tabular.write_table(rows_, _scratch(spark, "csv"), "csv")
    return tabular.read_csv(spark, path, "row_id bigint, segment string, n_lines double, price double, split string")


@query("partitioned_sink", f"WITH {LISTING} SELECT row_id, split, price FROM listing WHERE split = 'test'")
def partitioned_sink(spark, sf):
    path = tabular.write_table(listing(spark, sf).select("row_id", "price", "split"), _scratch(spark, "sink"), partition_by=["split"])
    return spark.read.parquet(path).filter("split = 'test'").select("row_id", "split", "price")


@query("training_matrix", f"WITH {LISTING} SELECT n_lines, sum_qty, acctbal, {s6('ln(1 + greatest(price, 0))', 'target')} FROM listing")
def training_matrix(spark, sf):
    df = listing(spark, sf).withColumn("label", r6(numeric.log_floor("price")))
    return tabular.training_matrix(df, ["n_lines", "sum_qty", "acctbal"], "label")


@query("dedup_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem")
def dedup_rows(spark, sf):
    lines = tabular.read_table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return rows.dedup(lines)


@query("dedup_report", """
SELECT CAST(count(*) AS BIGINT) AS rows_before, CAST(count(DISTINCT text) AS BIGINT) AS rows_after,
       CAST(count(*) - count(DISTINCT text) AS BIGINT) AS removed FROM documents""")
def dedup_report(spark, sf):
    texts = tabular.read_table(spark, sf, "documents").select("text")
    return rows.dedup_report(texts, rows.dedup(texts))


@query("null_profile", f"WITH {LISTING} SELECT split, CAST(count(*) AS BIGINT) AS n_rows, "
       + ", ".join(f"CAST(count(*) - count({c}) AS BIGINT) AS null_{c}" for c in NUMBERS) + " FROM listing GROUP BY split")
def null_profile(spark, sf):
    return rows.null_profile(listing(spark, sf), NUMBERS)


TOKEN = "CASE WHEN row_id % 7 = 0 THEN ' - ' WHEN row_id % 11 = 0 THEN 'None' WHEN row_id % 13 = 0 THEN ' null' ELSE segment END"


@query("null_tokens", f"""WITH {LISTING}, raw AS (SELECT row_id, trim({TOKEN}) AS t FROM listing),
clean AS (SELECT row_id, CASE WHEN t NOT IN ('-', '', 'nan', 'None', 'null', 'NULL') THEN t END AS t FROM raw)
SELECT row_id, CAST(t IS NULL AS INTEGER) AS segment_missing, coalesce(t, '0') AS segment FROM clean""")
def null_tokens(spark, sf):
    raw = listing(spark, sf).select("row_id", F.expr(TOKEN).alias("segment"))
    clean = raw.withColumn("segment", strings.null_tokens("segment"))
    return clean.select(
        "row_id", strings.missing_flag("segment").alias("segment_missing"), F.coalesce("segment", F.lit("0")).alias("segment")
    )


@query("title_case", f"""WITH {PARTS} SELECT row_id,
array_to_string(list_transform(string_split(trim(upper(name)), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM parts""")
def title_case(spark, sf):
    return parts(spark, sf).select("row_id", strings.title_case(F.upper("name")).alias("name"))


@query("column_keep", f"""WITH {LISTING} SELECT row_id, gross, acctbal FROM listing""")
def column_keep(spark, sf):
    df = listing(spark, sf).withColumn("mostly_empty", F.when(F.col("row_id") % 3 == 0, F.col("gross")))
    kept = rows.keep_filled(df, ["gross", "mostly_empty", "acctbal"])
    return rows.drop_present(kept, [*TEXTS, "order_date", "n_lines", "sum_qty", "avg_disc", "sum_tax", "price", "split"])


@query("roles_and_leakage", f"""WITH {LISTING} SELECT row_id, coalesce(n_lines, 0) AS n_lines, coalesce(sum_qty, 0) AS sum_qty,
coalesce(avg_disc, 0) AS avg_disc, acctbal, CAST(0 AS INTEGER) AS absent FROM listing""")
def roles_and_leakage(spark, sf):
    """Numeric roles without key, target and leaking columns, aligned to a training schema."""
    df = rows.drop_present(listing(spark, sf), ["price", "gross", "sum_tax", "not_there"])
    numbers = rows.pick_number_columns(df, skip=["row_id"])
    return rows.align(df, [*numbers, "absent"], keys=["row_id"])


@query("valid_pairs", f"""WITH {LISTING}, p AS (SELECT row_id, split, gross AS truth,
CASE WHEN row_id % 5 = 0 THEN -2 ELSE gross * (0.9 + 0.2 * {unit_sql('row_id', '7')}) END AS pred FROM listing)
SELECT row_id, split, truth, {s6('pred', 'pred')} FROM p WHERE truth IS NOT NULL AND pred IS NOT NULL AND truth >= 0 AND pred >= -1""")
def valid_pairs(spark, sf):
    noisy = F.col("gross") * (F.lit(0.9) + F.lit(0.2) * split.hash_unit("row_id", 7))
    df = listing(spark, sf).select("row_id", "split", F.col("gross").alias("truth"),
                                   F.when(F.col("row_id") % 5 == 0, -2.0).otherwise(noisy).alias("pred"))
    return rounded(rows.valid_pairs(df, "truth", "pred"), "pred")


@query("conditional_replace", f"""WITH {LISTING} SELECT row_id,
CASE WHEN sum_qty IS NULL THEN -1 ELSE sum_qty END AS sum_qty,
CASE WHEN acctbal IS NOT NULL THEN greatest(0, least(5000, acctbal)) END AS acctbal FROM listing""")
def conditional_replace(spark, sf):
    df = rows.replace_where(listing(spark, sf), "sum_qty", F.col("sum_qty").isNull(), -1.0)
    return df.select("row_id", "sum_qty", numeric.clip_range("acctbal", 0, 5000).alias("acctbal"))


@query("gather_rows", f"""WITH {LISTING} SELECT l.row_id, l.segment, l.price FROM listing l JOIN
(SELECT l_orderkey AS row_id FROM lineitem WHERE l_quantity >= 49) k ON l.row_id = k.row_id""")
def gather_rows(spark, sf):
    keys = tabular.read_table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("row_id"))
    return rows.gather(listing(spark, sf).select("row_id", "segment", "price"), keys, "row_id")


# ---- splits and samples --------------------------------------------------------------------

SEEDS = (0, 1, 2)


@query("hash_split", f"""WITH {LISTING}, s AS (SELECT row_id, seed, {split_sql('row_id', "' || CAST(seed AS VARCHAR) || '")} AS split
FROM listing, (SELECT unnest([0, 1, 2]) AS seed)) SELECT seed, split, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(row_id) AS BIGINT) AS key_sum
FROM s GROUP BY seed, split""")
def hash_split(spark, sf):
    df = split.over_seeds(listing(spark, sf).select("row_id"), "row_id", SEEDS)
    return df.groupBy("seed", "split").agg(F.count("*").alias("n_rows"), F.sum("row_id").alias("key_sum"))


@query("exact_split", """
WITH h AS (SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR))) AS r, count(*) OVER () AS n FROM orders),
c AS (SELECT row_id, r, n, ceil(0.3 * n) AS held FROM h)
SELECT row_id, CASE WHEN r <= n - held THEN 'train' WHEN r <= n - ceil(held * CAST(2 AS DOUBLE) / 3) THEN 'val' ELSE 'test' END AS split FROM c""")
def exact_split(spark, sf):
    keys = tabular.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    return split.exact_split(keys, "row_id")


@query("exact_sample", """
SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR))) <=
(SELECT CAST(floor(count(*) * 0.35) AS BIGINT) FROM orders)""")
def exact_sample(spark, sf):
    return split.exact_sample(tabular.read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.35)


GRID_SQL = """(SELECT p.v AS pca_dim, k.v AS rag_k, r.v AS rag_pca_dim FROM (SELECT unnest([12, 16]) AS v) p,
(SELECT unnest([4, 8]) AS v) k, (SELECT unnest([16, 20]) AS v) r)"""


@query("sweep_grid", f"""WITH {LISTING} SELECT split, pca_dim, rag_k, rag_pca_dim, CAST(count(*) AS BIGINT) AS n_rows
FROM listing, {GRID_SQL} GROUP BY ALL""")
def sweep_grid(spark, sf):
    """Row counts per split for every configuration of the sweep."""
    counts = listing(spark, sf).groupBy("split").agg(F.count("*").alias("n_rows"))
    for name, values in {"pca_dim": [12, 16], "rag_k": [4, 8], "rag_pca_dim": [16, 20]}.items():
        counts = counts.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return counts.select("split", "pca_dim", "rag_k", "rag_pca_dim", "n_rows")


# ---- imputation ------------------------------------------------------------------------------


@query("impute_median", f"WITH {LISTING}, {medians_sql(NUMBERS)} SELECT row_id, "
       + ", ".join(f"coalesce(l.{c}, m.{c}) AS {c}" for c in NUMBERS) + " FROM listing l, med m")
def impute_median(spark, sf):
    df = stored(listing(spark, sf), "row_id", "split", *NUMBERS)
    return impute.fit_median(df, NUMBERS).apply(df).select("row_id", *NUMBERS)


HOLES = "CASE WHEN row_id % 6 = 0 THEN NULL ELSE {} END"


@query("impute_mode", f"""WITH {LISTING}, h AS (SELECT row_id, split, {HOLES.format('segment')} AS segment, {HOLES.format('priority')} AS priority FROM listing),
m1 AS (SELECT segment AS v FROM h WHERE split = 'train' AND segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT row_id, coalesce(segment, (SELECT v FROM m1)) AS segment, coalesce(priority, 'None') AS priority FROM h""")
def impute_mode(spark, sf):
    df = listing(spark, sf).select(
        "row_id", "split", F.expr(HOLES.format("segment")).alias("segment"), F.expr(HOLES.format("priority")).alias("priority")
    )
    chain = impute.Chain([impute.fit_mode(df, ["segment"]), impute.fit_constant(df, ["priority"])])
    return chain.apply(df).select("row_id", "segment", "priority")


@query("whole_table_clean", f"""WITH {LISTING}, med AS (SELECT quantile_cont(gross, 0.5) AS gross, quantile_cont(sum_qty, 0.5) AS sum_qty FROM listing)
SELECT row_id, coalesce(l.gross, m.gross) AS gross, coalesce(l.sum_qty, m.sum_qty) AS sum_qty,
coalesce(CASE WHEN l.gross IS NULL THEN NULL ELSE segment END, 'None') AS segment FROM listing l, med m""")
def whole_table_clean(spark, sf):
    df = listing(spark, sf).select("row_id", "gross", "sum_qty", F.when(F.col("gross").isNotNull(), F.col("segment")).alias("segment"))
    return impute.fit_clean(df, ["gross", "sum_qty"], ["segment"], fit_on=None).apply(df)


@query("zero_fill", f"""WITH {LISTING} SELECT row_id, {s6('coalesce(ln(nullif(greatest(acctbal, 0), 0)), 0)', 'log_balance')},
coalesce(gross, 0) AS gross FROM listing""")
def zero_fill(spark, sf):
    df = listing(spark, sf).select(
        "row_id", F.when(F.col("acctbal") > 0, F.ln("acctbal")).otherwise(F.lit(float("-inf"))).alias("log_balance"), "gross"
    )
    return rounded(impute.zero_fill(df, ["log_balance", "gross"]), "log_balance")


@query("tree_impute")
def tree_impute(spark, sf):
    df = listing(spark, sf).select("row_id", "split", *NUMBERS)
    return impute.fit_tree(df, NUMBERS).apply(df)


# ---- scalar features -------------------------------------------------------------------------

RATIOS = {"qty_per_line": ("sum_qty", "n_lines"), "gross_per_qty": ("gross", "sum_qty"),
          "tax_per_line": ("sum_tax", "n_lines"), "qty_per_disc": ("sum_qty", "avg_disc"), "gross_per_balance": ("gross", "acctbal")}


@query("ratio_features", f"""WITH {LISTING}, r AS (SELECT row_id, split, """
       + ", ".join(f"{a} / nullif({b}, 0) AS {n}" for n, (a, b) in RATIOS.items())
       + f" FROM listing), {medians_sql(list(RATIOS), source='r')} SELECT row_id, "
       + ", ".join(f"coalesce(r.{n}, m.{n}) AS {n}" for n in RATIOS) + " FROM r, med m")
def ratio_features(spark, sf):
    df = listing(spark, sf).withColumns({n: numeric.safe_ratio(a, b) for n, (a, b) in RATIOS.items()})
    df = stored(df, "row_id", "split", *RATIOS)
    return impute.fit_median(df, list(RATIOS)).apply(df).drop("split")


@query("arith_flags", f"""WITH {LISTING} SELECT row_id, {s6('sum_qty + 0.5 * n_lines + sum_tax', 'load')},
{s6('gross * n_lines', 'gross_lines')}, CAST(coalesce(acctbal > 0, FALSE) AS INTEGER) AS in_credit,
CAST(coalesce(priority <> '1-URGENT', FALSE) AS INTEGER) AS not_urgent,
CAST(coalesce(n_lines <= 2, FALSE) AS INTEGER) AS small_order,
CASE WHEN n_lines IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), n_lines - 4) END AS extra_lines FROM listing""")
def arith_flags(spark, sf):
    return listing(spark, sf).select(
        "row_id",
        r6(numeric.weighted_sum({"sum_qty": 1, "n_lines": 0.5, "sum_tax": 1})).alias("load"),
        r6(F.col("gross") * F.col("n_lines")).alias("gross_lines"),
        numeric.flag(F.col("acctbal") > 0).alias("in_credit"),
        numeric.flag(F.col("priority") != "1-URGENT").alias("not_urgent"),
        numeric.flag(F.col("n_lines") <= 2).alias("small_order"),
        numeric.bounded_difference("n_lines", F.lit(4.0)).alias("extra_lines"),
    )


# Anchor points (latitude, longitude) on the probe plane.
ANCHORS = {"north": (37.7749, -122.4194), "south": (32.7157, -117.1611)}


@query("anchor_distance", f"""WITH {PARTS}, g AS (SELECT row_id, 30 + size / 4 AS lat, -124 + (retail - 900) / 10 AS lon FROM parts)
SELECT row_id, """ + ", ".join(
    s6(f"sqrt((lat - ({a})) * (lat - ({a})) + (lon - ({b})) * (lon - ({b}))) * 111", f"distance_to_{n}") for n, (a, b) in ANCHORS.items())
       + f""", {s6('abs(lon - (-124 + 0.7 * (42 - greatest(32, least(42, lat)))))', 'distance_to_line')},
{s6('lat + lon', 'lat_lon_sum')}, {s6('lat - lon', 'lat_lon_diff')} FROM g""")
def anchor_distance(spark, sf):
    g = parts(spark, sf).select("row_id", (F.lit(30.0) + F.col("size") / 4).alias("lat"), (F.lit(-124.0) + (F.col("retail") - 900) / 10).alias("lon"))
    return g.select(
        "row_id",
        *[r6(numeric.planar_distance("lat", "lon", at)).alias(f"distance_to_{n}") for n, at in ANCHORS.items()],
        r6(numeric.line_distance("lat", "lon")).alias("distance_to_line"),
        r6(F.col("lat") + F.col("lon")).alias("lat_lon_sum"),
        r6(F.col("lat") - F.col("lon")).alias("lat_lon_diff"),
    )


@query("log_target", f"""WITH {LISTING}, t AS (SELECT row_id, price, gross, price / nullif(n_lines * sum_qty, 0) AS unit, n_lines * sum_qty AS size_score FROM listing)
SELECT row_id, {s6('ln(1 + greatest(price, 0))', 'log_price')}, {s6('CASE WHEN unit IS NOT NULL THEN ln(1 + greatest(unit, 0)) END', 'log_unit')},
{s6('CASE WHEN unit IS NOT NULL THEN (exp(least(20, greatest(-20, ln(1 + greatest(unit, 0))))) - 1) * size_score END', 'price_back', 3)} FROM t""")
def log_target(spark, sf):
    df = listing(spark, sf).withColumn("size_score", F.col("n_lines") * F.col("sum_qty"))
    label = numeric.log_floor(numeric.safe_ratio("price", "size_score"))
    return df.select(
        "row_id", r6(numeric.log_floor("price")).alias("log_price"), r6(label).alias("log_unit"),
        r6(numeric.unlog(label) * F.col("size_score"), 3).alias("price_back"),
    )


DATE_TEXT = ("concat(cast(day(order_date) + CASE WHEN row_id % 9 = 0 THEN 40 ELSE 0 END AS {s}), '/', "
             "cast(month(order_date) AS {s}), '/', cast(year(order_date) AS {s}))")


@query("date_parts", f"""WITH {LISTING}, d AS (SELECT row_id, try_strptime({DATE_TEXT.format(s='VARCHAR')}, '%d/%m/%Y') AS d FROM listing)
SELECT row_id, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day,
CAST(isodow(d) - 1 AS INTEGER) AS weekday FROM d""")
def date_parts(spark, sf):
    df = listing(spark, sf).select("row_id", F.expr(DATE_TEXT.format(s="string")).alias("sold"))
    return df.select("row_id", *[e.alias(n) for n, e in numeric.date_parts("sold").items()])


# Probe bands.
LEFT_BANDS = [(2, "single"), (5, "few"), (8, "several")]
RIGHT_BANDS = [(50, "light"), (120, "medium"), (1e18, "heavy")]
MIXED_BANDS = [(0.04, "low discount"), (0.06, "balanced discount")]


@query("buckets", f"""WITH {LISTING} SELECT row_id,
CASE WHEN n_lines IS NULL THEN 'unknown' WHEN n_lines < 2 THEN 'single' WHEN n_lines < 5 THEN 'few' WHEN n_lines < 8 THEN 'several' ELSE 'many' END AS lines_band,
CASE WHEN sum_qty IS NULL THEN 'unknown' WHEN sum_qty <= 50 THEN 'light' WHEN sum_qty <= 120 THEN 'medium' ELSE 'heavy' END AS qty_band,
CASE WHEN avg_disc IS NULL THEN 'unknown' WHEN avg_disc < 0.04 THEN 'low discount' WHEN avg_disc <= 0.06 THEN 'balanced discount' ELSE 'high discount' END AS disc_band,
CASE WHEN acctbal >= 5000 THEN 'rich' WHEN acctbal >= 2000 AND sum_qty <= 100 THEN 'solid, light' WHEN acctbal >= 2000 THEN 'solid' ELSE 'thin' END AS area
FROM listing""")
def bucket_bands(spark, sf):
    return listing(spark, sf).select(
        "row_id",
        buckets.bucket("n_lines", LEFT_BANDS, "many").alias("lines_band"),
        buckets.bucket("sum_qty", RIGHT_BANDS, closed="right").alias("qty_band"),
        buckets.bucket("avg_disc", MIXED_BANDS, "high discount", closed="mixed").alias("disc_band"),
        buckets.cascade(
            [(F.col("acctbal") >= 5000, "rich"), ((F.col("acctbal") >= 2000) & (F.col("sum_qty") <= 100), "solid, light"),
             (F.col("acctbal") >= 2000, "solid")], "thin").alias("area"),
    )


PRIORITY_WORDS = {"1-URGENT": "Excellent", "2-HIGH": "Good", "3-MEDIUM": "Average"}


@query("lookup_tags", f"""WITH {LISTING}, {PARTS}, w AS (SELECT row_id,
CASE priority WHEN '1-URGENT' THEN 'Excellent' WHEN '2-HIGH' THEN 'Good' WHEN '3-MEDIUM' THEN 'Average' ELSE 'Fair' END AS priority_word,
concat_ws(' ', CASE WHEN n_lines >= 6 THEN 'large_order' END, CASE WHEN acctbal < 0 THEN 'in_debt' END, CASE WHEN avg_disc > 0.07 THEN 'bargain' END) AS t,
CASE WHEN gross IS NULL THEN 'unknown' WHEN gross = floor(gross) THEN CAST(CAST(gross AS BIGINT) AS VARCHAR) ELSE printf('%.2f', gross) END AS shown
FROM listing) SELECT row_id, priority_word, CASE WHEN t = '' THEN 'neutral_signals' ELSE t END AS tags, shown FROM w""")
def lookup_tags(spark, sf):
    return listing(spark, sf).select(
        "row_id",
        strings.lookup("priority", PRIORITY_WORDS, "Fair").alias("priority_word"),
        strings.tags([(F.col("n_lines") >= 6, "large_order"), (F.col("acctbal") < 0, "in_debt"), (F.col("avg_disc") > 0.07, "bargain")]).alias("tags"),
        strings.show_number("gross").alias("shown"),
    )


@query("substring_class", f"""WITH {PARTS} SELECT row_id, CASE WHEN contains(name, 'ring') OR contains(name, 'bolt') THEN 'fastener'
WHEN contains(name, 'widget') THEN 'widget' WHEN contains(name, 'red') THEN 'red thing' ELSE 'other' END AS class FROM parts""")
def substring_class(spark, sf):
    rules = [(("ring", "bolt"), "fastener"), (("widget",), "widget"), (("red",), "red thing")]
    return parts(spark, sf).select("row_id", strings.contains_rules("name", rules, "other").alias("class"))


@query("number_coercion", f"""WITH {LISTING}, t AS (SELECT row_id, TRY_CAST(CASE WHEN row_id % 4 = 0 THEN 'Incluso' ELSE CAST(acctbal AS VARCHAR) END AS DOUBLE) AS v FROM listing)
SELECT row_id, CASE WHEN v IS NOT NULL THEN greatest(v, 0) END AS v FROM t""")
def number_coercion(spark, sf):
    text = F.when(F.col("row_id") % 4 == 0, "Incluso").otherwise(F.col("acctbal").cast("string"))
    return listing(spark, sf).select("row_id", numeric.coerce_number(text, floor=0).alias("v"))


@query("sanitize_text", r"""SELECT doc_id, md5(regexp_replace(text || chr(7) || chr(10) || chr(1), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS digest,
CAST(length(regexp_replace(text || chr(7) || chr(10) || chr(1), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS INTEGER) AS n FROM documents""")
def sanitize_text(spark, sf):
    noisy = F.concat(F.col("text"), F.lit("\x07\n\x01"))
    clean = strings.sanitize(noisy)
    return tabular.read_table(spark, sf, "documents").select("doc_id", F.md5(clean).alias("digest"), F.length(clean).alias("n"))


@query("signed_root", f"WITH {LISTING} SELECT row_id, {s6('sign(acctbal) * sqrt(abs(acctbal) + 1)', 'root')}, "
       f"{s6('greatest(-3, least(3, acctbal / 1000))', 'clipped')} FROM listing")
def signed_root(spark, sf):
    return listing(spark, sf).select(
        "row_id", r6(numeric.signed_root("acctbal")).alias("root"), r6(numeric.clip(F.col("acctbal") / 1000, 3)).alias("clipped")
    )
