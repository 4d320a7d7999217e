"""Base views over the given tables, in Spark and as SQL with the same definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastre.operators.split import hash_split
from cadastre.session import materialize
from cadastre.sources.tabular import read_table

NUMBERS = ["n_lines", "sum_qty", "avg_disc", "sum_tax", "gross", "acctbal"]
TEXTS = ["priority", "status", "segment", "nation", "region"]


def listing(spark: SparkSession, sf: str, seed: int = 42) -> DataFrame:
    """One row per order with customer, place and line item totals (NULL for an order without lines)."""
    orders = read_table(spark, sf, "orders")
    customer, nation, region = (read_table(spark, sf, t) for t in ("customer", "nation", "region"))
    lines = (
        read_table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.count("*").cast("double").alias("n_lines"),
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.round(F.sum("l_tax"), 2).alias("sum_tax"),
            F.round(F.sum("l_extendedprice"), 2).alias("gross"),
        )
    )
    joined = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .join(lines, "o_orderkey", "left")
    )
    out = joined.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
        "n_lines", "sum_qty", "avg_disc", "sum_tax", "gross",
        F.col("c_acctbal").alias("acctbal"),
    )
    return hash_split(out, "row_id", seed)


def parts(spark: SparkSession, sf: str, seed: int = 42) -> DataFrame:
    """One row per part with the mean line price, in whole cents, as target."""
    cents = F.round(F.sum("l_extendedprice") * 100)
    price = (
        read_table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg((F.floor(cents / F.count("*")) / 100).alias("price"))
    )
    out = read_table(spark, sf, "part").join(price, "p_partkey", "left").select(
        F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"), F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("retail"), "price",
    )
    return hash_split(out, "row_id", seed)


def stored(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, stored once, for queries that fit before they apply."""
    return materialize(df.select(*columns), "view")


def unit_sql(key: str, seed: str = "42") -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def split_sql(key: str, seed: str = "42") -> str:
    u = unit_sql(key, seed)
    return f"CASE WHEN {u} < 0.7 THEN 'train' WHEN {u} < 0.7 + 0.1 THEN 'val' ELSE 'test' END"


LISTING = f"""
lines AS (
  SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS sum_qty,
         round(avg(l_discount), 6) AS avg_disc, round(sum(l_tax), 2) AS sum_tax, round(sum(l_extendedprice), 2) AS gross
  FROM lineitem GROUP BY l_orderkey),
listing AS (
  SELECT o_orderkey AS row_id, o_orderdate AS order_date, o_totalprice AS price, o_orderpriority AS priority,
         o_orderstatus AS status, c_mktsegment AS segment, n_name AS nation, r_name AS region,
         n_lines, sum_qty, avg_disc, sum_tax, gross, c_acctbal AS acctbal, {split_sql('o_orderkey')} AS split
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey LEFT JOIN lines ON o_orderkey = l_orderkey)"""

PARTS = f"""
prices AS (SELECT l_partkey, floor(round(sum(l_extendedprice) * 100) / count(*)) / 100 AS price FROM lineitem GROUP BY l_partkey),
parts AS (
  SELECT p_partkey AS row_id, p_name AS name, p_brand AS brand, p_type AS kind, CAST(p_size AS DOUBLE) AS size,
         p_retailprice AS retail, price, {split_sql('p_partkey')} AS split
  FROM part LEFT JOIN prices ON p_partkey = l_partkey)"""


def medians_sql(columns: list[str], name: str = "med", source: str = "listing") -> str:
    picks = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in columns)
    return f"{name} AS (SELECT {picks} FROM {source} WHERE split = 'train')"
