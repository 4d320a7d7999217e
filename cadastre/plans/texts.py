"""Queries: row-to-text templates, neighbour phrases, stored vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.functions import buckets, strings
from cadastre.functions.text import Section, Template, append, delta_phrase, phrase, relative_phrase
from cadastre.operators import neighbors
from cadastre.plans.cleaning import PRIORITY_WORDS
from cadastre.plans.registry import query, r6, s6
from cadastre.plans.search import K, NEAR_SQL, _edges, mode_cte
from cadastre.plans.views import LISTING, listing, parts
from cadastre.sources import vector_store
from cadastre.sources.tabular import read_table

LINE_BANDS = [(2, "compact"), (4, "cozy"), (6, "spacious")]
LINES_WORD = "CASE WHEN n_lines IS NULL THEN 'unknown size' WHEN n_lines < 2 THEN 'compact' WHEN n_lines < 4 THEN 'cozy' WHEN n_lines < 6 THEN 'spacious' ELSE 'large' END"
WORD = "CASE priority WHEN '1-URGENT' THEN 'Excellent' WHEN '2-HIGH' THEN 'Good' WHEN '3-MEDIUM' THEN 'Average' ELSE 'Fair' END"


def _int(c: str) -> str:
    return f"CAST(CAST(trunc({c}) AS BIGINT) AS VARCHAR)"


@query("text_structured", f"""WITH {LISTING} SELECT row_id, concat_ws('. ',
nullif(concat_ws(', ', 'nation ' || nation, 'region ' || region), ''),
nullif(concat_ws(', ', {_int('n_lines')} || ' lines, ' || {_int('sum_qty')} || ' units', {_int('gross')} || ' gross (' || {LINES_WORD} || ')'), ''),
nullif(concat_ws(', ', CASE WHEN acctbal > 0 THEN {_int('acctbal')} || ' in credit' END, 'priority ' || {WORD}), '')) || '.' AS text FROM listing""")
def text_structured(spark, sf):
    template = Template([
        Section([phrase("nation ", F.col("nation")), phrase("region ", F.col("region"))]),
        Section([
            phrase(strings.show_int("n_lines"), " lines, ", strings.show_int("sum_qty"), " units"),
            phrase(strings.show_int("gross"), " gross (", buckets.bucket("n_lines", LINE_BANDS, "large", missing="unknown size"), ")"),
        ]),
        Section([
            phrase(strings.show_int("acctbal"), " in credit", when=F.col("acctbal") > 0),
            phrase("priority ", strings.lookup("priority", PRIORITY_WORDS, "Fair")),
        ]),
    ])
    return listing(spark, sf).select("row_id", template.compile().alias("text"))


@query("text_narrative", f"""WITH {LISTING} SELECT row_id, coalesce(nullif(concat_ws(' ',
'This order is from ' || nation || ', ' || CASE WHEN status = 'F' THEN 'already filled' ELSE 'still open' END || '.',
'It holds ' || {_int('n_lines')} || ' lines, which ' || CASE WHEN n_lines >= 6 THEN 'drives the value' WHEN n_lines >= 3 THEN 'supports the value' ELSE 'limits the value' END || '.',
'Extras: ' || nullif(concat_ws(', ', CASE WHEN avg_disc > 0.05 THEN 'discount' END, CASE WHEN acctbal > 8000 THEN 'strong balance' END), '') || '.'), ''), 'Nothing known.') AS text FROM listing""")
def text_narrative(spark, sf):
    grade = buckets.cascade([(F.col("n_lines") >= 6, "drives the value"), (F.col("n_lines") >= 3, "supports the value")], "limits the value")
    template = Template(
        [
            phrase("This order is from ", F.col("nation"), ", ", buckets.cascade([(F.col("status") == "F", "already filled")], "still open"), "."),
            phrase("It holds ", strings.show_int("n_lines"), " lines, which ", grade, "."),
            Section([phrase("discount", when=F.col("avg_disc") > 0.05), phrase("strong balance", when=F.col("acctbal") > 8000)], lead="Extras: ", tail="."),
        ],
        sep=" ", end="", empty="Nothing known.",
    )
    return listing(spark, sf).select("row_id", template.compile().alias("text"))


@query("text_compact", f"""WITH {LISTING} SELECT row_id, concat_ws('. ', 'Nation ' || nation, 'Lines ' || {_int('n_lines')}, 'Units ' || {_int('sum_qty')},
'Segment ' || segment) || '.' AS text FROM listing""")
def text_compact(spark, sf):
    template = Template([
        phrase("Nation ", F.col("nation")), phrase("Lines ", strings.show_int("n_lines")),
        phrase("Units ", strings.show_int("sum_qty")), phrase("Segment ", F.col("segment")),
    ])
    return listing(spark, sf).select("row_id", template.compile().alias("text"))


BAND = "CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} <= {a} THEN '{x}' WHEN {c} <= {b} THEN '{y}' ELSE '{z}' END"
QTY = BAND.format(c="sum_qty", a=50, b=120, x="light", y="medium", z="heavy")
BAL = BAND.format(c="acctbal", a=0, b=5000, x="in_debt", y="solid", z="rich")


@query("text_bands", f"""WITH {LISTING}, t AS (SELECT row_id, concat_ws(' ', CASE WHEN n_lines >= 6 THEN 'large_order' END, CASE WHEN acctbal < 0 THEN 'in_debt' END) AS s, {QTY} AS q, {BAL} AS b FROM listing)
SELECT row_id, 'order profile: quantity_band=' || q || ', balance_band=' || b || '. signals: ' || CASE WHEN s = '' THEN 'neutral_signals' ELSE s END || '.' AS text FROM t""")
def text_bands(spark, sf):
    signals = strings.tags([(F.col("n_lines") >= 6, "large_order"), (F.col("acctbal") < 0, "in_debt")])
    quantity = buckets.bucket("sum_qty", [(50, "light"), (120, "medium"), (1e18, "heavy")], closed="right")
    balance = buckets.bucket("acctbal", [(0, "in_debt"), (5000, "solid"), (1e18, "rich")], closed="right")
    text = phrase("order profile: quantity_band=", quantity, ", balance_band=", balance, ". signals: ", signals, ".")
    return listing(spark, sf).select("row_id", text.alias("text"))


MEANS_SQL = f"""{NEAR_SQL}, {mode_cte('kind')}, means AS (SELECT query_id, round(avg(size), 6) AS size, round(avg(retail), 6) AS retail FROM near GROUP BY query_id),
j AS (SELECT p.row_id, p.size, p.retail, p.kind, m.size AS mean_size, m.retail AS mean_retail, k.kind AS mode_kind,
'part ' || p.name || '.' AS base FROM parts p LEFT JOIN means m ON p.row_id = m.query_id LEFT JOIN mode_kind k ON p.row_id = k.query_id)"""


def _with_means(spark, sf):
    df = parts(spark, sf)
    near = neighbors.neighbor_features(_edges(df), df, "row_id", ["size", "retail"], ["kind"]).withColumnRenamed("query_id", "row_id")
    near = near.withColumns({c: F.round(c, 6) for c in ("rag_mean_size", "rag_mean_retail")})
    return df.join(near, "row_id", "left").withColumn("base", phrase("part ", F.col("name"), "."))


@query("text_neighbors", f"""{MEANS_SQL} SELECT row_id, concat_ws(' ', base, 'Similar parts (avg): ' || nullif(concat_ws(', ',
'size ' || CAST(CAST(floor(mean_size) AS BIGINT) AS VARCHAR), 'retail ' || CAST(CAST(floor(mean_retail) AS BIGINT) AS VARCHAR), 'kind ' || mode_kind), '') || '. (based on k={K} nearest neighbors).') AS text FROM j""")
def text_neighbors(spark, sf):
    extra = Section([
        phrase("size ", strings.show_int("rag_mean_size")), phrase("retail ", strings.show_int("rag_mean_retail")),
        phrase("kind ", F.col("rag_mode_kind")),
    ], lead="Similar parts (avg): ", tail=f". (based on k={K} nearest neighbors).")
    return _with_means(spark, sf).select("row_id", append(F.col("base"), extra.compile()).alias("text"))


def _relative(own: str, mean: str, label: str) -> str:
    return (f"CASE WHEN {own} IS NULL OR {mean} IS NULL THEN NULL WHEN {mean} <= 0 THEN '{label} comparable to neighbors' "
            f"WHEN ({own} - {mean}) / {mean} > 0.05 THEN '{label} larger than neighbors' WHEN ({own} - {mean}) / {mean} < -0.05 THEN '{label} smaller than neighbors' "
            f"ELSE '{label} comparable to neighbors' END")


@query("text_compare", f"""{MEANS_SQL} SELECT row_id, concat_ws(' ', base, 'Compared to similar parts: ' || concat_ws(', ', {_relative('size', 'mean_size', 'size')},
{_relative('retail', 'mean_retail', 'retail')}, CASE WHEN mode_kind IS NOT NULL THEN 'kind consistent with majority of neighbors' END) || '.',
CASE WHEN mean_size = 0 THEN 'similar size' WHEN size / (mean_size + 1e-9) >= 1.08 THEN 'bigger' WHEN size / (mean_size + 1e-9) <= 0.92 THEN 'smaller' ELSE 'similar size' END) AS text FROM j""")
def text_compare(spark, sf):
    words = lambda n: (f"{n} larger than neighbors", f"{n} smaller than neighbors", f"{n} comparable to neighbors")
    extra = Section([
        relative_phrase(F.col("size"), F.col("rag_mean_size"), *words("size")),
        relative_phrase(F.col("retail"), F.col("rag_mean_retail"), *words("retail")),
        phrase("kind consistent with majority of neighbors", when=F.col("rag_mode_kind").isNotNull()),
    ], lead="Compared to similar parts: ", tail=".")
    ratio = relative_phrase(F.col("size"), F.col("rag_mean_size"), "bigger", "smaller", "similar size", 0.08, inclusive=True)
    return _with_means(spark, sf).select("row_id", append(append(F.col("base"), extra.compile()), ratio).alias("text"))


@query("text_delta", f"""{MEANS_SQL}, d AS (SELECT *, size - mean_size AS ds, retail - mean_retail AS dr FROM j)
SELECT row_id, concat_ws(' ', base, 'Relative to neighbors: ' || concat_ws(', ',
CASE WHEN ds IS NULL THEN NULL WHEN abs(ds) < 1e-6 THEN 'size on par with neighbor mean' ELSE 'size ' || CAST(CAST(floor(abs(ds)) AS BIGINT) AS VARCHAR) || CASE WHEN ds > 0 THEN ' units larger than neighbor mean' ELSE ' units smaller than neighbor mean' END END,
CASE WHEN dr IS NULL THEN NULL WHEN abs(dr) < 1e-6 THEN 'retail on par with neighbor mean' ELSE 'retail ' || CAST(CAST(floor(abs(dr)) AS BIGINT) AS VARCHAR) || CASE WHEN dr > 0 THEN ' higher than neighbor mean' ELSE ' lower than neighbor mean' END END) || '.') AS text FROM d""")
def text_delta(spark, sf):
    whole = lambda a, b: F.floor(F.abs(F.col(a) - F.col(b))).cast("bigint").cast("string")
    extra = Section([
        delta_phrase(F.col("size"), F.col("rag_mean_size"), "size", "units larger than neighbor mean", "units smaller than neighbor mean", whole("size", "rag_mean_size")),
        delta_phrase(F.col("retail"), F.col("rag_mean_retail"), "retail", "higher than neighbor mean", "lower than neighbor mean", whole("retail", "rag_mean_retail")),
    ], lead="Relative to neighbors: ", tail=".")
    return _with_means(spark, sf).select("row_id", append(F.col("base"), extra.compile()).alias("text"))


# ---- stored vectors ------------------------------------------------------------------------------

MODEL = "probe-model"
STORE_SQL = f"""keyed AS (SELECT doc_id, text, sha256('{MODEL}|' || text) AS key FROM documents),
store AS (SELECT key, arg_min(embedding, doc_id) AS vector FROM keyed JOIN embeddings ON doc_id = vec_id GROUP BY key)"""


def _store(spark, sf):
    """Vectors of the documents that have one, keyed by content; copies share the first."""
    docs = read_table(spark, sf, "documents").select("doc_id", vector_store.text_key("text", MODEL).alias("key"))
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(vectors, "doc_id").groupBy("key").agg(F.min_by("embedding", "doc_id").alias("vector"))


@query("vector_lookup", f"""WITH {STORE_SQL} SELECT doc_id, k.key, CAST(vector IS NOT NULL AS INTEGER) AS hit,
{s6('vector[1]', 'first')} FROM keyed k LEFT JOIN store USING (key)""")
def vector_lookup(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    found = vector_store.hits(docs, _store(spark, sf), MODEL)
    return found.select("doc_id", "key", F.col("vector").isNotNull().cast("int").alias("hit"), r6(F.col("vector")[0]).alias("first"))


@query("vector_misses", f"WITH {STORE_SQL} SELECT key, md5(min(text)) AS digest FROM keyed WHERE key NOT IN (SELECT key FROM store) GROUP BY key")
def vector_misses(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return vector_store.misses(docs, _store(spark, sf), MODEL).select("key", F.md5("text").alias("digest"))


@query("vector_complete", f"""WITH {STORE_SQL} SELECT doc_id, CASE WHEN vector IS NOT NULL THEN 'stored' WHEN length(trim(text)) > 0 THEN 'computed' ELSE 'zero' END AS vector_source,
CAST(64 AS INTEGER) AS dims FROM keyed k LEFT JOIN store USING (key)""")
def vector_complete(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    out = vector_store.complete(docs, _store(spark, sf), MODEL, 64)
    return out.select("doc_id", "vector_source", F.size("vector").alias("dims"))


@query("set_fingerprint", """SELECT CAST(count(*) AS BIGINT) AS n_texts, bit_xor(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || chr(0) || text), 1, 15) AS BIGINT)) AS digest FROM documents""")
def set_fingerprint(spark, sf):
    return vector_store.fingerprint(read_table(spark, sf, "documents"), "doc_id", "text")


@query("ordered_fingerprint", """WITH d AS (SELECT md5(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) || coalesce(length(text), -1) || ':' || coalesce(text, '')) AS m FROM documents)
SELECT CAST(count(*) AS BIGINT) AS n_texts, CAST(sum(CAST('0x' || substr(m, 1, 15) AS HUGEINT)) AS VARCHAR) AS high, CAST(sum(CAST('0x' || substr(m, 17, 15) AS HUGEINT)) AS VARCHAR) AS low FROM d""")
def ordered_fingerprint(spark, sf):
    return vector_store.ordered_fingerprint(read_table(spark, sf, "documents"), "doc_id", "text")
