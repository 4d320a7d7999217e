"""Quality rules with thresholds that follow the data: quantile sketches per language and source.

A sketch counts values by bucket; buckets are exact up to 63 and then 32 to an octave, so a value is
known to 1/32 of itself. Sketches merge by adding counts: source sketches add up to language sketches and
those to the sketch of all documents, which stand in for groups with few documents. A document's
measure fails beyond Q3 + 3 * max(Q3 - Q1, least spread) of its group; word length also fails below
Q1 - 3 * max(...). Thresholds are a small table that joins the documents' counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastre.llm.text import indexes, table, words
from cadastre.session import materialize

SYMBOLS = "#*$%&|<>"
#: measure: (SQL over the counts, least spread)
MEASURES = {
    "word_length": ("word_chars * 1000 div n_words", 500),
    "symbols": ("n_symbols * 1000000 div word_chars", 20_000),
    "dup_lines": ("n_dup_lines * 1000000 div n_lines", 100_000),
    "repeats": ("n_repeat_words * 1000000 div n_words", 50_000),
}
FENCE, LEAST_ROWS = 3, 50
FEW = 32  # repeated windows up to which a scan is cheaper than a sort; the result is the same


def _covered(at: Column) -> Column:
    """Words covered by the 3-word windows that start at the given ascending positions."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    return F.aggregate(at, start, step, lambda acc: acc["n"])


def count_words(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The kept columns and the counts of each text; a NULL text counts as an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\f\r", "") != "")
    df = docs.select(*keep, text.alias("text"), words(F.col(text_col)).alias("words"), lines.alias("lines"))
    w = F.col("words")
    df = df.withColumn("windows", F.transform(indexes(F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    df = df.withColumn("sorted", F.sort_array("windows"))
    df = df.withColumn("twice", F.array_distinct(F.filter("sorted", lambda x, i: (i > 0) & (F.get(F.col("sorted"), i - 1) == x))))
    many = F.size("twice") > FEW
    pairs = F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("pairs", F.when(many, pairs))
    p = F.col("pairs")
    alike = lambda e, k: (F.get(p, k - 1)["x"] == e["x"]) & (k > 0) | F.coalesce(F.get(p, k + 1)["x"] == e["x"], F.lit(False))
    by_sort = F.sort_array(F.transform(F.filter(p, alike), lambda e: e["i"]))
    by_scan = F.filter(indexes(F.size("windows")), lambda i: F.array_contains(F.col("twice"), F.get(F.col("windows"), i)))
    df = df.withColumn("at", F.when(many, by_sort).when(F.size("twice") > 0, by_scan).otherwise(F.array().cast("array<int>")))
    bare = lambda gone: F.length(F.translate("text", gone, ""))
    counts = {
        "n_words": F.size("words"), "word_chars": bare(" \t\n\x0b\f\r"), "n_symbols": F.length("text") - bare(SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")), "n_repeat_words": _covered(F.col("at")), "n_lines": F.size("lines"),
    }
    return df.select(*keep, *[c.cast("long").alias(k) for k, c in counts.items()])


def sketch(values: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, bucket, n): a mergeable quantile sketch of the non-negative column `x` for each group."""
    shift = "(length(bin(x)) - 6)"
    at = F.expr(f"case when x < 64 then x else {shift} * 32 + shiftright(x, {shift}) end").cast("long")
    return values.groupBy(*groups, "measure", at.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    return sketches.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, total, q1, q3) of each sketch; a bucket stands for its upper end. At most some hundred buckets a group and measure."""
    whole = Window.partitionBy(*groups, "measure")
    run = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketches.withColumns({"run": F.sum("n").over(run), "total": F.sum("n").over(whole)})
    edge = F.expr("case when bucket < 64 then bucket else shiftleft(bucket % 32 + 33, cast(bucket div 32 - 1 as int)) - 1 end")
    at = lambda k: F.min(F.when(F.col("run") * 4 >= F.col("total") * k, edge))
    return ranked.groupBy(*groups, "measure").agg(F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))


def adaptive_thresholds(counts: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per (language, source): low_* and high_* of every measure; NULL is a group of its own."""
    measured = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(sql).alias("x")) for m, (sql, _) in MEASURES.items()]))
    values = counts.filter("n_words > 0").select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), measured.alias("m")).select("lang", "source", "m.*")
    by_source = materialize(sketch(values, ["lang", "source"]), "sketches")
    by_lang = merge(by_source, ["lang"])
    fits = [quartiles(by_source, ["lang", "source"]), quartiles(by_lang, ["lang"]), quartiles(merge(by_lang, []), [])]
    own, lang, every = (f.select(*[c for c in f.columns if c in ("lang", "source", "measure")], F.struct("total", "q1", "q3").alias(k)) for f, k in zip(fits, ("own", "in_lang", "all")))
    joined = own.join(lang.withColumnRenamed("lang", "l").withColumnRenamed("measure", "m"), F.expr("lang <=> l and measure = m"), "left").drop("l", "m")
    joined = joined.join(every, "measure", "left")
    q = F.when(F.col("own.total") >= LEAST_ROWS, F.col("own")).when(F.col("in_lang.total") >= LEAST_ROWS, F.col("in_lang")).otherwise(F.col("all"))
    spread = F.greatest(F.col("q.q3") - F.col("q.q1"), F.create_map(*[F.lit(x) for m, (_, s) in MEASURES.items() for x in (m, s)])[F.col("measure")])
    fenced = joined.withColumn("q", q).select("lang", "source", "measure", (F.col("q.q1") - FENCE * spread).alias("low"), (F.col("q.q3") + FENCE * spread).alias("high"))
    at = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return fenced.groupBy("lang", "source").agg(at("word_length", "low").alias("low_word_length"), *[at(m, "high").alias(f"high_{m}") for m in MEASURES])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, counts, base_failed and kept.

    base_failed: under 50 words, or over half of them in repeated 3-word windows; such a text is never kept and takes
    no part in the thresholds. A NULL language or source is a group like any other; NULL and empty texts have
    no words and fail. Groups under 50 documents take their language's thresholds, else those of all documents.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    counts = count_words(picked, keep=("id", "lang", "source"))
    counts = materialize(counts.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")), "word-counts")
    limits = materialize(adaptive_thresholds(counts.filter("not base_failed")), "thresholds").withColumnsRenamed({"lang": "l", "source": "s"})
    within = F.expr(f"{MEASURES['word_length'][0]} >= low_word_length")
    for m, (sql, _) in MEASURES.items():
        within &= F.expr(f"{sql} <= high_{m}")
    judged = counts.join(limits, F.expr("lang <=> l and source <=> s"), "left")
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), False).otherwise(within).alias("kept")
    )


def op6_adaptive_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _fit(name: str, groups: str) -> str:
    keys = f"{groups}, " if groups else ""
    return f"""{name} AS (SELECT {keys}measure, max(total) AS total, min(CASE WHEN run * 4 >= total THEN edge END) AS q1, min(CASE WHEN run * 4 >= total * 3 THEN edge END) AS q3 FROM (
  SELECT *, CASE WHEN bucket < 64 THEN bucket ELSE ((bucket % 32 + 33) << (bucket // 32 - 1)::INT) - 1 END AS edge,
    sum(n) OVER (PARTITION BY {keys}measure ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY {keys}measure) AS total
  FROM (SELECT {keys}measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL)"""


SQL = f"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) > 2),
hits AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM windows),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM hits, range(3) t(o) WHERE c > 1 GROUP BY doc_id),
counts AS (
  SELECT s.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines FROM split s LEFT JOIN covered c USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {sql.replace('div', '//')} AS x FROM based WHERE NOT base_failed" for m, (sql, _) in MEASURES.items())}),
sketch AS (SELECT lang, source, measure, CASE WHEN x < 64 THEN x ELSE (length(bin(x)) - 6) * 32 + (x >> (length(bin(x)) - 6)) END AS bucket, count(*) AS n FROM v GROUP BY ALL),
{_fit("own", "lang, source")}, {_fit("in_lang", "lang")}, {_fit("every", "")},
q AS (
  SELECT o.lang, o.source, measure, CASE measure {" ".join(f"WHEN '{m}' THEN {s}" for m, (_, s) in MEASURES.items())} END AS least,
    CASE WHEN o.total >= {LEAST_ROWS} THEN o.q1 WHEN l.total >= {LEAST_ROWS} THEN l.q1 ELSE e.q1 END AS q1,
    CASE WHEN o.total >= {LEAST_ROWS} THEN o.q3 WHEN l.total >= {LEAST_ROWS} THEN l.q3 ELSE e.q3 END AS q3
  FROM own o JOIN every e USING (measure) JOIN in_lang l ON l.measure = o.measure AND l.lang IS NOT DISTINCT FROM o.lang),
limits AS (
  SELECT lang, source, max(CASE WHEN measure = 'word_length' THEN q1 - {FENCE} * greatest(q3 - q1, least) END) AS low_word_length,
    {", ".join(f"max(CASE WHEN measure = '{m}' THEN q3 + {FENCE} * greatest(q3 - q1, least) END) AS high_{m}" for m in MEASURES)} FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {MEASURES["word_length"][0].replace("div", "//")} >= low_word_length AND {" AND ".join(f"{sql.replace('div', '//')} <= high_{m}" for m, (sql, _) in MEASURES.items())} END AS kept
FROM based b LEFT JOIN limits l ON l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source
"""
