"""Benchmark decontamination by spaced seeds: passages of a test set, also with words replaced.

A mask names the positions of a short window that count; the others may hold any word. Every window of
every benchmark item and of every document is hashed under each mask, and equal hashes give hits. A hit fixes
how item and document line up; the words are then compared along that line. A document is
contaminated by an item when some stretch of 13 words (the whole item, if shorter) agrees in 80 % of its
positions. Seeds of a benchmark that fits are broadcast as places, each item's words once beside them, and documents are read
once and never shuffled. Those of a larger benchmark are broadcast as a Bloom filter of bounded size: what passes is joined by seed as a place,
and only documents with a hit are read again, their words shuffled once each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.llm.text import indexes, table
from cadastre.session import materialize

#: 1: the word counts. Each leaves out a residue of its positions, so words replaced at every third, fourth or fifth place are met by one.
MASKS = ("111011", "1101101", "1100111")
STRETCH, PERCENT = 13, 80
BROADCAST_WORDS = 1_000_000  # words of the benchmark up to which its seeds are broadcast, if they also keep to BROADCAST_BYTES
BROADCAST_BYTES, SEED_BYTES = 32 << 20, 100  # of all seeds (one a mask and word), and of one with its place
SIEVE_BITS, SIEVE_BLOCKS = 16, 1 << 18  # bits a value in a filter, and blocks of 512 bits (some 100 bytes in a broadcast) at most
NOT_WORD = r"[^\p{L}\p{N}]+"


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def _seeds(hashes: Column, at: Column) -> Column:
    """Array of the seeds of all masks at a position; NULL where the mask reaches beyond the end."""

    def seed(k: int, mask: str) -> Column:
        used = [F.get(hashes, at + o) for o, c in enumerate(mask) if c == "1"]
        return F.when(at + len(mask) <= F.size(hashes), F.xxhash64(F.lit(k), *used))

    return F.array(*[seed(k, m) for k, m in enumerate(MASKS)])


def _words_hashed(df: DataFrame) -> DataFrame:
    """(key, text) -> (key, hashes)."""
    words = df.select("key", plain_words(F.col("text")).alias("words"))
    return words.select("key", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def _windows(df: DataFrame) -> DataFrame:
    placed = df.select("*", F.explode(indexes(F.size("hashes"))).alias("at"))
    return placed.select("*", F.posexplode(_seeds(F.col("hashes"), F.col("at"))).alias("mask", "seed")).filter("seed is not null")


def _starts_line() -> Column:
    """Whether no other mask meets one place earlier on the line of a hit, and none before its own meets there: else another hit has the line."""

    def meets(mask: str, back: int) -> Column:
        same = [F.get("hashes", F.col("at") + o - back) == F.get("theirs", F.col("item_at") + o - back) for o, c in enumerate(mask) if c == "1"]
        ends = [at + len(mask) - back <= F.size(x) for x, at in (("hashes", F.col("at")), ("theirs", F.col("item_at")))]
        return reduce(Column.__and__, [*ends, *same])

    before = reduce(Column.__or__, [meets(m, 1) for m in MASKS])
    other = reduce(Column.__or__, [(F.col("mask") > k) & meets(m, 0) for k, m in enumerate(MASKS[:-1])])
    return ~((F.col("at") > 0) & (F.col("item_at") > 0) & before | other)


def _bits(value: str) -> list[tuple[str, str]]:
    """(word, bit in it) of the three bits that a 64-bit hash sets in its block of eight words."""
    return [(f"cast(shiftrightunsigned({value}, {at}) & 7 as int)", f"shiftleft(1L, cast(shiftrightunsigned({value}, {at + 3}) & 63 as int))") for at in (20, 29, 38)]


def _sifted(df: DataFrame, value: str, wanted: DataFrame, most: int) -> DataFrame:
    """Rows of `df` whose hash `value` is among the at most `most` ones of `wanted`, and a few others: a blocked Bloom filter, broadcast."""
    blocks = 1
    while blocks * 512 < most * SIEVE_BITS and blocks < SIEVE_BLOCKS:
        blocks *= 2
    block = f"{{}} & {blocks - 1}L"
    words = [F.bit_or(F.expr(" | ".join(f"if({word} = {k}, {bit}, 0L)" for word, bit in _bits("value")))) for k in range(8)]
    sieve = wanted.toDF("value").groupBy(F.expr(block.format("value")).alias("block")).agg(F.array(*words).alias("bits"))
    there = " and ".join(f"get(bits, {word}) & {bit} != 0" for word, bit in _bits(value))
    return df.join(F.broadcast(sieve), F.expr(f"({block.format(value)}) = block and {there}"), "left_semi")


def _lines_of_few(hashed: DataFrame, seeds: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, hashes, theirs, row, shift) of every line with a hit; all of the benchmark is broadcast."""
    places = seeds.groupBy("seed").agg(F.collect_list(F.struct("row", "item_at")).alias("found"))
    hits = _windows(hashed).join(F.broadcast(places), "seed").select("key", "hashes", "at", "mask", F.explode("found").alias("f"))
    lines = hits.select("key", "hashes", "at", "mask", "f.*").join(F.broadcast(texts), "row").filter(_starts_line())
    return lines.select("key", "hashes", "theirs", "row", (F.col("at") - F.col("item_at")).alias("shift"))


def _lines_of_many(docs: DataFrame, hashed: DataFrame, seeds: DataFrame, texts: DataFrame, n_seeds: int) -> DataFrame:
    """(key, hashes, theirs, row, shift) of every line with a hit; a document is known by its key and a hash of its words."""
    print_ = F.xxhash64("hashes").alias("print")
    seeds = materialize(seeds, "seeds")
    placed = _windows(hashed.select("key", print_, "hashes")).select("key", "print", "at", "seed")
    hits = _sifted(placed, "seed", seeds.select("seed"), n_seeds).join(seeds.hint("merge"), "seed")
    lines = materialize(hits.select("key", "print", "row", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "lines")
    again = _sifted(docs.withColumn("name", F.xxhash64("key")), "name", lines.select(F.xxhash64("key")), lines.count())
    again = _words_hashed(again).select(F.col("key").alias("k"), print_.alias("p"), "hashes")
    return lines.join(texts, "row").join(again.hint("merge"), F.expr("key <=> k and print = p")).select("key", "hashes", "theirs", "row", "shift")


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per contaminated document and item: id, item, item_words, matched_words (most along one line), best_stretch.

    NULL and empty texts meet nothing; items under 6 words are too short for a seed and find nothing. Rows with one id are judged
    together; a NULL id is an id like any other. An empty benchmark or table gives no rows.
    """
    items = _words_hashed(benchmark.select(F.col(item_col).alias("key"), F.col(item_text).alias("text"))).filter(F.size("hashes") > 0).distinct()
    items = materialize(items.groupBy(F.col("hashes").alias("theirs")).agg(F.collect_set(F.struct("key")).alias("items")).withColumn("row", F.monotonically_increasing_id()), "items")  # items with the same words are judged once
    n_seeds = len(MASKS) * (items.agg(F.sum(F.size("theirs"))).head()[0] or 0)
    texts = items.select("row", "theirs")
    seeds = _windows(texts.withColumnRenamed("theirs", "hashes")).select("seed", "row", F.col("at").alias("item_at"))
    docs = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    hashed = _words_hashed(docs)
    if n_seeds <= len(MASKS) * BROADCAST_WORDS and n_seeds * SEED_BYTES <= BROADCAST_BYTES:
        line = _lines_of_few(hashed, seeds, texts)
    else:
        line = _lines_of_many(docs, hashed, seeds, texts, n_seeds)
    agree = F.transform("theirs", lambda x, k: F.when((k + F.col("shift") >= 0) & (F.get(F.col("hashes"), k + F.col("shift")) == x), 1).otherwise(0))
    span, total = F.least(F.lit(STRETCH), F.size("theirs")), lambda flags: F.aggregate(flags, F.lit(0), lambda a, x: a + x)
    best = lambda flags: F.array_max(F.transform(indexes(F.size(flags) - span + 1), lambda i: total(F.slice(flags, i + 1, span))))
    # bound by a lambda and exploded, or the optimizer has the flags computed anew for each place and before any cheaper filter
    judged = F.transform(F.array(agree), lambda flags: F.struct(total(flags).alias("matched"), F.when(total(flags) * 100 >= span * PERCENT, best(flags)).alias("best")))
    line = line.select("key", "row", F.size("theirs").alias("item_words"), span.alias("span"), F.explode(judged).alias("j")).select("key", "row", "item_words", "span", "j.*")
    found = line.filter(F.col("best") * 100 >= F.col("span") * PERCENT)
    found = found.groupBy("key", "row").agg(*[F.max(c).cast("long").alias(n) for c, n in (("item_words", "item_words"), ("matched", "matched_words"), ("best", "best_stretch"))])
    named = found.join(items.select("row", F.explode("items").alias("i")), "row").select("key", F.col("i.key").alias("item"), "item_words", "matched_words", "best_stretch")
    out = named.groupBy("key", "item").agg(*[F.max(c).alias(c) for c in ("item_words", "matched_words", "best_stretch")])
    return out.withColumnsRenamed({"key": id_col, "item": item_col})


def op5_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    return benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_seed(k: int, mask: str) -> str:
    used = " || ' ' || ".join(f"w[i + {o}]" for o, c in enumerate(mask) if c == "1")
    return f"CASE WHEN i + {len(mask) - 1} <= len(w) THEN '{k} ' || {used} END"


SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{NOT_WORD}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '{NOT_WORD}'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, i, unnest([{", ".join(_sql_seed(k, m) for k, m in enumerate(MASKS))}]) AS seed FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
bs AS (SELECT item_id, i, unnest([{", ".join(_sql_seed(k, m) for k, m in enumerate(MASKS))}]) AS seed FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM b)),
hits AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS shift FROM ds JOIN bs USING (seed)),
lines AS (
  SELECT doc_id, item_id, len(b.w) AS n, least({STRETCH}, len(b.w)) AS span,
    list_transform(range(1, len(b.w) + 1), lambda k: CASE WHEN k + shift >= 1 AND d.w[k + shift] = b.w[k] THEN 1 ELSE 0 END) AS agree
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
best AS (SELECT *, list_sum(agree) AS matched, list_max(list_transform(range(1, n - span + 2), lambda s: list_sum(agree[s:s + span - 1]))) AS best FROM lines)
SELECT doc_id, item_id, max(n)::BIGINT AS item_words, max(matched)::BIGINT AS matched_words, max(best)::BIGINT AS best_stretch
FROM best WHERE best * 100 >= span * {PERCENT} GROUP BY ALL
"""
