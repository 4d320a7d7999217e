"""Phrase collocation mining in the manner of SETM: relations of occurrences, joined with themselves one length after the other.

R1 holds, text by text and in order, the positions and numbers of all words that are frequent in their language. Neighbours
in R(k) are the candidates of length k + 1: both their parts of k words are frequent. They are merged by adjacent position inside
each text (a new piece skips a position, so no phrase crosses it), counted over all texts, and what is frequent is numbered
and semi-joined to its occurrences, which gives R(k + 1). Each relation is written to the shared folder. A phrase's row
names its two parts, so counts of all its beginnings and ends come down the line of parts and no phrase is looked up by its text.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastre.llm.numbering import numbered
from cadastre.llm.text import LOWER, UPPER, table
from cadastre.operators.joins import fits_broadcast, lookup_join
from cadastre.session import materialize

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
PLAIN = bytes.maketrans(UPPER.encode() + BREAKS, LOWER.encode() + b"\n" * len(BREAKS))
ENTRIES = 300_000  # words that a task counts before it sends them on
TOKENS = 1 << 20  # in one batch of a relation
JOINED = 1 << 18  # occurrences that a task joins with the frequent pairs at a time
RELATION = "at array<int>, id array<bigint>"
HELD = 64  # bytes of a frequent word or phrase in a task, besides its text


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """Words of each piece, A-Z lower-cased."""
    for piece in (text or "").encode().translate(PLAIN).split(b"\n"):
        if words := piece.split():
            yield words


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), combined as far as one task's memory goes."""
    found: dict[str, Counter] = defaultdict(Counter)

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(words.values(), pa.int64())], ["lang", "word", "n"])
        found.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            counts = found[lang]
            for words in pieces(text.as_py()):
                counts.update(words)
            if len(counts) > ENTRIES:
                yield from sent()
    yield from sent()


def _lists(parts: list[array]) -> pa.Array:
    flat = np.concatenate([np.frombuffer(p, p.typecode) for p in parts]) if parts else np.zeros(0, np.int64)
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _placed(known) -> callable:
    """R1 from texts: positions and numbers of the words in `known`, a broadcast {lang: {word: number}}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, ids, size = [], [], 0
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                numbers, at, spots, found = known.value.get(lang, {}), 0, array("i"), array("q")
                for words in pieces(text.as_py()):
                    for number in map(numbers.get, words):
                        if number is not None:
                            spots.append(at)
                            found.append(number)
                        at += 1
                    at += 1
                if len(spots) > 1:
                    ats.append(spots)
                    ids.append(found)
                    size += len(spots)
                if size > TOKENS:
                    yield pa.RecordBatch.from_arrays([_lists(ats), _lists(ids)], ["at", "id"])
                    ats, ids, size = [], [], 0
            if ats:
                yield pa.RecordBatch.from_arrays([_lists(ats), _lists(ids)], ["at", "id"])

    return run


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per word: text's number, position, and key, for vocabularies that are joined."""
    for batch in batches:
        for row, lang, text in zip(batch.column("row").to_pylist(), batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            at, spots, keys = 0, array("i"), []
            for words in pieces(text.as_py()):
                for word in words:
                    spots.append(at)
                    keys.append(f"{lang}\t".encode() + word)
                    at += 1
                at += 1
            for k in range(0, len(keys), TOKENS):
                some = pa.array(keys[k : k + TOKENS], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int64()), pa.array(np.frombuffer(spots, np.int32)[k : k + TOKENS]), some], ["row", "at", "key"])


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` occurrences; a longer text is a slice by itself."""
    part = np.cumsum(batch.column("at").value_lengths().to_numpy()) // most
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, stop in zip(starts, np.append(starts[1:], batch.num_rows)):
        yield batch.slice(start, stop - start)


def _neighbors(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Number of the text, position, and both ids of all adjacent occurrences of a batch."""
    lists, ids = batch.column("at"), batch.column("id").flatten().to_numpy()
    at = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    meet = np.nonzero((at[1:] == at[:-1] + 1) & (row[1:] == row[:-1]))[0]
    return row[meet], at[meet], ids[meet], ids[meet + 1]


def _adjacent(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both ids of all adjacent occurrences of a batch; beside them only marks of one byte an occurrence are held."""
    lists, ids = batch.column("at"), batch.column("id").flatten().to_numpy()
    at = lists.flatten().to_numpy()
    meet = at[1:] - at[:-1] == 1
    ends = np.cumsum(lists.value_lengths().to_numpy())[:-1]
    meet[ends[(ends > 0) & (ends < len(at))] - 1] = False
    return ids[:-1][meet], ids[1:][meet]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left, right, n) of adjacent occurrences, combined by batch: ids below 2^31 are sorted as one number a pair, in place."""
    for batch in batches:
        left, right = _adjacent(batch)
        if len(left) and max(left.max(), right.max()) >= 1 << 31:
            one, left = np.unique(left, return_inverse=True)
            other, right = np.unique(right, return_inverse=True)
            keys, n = np.unique(left * len(other) + right, return_counts=True)
            left, right = one[keys // len(other)], other[keys % len(other)]
        else:
            left <<= 32
            left |= right
            keys = left
            del right
            keys.sort()
            starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
            n, keys = np.diff(starts, append=len(keys)), keys[starts]
            left, right = keys >> 32, keys & ((1 << 32) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(n.astype(np.int64))], ["left", "right", "n"])
        del batch, left, right, keys, n
        pa.default_memory_pool().release_unused()


def _extended(known) -> callable:
    """R(k + 1) from R(k): adjacent occurrences that are in `known`, broadcast arrays (left, right, id) sorted by their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, rights, numbers = known.value
        starts = np.searchsorted(lefts, np.unique(lefts))
        heads = lefts[starts]
        rank = np.repeat(np.arange(len(heads)), np.diff(np.append(starts, len(lefts))))
        ends, place = np.unique(rights, return_inverse=True)
        keys = rank * len(ends) + place
        for batch in (some for whole in batches for some in _slices(whole, JOINED)):
            row, at, left, right = _neighbors(batch)
            a, b = np.minimum(np.searchsorted(heads, left), len(heads) - 1), np.minimum(np.searchsorted(ends, right), len(ends) - 1)
            key = a * len(ends) + b
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (heads[a] == left) & (ends[b] == right) & (keys[k] == key)
            row, at, ids = row[hit], at[hit], numbers[k[hit]]
            sizes = np.bincount(row, minlength=batch.num_rows)
            offsets = pa.array(np.append(0, np.cumsum(sizes[sizes > 1])).astype(np.int32))
            keep = sizes[row] > 1  # a lone occurrence has no neighbour
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(at[keep])), pa.ListArray.from_arrays(offsets, pa.array(ids[keep]))], ["at", "id"])

    return run


def _gathered(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """A relation from single occurrences (row, at, key) and the frequent keys (key, id)."""
    hits = lookup_join(rows, numbers, "key", "inner").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("x"))
    return hits.filter(F.size("x") > 1).select(F.col("x.at").alias("at"), F.col("x.id").alias("id"))


def _first_relation(texts: DataFrame, words: DataFrame, broadcast: bool) -> DataFrame:
    if broadcast:
        numbers: dict[str, dict[bytes, int]] = defaultdict(dict)
        for r in words.select("lang", "word", "id").collect():  # the checked size
            numbers[r["lang"]][r["word"].encode()] = r["id"]
        return texts.mapInArrow(_placed(texts.sparkSession.sparkContext.broadcast(dict(numbers))), RELATION)
    spelled = texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_spelled, "row bigint, at int, key string")
    return _gathered(spelled, words.select(F.concat("lang", F.lit("\t"), "word").alias("key"), "id"))


def _next_relation(relation: DataFrame, found: DataFrame, broadcast: bool) -> DataFrame:
    if broadcast:
        rows = found.select("left", "right", "id").toPandas().sort_values(["left", "right"])  # the checked size
        return relation.mapInArrow(_extended(relation.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy(np.int64) for c in ("left", "right", "id")))), RELATION)
    single = relation.select(F.monotonically_increasing_id().alias("row"), F.arrays_zip("at", "id").alias("x"))
    after = F.slice("x", 2, F.greatest(F.lit(0), F.size("x") - 1))
    pairs = F.filter(F.zip_with("x", after, lambda a, b: F.struct(a["at"].alias("at"), b["at"].alias("next"), F.struct(a["id"].alias("left"), b["id"].alias("right")).alias("key"))), lambda p: p["next"] == p["at"] + 1)
    rows = single.select("row", F.explode(pairs).alias("p")).select("row", "p.at", "p.key")
    return _gathered(rows, found.select(F.struct("left", "right").alias("key"), "id"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, in_memory: bool | None = None) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score; numbers exact.

    `in_memory` forces (True) or bars (False) tasks from holding the frequent words and phrases; None checks their size for each length.
    NULL texts are empty, a NULL language is `und`; repeated rows count again; equal scores rank by a, then by
    phrase; an empty table, or one without frequent phrases, gives no rows. Other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = materialize(texts.mapInArrow(_counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent, _ = numbered(words.filter(F.col("f") >= least), ["lang", "word"], "id", "frequent")
    frequent = materialize(frequent, "frequent")
    fits = lambda rows: fits_broadcast(rows, HELD) if in_memory is None else in_memory
    relation = materialize(_first_relation(texts, frequent, fits(frequent.select("lang", "word", "id"))), "occurrences")
    none = F.array().cast("array<bigint>")
    level = frequent.select("id", "lang", F.col("word").alias("phrase"), "f", none.alias("heads"), none.alias("tails"))
    levels, parents = [], []
    for length in range(2, longest + 1):
        counts = relation.mapInArrow(_pairs, "left bigint, right bigint, n bigint").groupBy("left", "right").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        found, size = numbered(counts, ["left", "right"], "id", "phrases")
        if not size:
            break
        found = materialize(found, "phrases")
        one = level.select(F.col("id").alias("left"), "lang", "phrase", F.col("f").alias("left_f"), "heads")
        other = level.select(F.col("id").alias("right"), F.element_at(F.split("phrase", " "), -1).alias("last"), F.col("f").alias("right_f"), "tails")
        joined = lookup_join(lookup_join(found, one, "left", "inner"), other, "right", "inner")
        shaped = joined.select(
            "id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "f",
            F.concat("heads", F.array("left_f")).alias("heads"), F.concat(F.array("right_f"), "tails").alias("tails"),
            F.when(F.col("left_f") == F.col("f"), F.col("left")).alias("inner_left"), F.when(F.col("right_f") == F.col("f"), F.col("right")).alias("inner_right"),
        )
        level = materialize(shaped, "level")
        parents.append(level.select(F.explode(F.array("inner_left", "inner_right")).alias("id")).filter("id IS NOT NULL").distinct())
        levels.append(level.drop("inner_left", "inner_right"))
        if length < longest:
            relation = materialize(_next_relation(relation, found, fits(found.select("left", "right", "id"))), "occurrences")
    # A phrase that lies in a longer one as frequent as itself lies, as often, in one that is longer by one word
    kept = [level.join(parents[k + 1], "id", "left_anti") if k + 1 < len(levels) else level for k, level in enumerate(levels)]
    if not kept:
        return words.sparkSession.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    every = kept[0]
    for some in kept[1:]:
        every = every.unionByName(some)
    every = every.join(F.broadcast(totals), "lang") if fits_broadcast(totals) else every.join(totals, "lang")
    cuts = F.transform(F.arrays_zip("heads", "tails"), lambda c, k: F.struct(_score(c["heads"], c["tails"]).alias("score"), k.alias("cut"), c["heads"].alias("l"), c["tails"].alias("r")))
    scored = every.withColumn("best", F.array_min(cuts)).select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "n", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _score(l, r):
    """floor(1000 * a * n / (l * r)) in 38 digits."""
    wide = lambda c: c.cast("decimal(19, 0)")
    above = F.lit(1000).cast("decimal(4, 0)") * (wide(F.col("f")) * wide(F.col("n")))
    return F.floor(F.call_function("div", above, wide(l) * wide(r)))


def op12_setm(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = """
WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY ALL),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, unnest(range(1, 6)) u(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, c.f AS a, cut, x.f AS l, y.f AS r, n, (1000 * c.f * n) // (x.f * y.f) AS score
    FROM c JOIN unnest(range(1, 5)) u(cut) ON cut < c.k JOIN t USING (lang)
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT lang, phrase, any_value(k) AS k, any_value(a) AS a, any_value(n) AS n, min({'score': score, 'cut': cut, 'l': l, 'r': r}) AS m FROM s GROUP BY ALL),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.f >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY m.score DESC, a DESC, phrase) AS rank, phrase, a, m.l AS l, m.r AS r, n, m.score AS score FROM o)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM q WHERE rank <= 2000
"""
