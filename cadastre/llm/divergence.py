"""Source divergence audit: the group-term matrix as a K-squared quadtree, priced pair by pair of groups.

Groups (language, source) are the rows and the terms that a language keeps the columns of one sparse matrix of counts.
It is halved in both directions, down to leaves of ROWS x COLS cells; quadrants without counts have no node at any level.
A pair of groups differs by a sum over all terms, which is cut in three: a term that the other group lacks costs the same for
all terms of one count, so these are priced from each group's histogram of counts, and so are the terms that neither
has; only columns where both have counts need a look at cells. To find them, pairs of nodes over the same columns go down the
tree together and stop where either is empty; the leaves they reach are compared by a numpy kernel.
Terms are numbered by how many groups hold them, then by their first group, so that rare terms fill few quadrants.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastre.llm.numbering import numbered
from cadastre.llm.text import LOWER, UPPER, table
from cadastre.operators.joins import fits_broadcast
from cadastre.session import materialize

LETTERS = (UPPER + LOWER).encode()
PLAIN = bytes(ord(chr(c).lower()) if c in LETTERS else c if c > 0x7F else 0x20 for c in range(256))  # what no term holds is a blank
ENTRIES = 1_000_000  # terms that a task counts before it sends them on: some 130 MB
SCALE = 1_000_000_000
ROWS, COLS = 32, 4096  # powers of two
CHUNK = 4096  # counts of a histogram in one row


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)); 1 where a language keeps no term."""
    below = f"nullif({total} + {kept}, 0)"
    return F.expr(f"1 + coalesce((CAST({count} + 1 AS DECIMAL(20, 0)) * {SCALE}BD) div CAST({below} AS DECIMAL(20, 0)), 0)")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs), combined as far as one task's memory goes."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in found.items():
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), terms, pa.array(counts.values(), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])
        found.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            if (lang, source) not in found:
                found[lang, source] = Counter(), Counter()
            counts, docs = found[lang, source]
            before = len(counts)
            terms = (text.as_py() or "").encode().translate(PLAIN).split()
            counts.update(terms)
            docs.update(set(terms))
            size += len(counts) - before
            if size > ENTRIES:
                yield from sent()
                size = 0
    yield from sent()


def _gap(p, q):
    return (p - q) * (p - q) // q


def _arrays(batch: pa.RecordBatch, k: int, names: list[str]) -> list[np.ndarray]:
    return [batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in names]


def _summed(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    one, other, value = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))
    keys, at = np.unique(np.stack([one, other], axis=1), axis=0, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at.ravel(), value)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[:, 0], keys[:, 1], sums)], ["a", "b", "value"])


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What columns with counts in both groups change against the price of one-sided counts, for both directions of each pair."""
    for batch in batches:
        found = []
        for k in range(batch.num_rows):
            ar, ac, ap, a0 = _arrays(batch, k, ["ar", "ac", "ap", "a0"])
            br, bc, bp, b0 = _arrays(batch, k, ["br", "bc", "bp", "b0"])
            base = min(ac.min(), bc.min())
            rows, first = np.unique(br, return_index=True)
            dense = np.zeros((len(rows), max(ac.max(), bc.max()) - base + 1), np.int64)
            dense[np.searchsorted(rows, br), bc - base] = bp
            zeros = b0[first]
            same = batch.column("a")[k].as_py() == batch.column("b")[k].as_py()
            for g in np.unique(ar):
                own = ar == g
                p, p0, cols = ap[own], a0[own][0], ac[own] - base
                across = dense[:, cols]
                at, column = np.nonzero(across)
                q, p, q0 = across[at, column], p[column], zeros[at]
                met, at = np.unique(at, return_inverse=True)  # a leaf may hold groups of another language
                for there, back, value in ((False, True, _gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0)), (True, False, _gap(q, p) - _gap(q, p0) - _gap(q0, p) + _gap(q0, p0))):
                    if there and same:
                        continue  # the kernel meets (h, g) by itself
                    sums = np.zeros(len(met), np.int64)
                    np.add.at(sums, at, value)
                    pair = rows[met], np.full(len(met), g)
                    found.append((*(pair[::-1] if back else pair), sums))
        yield _summed(found)


def _priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prices of all terms as if the other group had none of them, for both directions."""
    for batch in batches:
        found = []
        for k in range(batch.num_rows):
            row, p, p0, n = _arrays(batch, k, ["row", "p", "p0", "n"])
            for other, q0 in zip(*_arrays(batch, k, ["others", "zeros"]), strict=True):
                found.append((row, np.full(len(row), other), n * _gap(p, q0)))
                some = p > p0
                found.append((np.full(some.sum(), other), row[some], (n * (_gap(q0, p) - _gap(q0, p0)))[some]))
        yield _summed(found)


def joint_leaves(leaves: DataFrame, depth: int) -> DataFrame:
    """Pairs (a <= b) of leaf rows with a leaf column c that both fill: nodes are met level by level from the root."""
    nodes = {k: leaves.select(F.shiftright("r", depth - k).alias("r"), F.shiftright("c", depth - k).alias("c")).distinct() for k in range(depth + 1)}
    pairs = nodes[0].select(F.col("r").alias("a"), F.col("r").alias("b"), "c")
    for k in range(1, depth + 1):
        level = materialize(nodes[k], "nodes")
        above = pairs.select(F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("c").alias("c0"))
        one = level.select(F.col("r").alias("a"), "c", F.shiftright("r", 1).alias("a0"), F.shiftright("c", 1).alias("c0"))
        other = level.select(F.col("r").alias("b"), "c", F.shiftright("r", 1).alias("b0"))
        pairs = materialize(above.join(one, ["a0", "c0"]).join(other, ["b0", "c"]).filter("a <= b").select("a", "b", "c"), "frontier")
    return pairs


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200) -> DataFrame:
    """How far sources of one language differ in their terms: lang, source, part, item, value, rank.

    Part `pair`: every other source of the language; part `term`: the `top` terms that the group uses more than its
    language. NULLs are empty strings; groups without terms have pairs; a language that keeps no term has value 0; equal
    values rank by item; repeated rows count as documents of their own; an empty table gives no rows; other columns are not read.
    """
    lang, source = (F.coalesce(F.col(c), F.lit("")) for c in (lang_col, source_col))
    words = docs.select(lang.alias("lang"), source.alias("source"), F.col(text_col).alias("text")).mapInArrow(_counted, "lang string, source string, term string, count bigint, docs bigint")
    # most tasks send a term once, so little is gained by combining rows before they are dealt; groups of a term arrive side by side, which gives its sums too
    cells = words.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    sums = {"all": F.sum("count"), "docs": F.sum("docs"), "holders": F.count("*"), "lead": F.min("source")}
    cells = materialize(cells.select("lang", "source", "term", "count", *[f.over(over).alias(n) for n, f in sums.items()]).filter(F.col("docs") >= least_docs).drop("docs"), "cells")
    terms = cells.filter("source = lead").select("lang", "term", "all", "holders", "lead")
    columns, width = numbered(terms, ["lang", F.desc("holders"), "lead", "term"], "col", "terms")
    columns = materialize(columns.drop("holders", "lead"), "columns")
    langs = columns.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    counted = materialize(cells.select("lang", "source", "term", "count").join(columns, ["lang", "term"]), "counted")
    totals = counted.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("held"))
    groups = docs.select(lang.alias("lang"), source.alias("source")).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "held", "kept", "lang_total"])
    groups, height = numbered(groups, ["lang", "source"], "row", "groups")
    groups = materialize(groups.withColumn("zero", _share("0", "total", "kept")), "rows")
    known = groups.select("lang", "source", "row", "zero", "total", "kept", "lang_total")
    known = F.broadcast(known) if fits_broadcast(known) else known
    kept = materialize(
        counted.join(known, ["lang", "source"]).select(
            "lang", "source", "term", "row", "col", "zero", _share("count", "total", "kept").alias("p"), _share("all", "lang_total", "kept").alias("q")
        ),
        "kept",
    )

    depth = max(max(0, height - 1) // ROWS, max(0, width - 1) // COLS).bit_length()
    leaf = [F.floor(F.col("row") / ROWS).alias("r"), F.floor(F.col("col") / COLS).alias("c")]
    full = materialize(kept.groupBy(*leaf).agg(F.collect_list(F.struct("row", "col", "p", "zero")).alias("x")), "leaves")  # at most ROWS x COLS cells
    pairs = joint_leaves(full.select("r", "c"), depth)
    fields = {"r": "row", "c": "col", "p": "p", "0": "zero"}
    payload = lambda side: full.select(F.col("r").alias(side), "c", *[F.col(f"x.{f}").alias(side + s) for s, f in fields.items()])
    both = pairs.join(payload("a"), ["a", "c"]).join(payload("b"), ["b", "c"]).select("a", "b", *[s + f for s in "ab" for f in fields])
    joint = both.mapInArrow(_joint, "a long, b long, value long")

    counts = kept.groupBy("lang", "row", "zero", "p").agg(F.count("*").alias("n"))
    none = groups.select("lang", "row", "zero", F.col("zero").alias("p"), (F.col("kept") - F.col("held")).alias("n"))
    histogram = counts.unionByName(none).withColumn("r", F.floor(F.col("row") / ROWS))
    most = counts.groupBy(F.floor(F.col("row") / ROWS)).count().agg(F.max("count")).head()[0] or 0
    chunk = F.pmod(F.xxhash64("row", "p"), F.lit(1 + most // CHUNK))
    rows = histogram.groupBy("lang", "r", chunk.alias("chunk")).agg(F.collect_list(F.struct("row", "p", F.col("zero").alias("p0"), "n")).alias("x"))
    blocks = groups.groupBy("lang", F.floor(F.col("row") / ROWS).alias("other")).agg(F.collect_list(F.struct("row", "zero")).alias("y"))
    opposite = F.broadcast(blocks) if fits_broadcast(groups.select("lang", "row", "zero")) else blocks
    met = rows.join(opposite, "lang").select(F.col("x.row").alias("row"), F.col("x.p").alias("p"), F.col("x.p0").alias("p0"), F.col("x.n").alias("n"), F.col("y.row").alias("others"), F.col("y.zero").alias("zeros"))
    priced = met.mapInArrow(_priced, "a long, b long, value long")

    value = priced.unionByName(joint).filter("a <> b").groupBy("a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("row", "lang", "source")
    left, right = names.select(F.col("row").alias("a"), "lang", "source"), names.select(F.col("row").alias("b"), F.col("source").alias("item"))
    if fits_broadcast(names):
        left, right = F.broadcast(left), F.broadcast(right)
    between = value.join(left, "a").join(right, "b").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    above = kept.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    return between.select("*", rank).unionByName(above.select("*", rank).filter(F.col("rank") <= top))


def op13_joint_quadtree(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN df USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM df GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, df.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (n + v) AS p
    FROM g JOIN df USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
l AS (SELECT lang, term, 1 + (1000000000 * (sum(c) + 1)) // (sum(sum(c)) OVER (PARTITION BY lang) + any_value(v)) AS q FROM c JOIN v USING (lang) GROUP BY lang, term),
t AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN l USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM t) WHERE rank <= 200
"""
