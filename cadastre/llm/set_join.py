"""Exact Jaccard self-join of documents as sets of word shingles, and the components of its links.

What is known of a set is used for those like it (answers), and lists are skipped by position (index):

1. Equal sets are one node. Sets that share MinHash bands are compared with one hub of the band only; verified
   links to a hub make clusters. All pairs inside a cluster share its answer, so no later step looks at them: a
   group of near copies costs one comparison a member, not one a pair.
2. Tokens are ordered by hash. The zone is the lowest quarter of hash values. Sets of sizes x, y with the
   required overlap T share at least lx - (x - T) of the lx light tokens that x has in the zone, where light leaves
   out any fixed choice of frequent tokens. Index lists of light tokens give pairs of different clusters with their
   number of common tokens; too few rule a pair out.
3. Sets for which that bound is empty (small ones, and those that mostly hold frequent tokens) meet by
   prefix lists of their whole sets, with the tokens frequent among them last. A list is sorted by size and
   position; its blocks of one size are entered only up to the position where the overlap can still be reached,
   and long lists are cut into pairs of bounded blocks.
4. Every pair that is left is verified on the whole sets. Links and clusters together give the components.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastre.llm.components import connected_components
from cadastre.llm.shingles import ODD, WordHashes, mix, shingle_set, split_words
from cadastre.llm.text import table
from cadastre.session import arrow_rows, materialize

ZONE = np.uint64(1 << 62)  # a quarter of all hash values
BANDS, ROWS = 4, 2
TEXTS = 1_000  # texts, or pairs of their sets, in one batch
LIGHT = 32  # sets up to which a token's list is short
BLOCK = 1_000  # entries of a block of a long list
BROADCAST_ROWS = 1_000_000  # candidate ids of some 60 bytes up to which they are broadcast


def _needed(x: int, y: int, percent: int) -> int:
    """Least overlap of sets of sizes x and y whose Jaccard similarity is at least percent."""
    return -(-percent * (x + y) // (100 + percent))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)))


def _features(width: int):
    """(key, text) -> key, n, fp, tokens (those in the zone), zone (their number), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        salts = [mix(np.full(1, k + 1, np.uint64))[0] | np.uint64(1) for k in range(BANDS * ROWS)]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n, fp, tokens, zone, bands = [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingle_set(hashes.of(split_words(text)), width)
                    z = int(np.searchsorted(s, ZONE))
                    n.append(len(s))
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                    zone.append(z)
                    tokens.append(s[:z])
                    if len(s):
                        mins = np.array([(s * k ^ (s >> np.uint64(17))).min() for k in salts]).reshape(BANDS, ROWS)
                        bands.append(mix(mins[:, 0] * ODD[0] + mins[:, 1] + np.arange(BANDS, dtype=np.uint64)))
                    else:
                        bands.append(s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int32()), pa.array(fp, pa.binary()), _lists(tokens), pa.array(zone, pa.int32()), _lists(bands)], names=["key", "n", "fp", "tokens", "zone", "bands"]
                )

    return run


def _sets(width: int):
    """(node, fp, text) -> (node, whole) for texts that have the expected set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [(i, s) for i, t in enumerate(batch.column(2).to_pylist()) for s in [shingle_set(hashes.of(split_words(t)), width).tobytes()] if xxhash.xxh3_128_digest(s) == batch.column(1)[i].as_py()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([s for _, s in found], pa.binary())], names=["node", "whole"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, whole) -> (node, the set's tokens)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists([np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column(1)])], names=["node", "tokens"])


def _verify(percent: int):
    """(a, b, set of a, set of b) -> (a, b) where they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _light_pairs(percent: int):
    """(size, zone tokens, node, cluster of each entry of a short list) -> every pair of different clusters and possible sizes, once per list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for entries in batch.column(0).to_pylist():
                es = sorted((e["n"], e["zone"], e["node"], e["cluster"]) for e in entries)
                for i, (n, z, node, cluster) in enumerate(es):
                    for n2, z2, node2, cluster2 in es[i + 1 :]:
                        if n * 100 < percent * n2:
                            break
                        if cluster != cluster2:
                            out.append((node, node2, n, n2, z, z2) if node < node2 else (node2, node, n2, n, z2, z))
            columns = np.array(out, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "na", "nb", "za", "zb"])

    return run


def _block_pairs(percent: int):
    """(entries of two blocks of one list, i, j) -> pairs that can still reach the overlap they need; i = j for pairs inside one block."""

    def skip(left: list[tuple], right: list[tuple], same: bool) -> Iterator[tuple[int, int]]:
        sizes: dict[int, list[tuple]] = {}
        for e in left:
            sizes.setdefault(e[0], []).append(e)
        positions = {n: [e[1] for e in block] for n, block in sizes.items()}
        for n2, at2, node2, cluster2 in right:
            for n, block in sizes.items():
                if n * 100 < percent * n2 or n2 * 100 < percent * n:
                    continue
                need = _needed(n, n2, percent)
                if n2 - at2 < need:  # even with all that follows
                    continue
                for _, _, node, cluster in block[: bisect_right(positions[n], n - need)]:  # the rest of the block starts too late
                    if cluster != cluster2 and (not same or node < node2):
                        yield (node, node2) if node < node2 else (node2, node)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[int, int]] = set()
            for entries, i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                es = sorted((e["n"], e["at"], e["node"], e["cluster"], e["block"]) for e in entries)
                left, right = ([e[:4] for e in es if e[4] == k] for k in (i, j))
                out.update(skip(left, right, i == j))
            columns = np.array(list(out), np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b"])

    return run


def _live(postings: DataFrame) -> DataFrame:
    """(token, df) of tokens that sets of different clusters hold; combined before the shuffle."""
    counted = postings.groupBy("token").agg(F.count("*").alias("df"), F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    return materialize(counted.filter("df > 1 and low < high").select("token", "df"), "live")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the least id that links reach, its own included).

    Sets link when 100 * |intersection| >= percent * |union|. Texts without words (NULL, empty, blank) have no shingles and link
    with nothing, each other neither: component_id is their own id. Repeated rows and rows that share an id are sets of
    their own; a NULL id takes part, and is the least only where no other id is in its component. Any orderable id will do. Other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and up to 100")
    picked = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    id_type = picked.schema["key"].dataType
    fields = T._parse_datatype_string("n int, fp binary, tokens array<bigint>, zone int, bands array<bigint>").fields
    feats = picked.mapInArrow(_features(width), T.StructType([T.StructField("key", id_type), *fields]))
    with arrow_rows(spark, TEXTS):
        feats = materialize(feats.withColumn("row", F.monotonically_increasing_id()), "sets")

    copies = materialize(feats.filter("n > 0").groupBy("fp").agg(F.min("row").alias("node"), F.count("*").alias("c")).filter("c > 1").select("fp", "node"), "copies")
    copied = materialize(feats.select("row", "fp").join(copies, "fp").filter("row != node").select("row", "node"), "copied")
    nodes = materialize(feats.filter("n > 0").join(copied.select("row"), "row", "left_anti").withColumnRenamed("row", "node"), "nodes")

    def whole_sets(wanted: DataFrame) -> DataFrame:
        """(node, whole) of the wanted nodes, from their texts."""
        ids = materialize(nodes.select("node", F.col("key").alias("k"), "fp").join(wanted, "node", "left_semi"), "wanted")
        if ids.count() <= BROADCAST_ROWS:
            ids = F.broadcast(ids)
        sets = picked.join(ids, F.expr("key <=> k")).select("node", "fp", "text").mapInArrow(_sets(width), "node bigint, whole binary")
        with arrow_rows(spark, TEXTS):
            return materialize(sets.groupBy("node").agg(F.first("whole").alias("whole")), "whole")

    def verified(pairs: DataFrame, wholes: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) that link."""
        pairs = materialize(pairs, "pairs")
        sets = wholes if wholes is not None else whole_sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        left, right = (sets.select(F.col("node").alias(c), F.col("whole").alias(f"set_{c}")) for c in "ab")
        joined = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
        with arrow_rows(spark, TEXTS):
            return materialize(joined.mapInArrow(_verify(percent), "a bigint, b bigint"), "links")

    # Answers: clusters around hubs of shared bands, first the least node of a band, then the one with most links
    banded = materialize(nodes.select("node", F.explode("bands").alias("band")), "bands")
    shared = materialize(banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("c")).filter("c > 1").select("band", "hub"), "shared")
    in_band = materialize(banded.join(shared, "band"), "in-band")
    wholes = whole_sets(in_band.select("node").distinct())
    first = verified(in_band.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), wholes)
    fame = materialize(first.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("links")), "fame")
    famous = in_band.select("band", "node").join(fame, "node").groupBy("band").agg(F.max(F.struct("links", (-F.col("node")).alias("minus"))).alias("best"))
    famous = materialize(famous.select("band", (-F.col("best.minus")).alias("star")), "famous")
    second = in_band.join(famous, "band").filter("node != star and star != hub").select(F.col("node").alias("a"), F.col("star").alias("b")).distinct()
    second = verified(second.join(first, ["a", "b"], "left_anti"), wholes)
    stars = materialize(first.union(second), "stars")
    clusters = connected_components(stars)

    # Index: lists of light tokens in the zone
    placed = materialize(nodes.join(clusters, "node", "left").select("node", "n", "zone", "tokens", F.coalesce("root", "node").alias("cluster")), "placed")
    in_zone = placed.filter("zone > 0").select("node", "n", "zone", "cluster", F.explode("tokens").alias("token"))
    live = _live(in_zone)
    hits = in_zone.join(live, "token")
    heavy = materialize(hits.filter(F.col("df") > LIGHT).groupBy("node").agg(F.count("*").cast("int").alias("heavy")), "heavy")
    lists = hits.filter(F.col("df") <= LIGHT).groupBy("token").agg(F.collect_list(F.struct("n", "zone", "node", "cluster")).alias("entries"))  # at most LIGHT each
    met = lists.select("entries").mapInArrow(_light_pairs(percent), "a bigint, b bigint, na bigint, nb bigint, za bigint, zb bigint")
    met = met.groupBy("a", "b", "na", "nb", "za", "zb").agg(F.count("*").alias("common"))
    needed = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100.0 + percent) - 1e-9)
    met = materialize(met.withColumn("needed", needed), "met")
    for c in "ab":
        met = met.join(heavy.select(F.col("node").alias(c), F.col("heavy").alias(f"h{c}")), c, "left")
    bound = F.greatest(*[F.col(f"z{c}") - F.coalesce(f"h{c}", F.lit(0)) - (F.col(f"n{c}") - F.col("needed")) for c in "ab"])
    candidates = met.filter(F.col("common") >= bound).select("a", "b")

    # Sets without a bound there: prefix lists over their whole sets, tokens that are frequent among them last
    least = F.ceil(F.lit(percent) * F.col("n") / F.lit(100.0) - 1e-9)
    poor = placed.join(heavy, "node", "left").filter(F.col("zone") - F.coalesce("heavy", F.lit(0)) - (F.col("n") - least) < 1)
    poor = materialize(poor.select("node", "n", "cluster", (F.col("n") - least + 1).cast("int").alias("reach")), "poor")
    tokens = whole_sets(poor.select("node")).mapInArrow(_tokens, "node bigint, tokens array<bigint>")
    with arrow_rows(spark, TEXTS):
        tokens = materialize(tokens.select("node", F.explode("tokens").alias("token")), "poor-tokens")
    frequent = materialize(tokens.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") > LIGHT).select("token", F.lit(1).alias("often")), "frequent")
    ranked = tokens.join(frequent, "token", "left").groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token"))).alias("order"))
    prefixed = poor.join(ranked, "node").select("node", "n", "cluster", F.posexplode(F.slice("order", F.lit(1), F.col("reach"))).alias("at", "t"))
    prefixed = materialize(prefixed.select("node", "n", "cluster", "at", F.col("t.token").alias("token")), "prefixes")
    long = _live(prefixed).select("token", F.ceil(F.col("df") / BLOCK).cast("int").alias("blocks"))
    listed = prefixed.join(long, "token").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    cut = listed.select("token", F.struct("n", "at", "node", "cluster", "block").alias("e"), F.explode(sides).alias("s"))
    blocks = cut.groupBy("token", "s").agg(F.collect_list("e").alias("entries")).select("entries", F.col("s.i").alias("i"), F.col("s.j").alias("j"))  # two blocks each
    candidates = candidates.union(blocks.mapInArrow(_block_pairs(percent), "a bigint, b bigint")).distinct()

    links = stars.union(verified(candidates))
    roots = connected_components(links)

    grouped = feats.select("row", "key").join(copied, "row", "left").withColumn("node", F.coalesce("node", "row"))
    in_groups = grouped.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    in_groups = materialize(in_groups.select("row", "key", "root"), "grouped")
    names = materialize(in_groups.groupBy("root").agg(F.min("key").alias("component_id"), F.count("*").alias("c")).filter("c > 1").drop("c"), "names")
    named = materialize(in_groups.join(names, "root").select("row", "component_id", F.lit(True).alias("named")), "named")
    out = feats.select("row", "key", F.col("n").cast("long").alias("n_shingles")).join(named, "row", "left")
    return out.select(F.col("key").alias(id_col), "n_shingles", F.when(F.col("named"), F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def op2_set_relations(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
t AS (SELECT doc_id, unnest(s) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 85 * (len(x.s) + len(y.s) - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = doc_id
"""
