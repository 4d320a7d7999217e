"""Collocations against a plain count of all phrases, with frequent phrases held by tasks and joined."""

import random
import re
from collections import Counter, defaultdict

import pytest

from cadastre.llm import collocations

SCHEMA = "doc_id long, text string, lang string, id long, at int, key string, f int"


def plain(rows, least, top=2000):
    n, counts = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        found = []
        for p, a in some.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and b >= a and inside(q) for q, b in some.items()):
                continue
            score, cut = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed):
    draw = random.Random(seed)
    phrases = ["New york  city hall", "in the NEW york", "été à l'aube", "a a a a a a", "\x00 \xa0 x\x1fy", "日本 語"]
    rows = [(None, "aa"), ("", None), (" \t\n.", "aa"), ("one", "bb"), ("alone. " * 40, "cc"), ("a a a a a a a\x0ba a", None), ("x" * 50_000, "aa"), ("a b " * 3000, "dd")]
    for _ in range(150):
        parts = [draw.choice(phrases) if draw.random() < 0.5 else f"w{draw.randrange(30)}" for _ in range(draw.randrange(1, 25))]
        rows.append((draw.choice([" ", "\t", " ", ", "]).join(parts), draw.choice(["aa", "aa", "aa", "bb", None, "und", ""])))
    return rows + rows[-1:]


@pytest.mark.parametrize(("seed", "in_memory", "top"), [(1, True, 2000), (2, False, 2000), (3, None, 5)])
def test_phrases_equal_a_plain_count(spark, seed, in_memory, top):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, lang, 1, 2, "k", 3) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = collocations.collocations(docs, least=10, top=top, in_memory=in_memory)
    want = plain(rows, 10, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_tables_without_frequent_phrases_give_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d", "aa", 1, 2, "k", 3), (2, None, None, 1, 2, "k", 3)], SCHEMA)
    for some in (docs, docs.limit(0)):
        got = collocations.collocations(some)
        assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(3 * 10**12, 10**13, 7 * 10**12, 5 * 10**12)], "f long, n long, l long, r long")
    assert row.select(collocations._score(F.col("l"), F.col("r"))).head()[0] == 1000 * 3 * 10**12 * 10**13 // (35 * 10**24)


def test_pairs_of_a_batch_take_little_memory():
    """Counting a batch's pairs holds a few numbers an occurrence; ids above 31 bits give the same pairs."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from cadastre.llm import collocations

    size = 400_000
    at, ids = np.tile(np.arange(100, dtype=np.int32), size // 100), np.random.default_rng(1).integers(0, 900, size)
    offsets = pa.array(np.arange(0, size + 1, 100, dtype=np.int32))
    batch = lambda add: pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(at)), pa.ListArray.from_arrays(offsets, pa.array(ids + add))], ["at", "id"])
    given = batch(0)
    tracemalloc.start()
    (few,) = collocations._pairs(iter([given]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * 8 * size
    (many,) = collocations._pairs(iter([batch(1 << 33)]))
    rows = lambda b, less: sorted(zip((b["left"].to_numpy() - less).tolist(), (b["right"].to_numpy() - less).tolist(), b["n"].to_pylist()))
    assert rows(few, 0) == rows(many, 1 << 33) and sum(few["n"].to_pylist()) == size - size // 100


def test_extending_a_batch_takes_little_memory():
    """Joining a batch with the frequent pairs holds some slices of it; the relation is the same as that of texts joined one by one."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    size, each = 3_000_000, 300
    at, ids = np.tile(np.arange(each, dtype=np.int32), size // each), np.random.default_rng(2).integers(0, 40, size)
    offsets = pa.array(np.arange(0, size + 1, each, dtype=np.int32))
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(at)), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["at", "id"])
    left, right = np.divmod(np.arange(0, 1600, 2), 40)
    extend = collocations._extended(SimpleNamespace(value=(left, right, np.arange(800) + 7)))
    tracemalloc.start()
    found = list(extend(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 8 * size
    relation = pa.Table.from_batches(found)
    alone = pa.Table.from_batches(list(extend(batch.slice(k, 1) for k in range(0, batch.num_rows, 50))))
    rows = list(zip(relation["at"].to_pylist(), relation["id"].to_pylist()))
    assert len(rows) == batch.num_rows and rows[::50] == list(zip(alone["at"].to_pylist(), alone["id"].to_pylist()))
