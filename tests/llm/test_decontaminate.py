"""Benchmarks that do not fit a broadcast: the same rows, and no words of an item beside its seeds."""

import random

import pytest
from pyspark.sql import functions as F

from cadastre.llm import decontaminate


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def overlaps(spark, texts, items):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    return sorted(map(repr, map(tuple, decontaminate.benchmark_overlaps(docs, benchmark).collect())))


def plain(texts, items):
    """All alignments of all pairs, without seeds."""
    out = {}
    for key, text in texts:
        for item, passage in items:
            d, b = ((x or "").lower().split() for x in (text, passage))
            for shift in range(-len(b), len(d)) if len(b) > 12 else ():
                agree = [0 <= k + shift < len(d) and d[k + shift] == w for k, w in enumerate(b)]
                best = max(sum(agree[i : i + 13]) for i in range(len(b) - 12))
                if best * 100 >= 13 * 80:
                    was = out.get((key, item), (0, 0))
                    out[key, item] = (max(was[0], sum(agree)), max(was[1], best))
    words = {i: len(p.split()) for i, p in items if p}
    return sorted(repr((key, item, words[item], *found)) for (key, item), found in out.items())


@pytest.mark.parametrize("words", [1_000_000, 0])
def test_small_and_large_benchmarks_meet_the_same_documents(spark, monkeypatch, words):
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", words)
    draw = random.Random(1)
    items = [(i, prose(100 + i, 13 + i)) for i in range(12)] + [(20, prose(103, 16)), (21, None), (22, "")]  # 3 and 20 have the same words
    worn = lambda i: " ".join(w if draw.random() < 0.9 else "x" for w in items[i][1].split())
    texts = [(i, prose(i, 30) + " " + worn(i % 12) + " " + prose(50 + i, 20)) for i in range(30)] + [(i, prose(200 + i, 60)) for i in range(30, 60)]
    texts += [(None, worn(3)), (None, items[5][1]), (7, items[5][1] + " " + worn(6)), (8, None), (9, ""), texts[2], texts[2]]
    found = overlaps(spark, texts, items)
    assert found == plain(texts, items) and len(found) > 25 and any("None" in r for r in found)


@pytest.mark.parametrize("words", [1_000_000, 0])
def test_the_words_of_an_item_are_not_broadcast_with_each_of_its_seeds(spark, monkeypatch, words):
    """3,000 words: 9,000 seeds of 24 KB each were 216 MB."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", words)
    name, item = "spark.sql.maxBroadcastTableSize", prose(1, 3000, 10**6)
    before = spark.conf.get(name)
    spark.conf.set(name, str(64 << 20))
    try:
        assert overlaps(spark, [(1, "x y " + item), (2, prose(2, 3000, 10**6))], [(5, item)]) == ["(1, 5, 3000, 3000, 13)"]
    finally:
        spark.conf.set(name, before)


def test_many_items_leave_the_broadcast_by_their_bytes(spark, monkeypatch):
    called, whole = [], decontaminate._lines_of_many
    monkeypatch.setattr(decontaminate, "_lines_of_many", lambda *a: called.append(1) or whole(*a))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 10_000)
    items = [(i, prose(i, 40)) for i in range(5)]
    assert overlaps(spark, items[2:3], items) == ["(2, 2, 40, 40, 13)"] and called


def test_a_sieve_lets_all_of_its_values_and_few_others_pass(spark):
    values = spark.range(200_000).select(F.xxhash64("id").alias("h"), "id")
    passed = decontaminate._sifted(values, "h", values.filter("id % 10 = 0").select("h"), 20_000)
    kept = passed.agg(F.count_if(F.col("id") % 10 == 0), F.count("*")).head()
    assert kept[0] == 20_000 and kept[1] < 20_000 + 180_000 * 0.03
    assert decontaminate._sifted(values, "h", values.limit(0).select("h"), 0).isEmpty()
