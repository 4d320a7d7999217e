"""Small cases of the corpus operators: NULLs, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools
import random
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadastre.llm import decontaminate, language, license_scan, packing, passages, quality_model, quality_rules, set_join, sharding, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, node string, fp int, row int, key string, tokens int, label int"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, "x", 1, 2, "k", 3, 4) for i, t in zip(ids, texts)], SCHEMA)


def prose(seed, n, vocabulary=3000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


# 1 -----------------------------------------------------------------------------------------------------------------
URLS = [
    ("http://a.example.com/en/1", "a.example.com", "/en/1", None), ("HTTP://A.Example.NET/en/2?x#y", "a.example.net", "/en/2", "example.net/en/"), ("http://b.net", "b.net", "", None),
    ("https://b.net/q", "b.net", "/q", "net/"), ("x://de.example.com/de/", "de.example.com", "/de/", "example.com/de/"), ("http://myexample.com/de/1", "myexample.com", "/de/1", None),
    ("http://org/fr/3", "org", "/fr/3", "org/fr/"), ("no scheme", "", "", None), (None, "", "", None), ("http://h:80/p", "h:80", "/p", None), ("a://b://c/d", "b:", "//c/d", None),
]


def test_urls_are_cut_and_the_longest_rule_wins(spark):
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "x")], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(0, None)], "page_id long, good int")
    got = url_filter.filter_urls(pages, outcomes).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"]) == URLS[r["page_id"]][1:]
        assert r["verdict"] == ("block" if r["rule"] in ("net/", "example.com/de/") else "allow")


def test_bad_hosts_are_blocked_and_thin_evidence_is_not(spark):
    hosts = [f"h{k}.d{k}.com" for k in range(30) for _ in range(20)] + ["bad.one.com"] * 60 + ["thin.three.com"] + ["new.four.com"]
    good = [int(i % 5 > 0) for i in range(600)] + [0] * 60 + [0, None]
    pages = spark.createDataFrame([(i, f"http://{h}/{i}") for i, h in enumerate(hosts)], "page_id long, url string")
    outcomes = spark.createDataFrame(list(enumerate(good)), "page_id long, good int")
    verdicts = {r["host"]: r["verdict"] for r in url_filter.filter_urls(pages, outcomes).collect()}
    assert {h for h, v in verdicts.items() if v == "block"} == {"bad.one.com"}
    assert url_filter.filter_urls(pages.limit(0), outcomes).count() == 0


# 2 -----------------------------------------------------------------------------------------------------------------
def brute_components(rows, width, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted([(key, len(s), least.get(root(i)) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets))], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    draw = random.Random(seed)
    texts = [None, "", " \t\n", "one", "One", "one two", "a b c d", "A B C D", "a b c d e", prose(9, 6000)]
    for base in range(12):
        words = prose(seed * 100 + base, draw.choice([8, 20, 60, 150])).split()
        for _ in range(draw.choice([1, 3, 25])):
            copy = list(words)
            for _ in range(draw.choice([0, 1, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = f"e{draw.randrange(50)}"
            texts.append(" ".join(copy) + draw.choice(["", " shared line of some words here", ""]))
    rows = list(enumerate(texts)) + [(3, "one"), (None, texts[12]), (2, prose(5, 40)), (7, prose(6, 40))]
    draw.shuffle(rows)
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)
    got = set_join.jaccard_components(docs)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_components(rows, 4, 85)


def test_long_lists_are_cut_into_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", 5)
    monkeypatch.setattr(set_join, "LIGHT", 3)
    draw = random.Random(4)
    line = prose(1, 14).split()
    rows = [(i, " ".join(line + [f"u{draw.randrange(30)}" for _ in range(draw.randrange(1, 4))])) for i in range(60)]
    got = set_join.jaccard_components(frame(spark, [t for _, t in rows]), percent=80)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_components(rows, 4, 80)
    assert set_join.jaccard_components(frame(spark, [])).count() == 0


# 3 -----------------------------------------------------------------------------------------------------------------
def test_languages_are_learnt_and_odd_texts_have_a_result(spark):
    samples = {"aa": "papa mama lala nana", "bb": "xyxy zuzu qiqi wowo"}
    rows = [(i, " ".join(random.Random(i).choices(samples[k].split(), k=12)), k) for i in range(60) for k in [("aa", "bb")[i % 2]]]
    odd = [(100, None, "aa"), (101, "", None), (102, "12 34 !!", "aa"), (103, "Papamama", None), (104, "ñandú", None), (None, "xyxyzuzu", "bb"), (105, "papa " * 30_000, None)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows + odd + rows[:1]], "doc_id long, text string, lang string, lang_pred string, score int")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows)
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[102]["score"] == 0
    assert got[103]["lang_pred"] == "aa" and got[None]["lang_pred"] == "bb" and got[105]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert language.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_a_hot_language_takes_neither_rows_nor_words_nor_ngrams_of_the_others(spark):
    hot = [(f"{prose(i, 40, 400)} {'kept ' * (i % 3)}", "aa") for i in range(400)]
    rare = [("zuzu qiqi wowo " + "xyxyxy " * 2, "zz"), ("qiqi zuzu olala", "zz")]
    docs = spark.createDataFrame(hot + rare, "text string, lang string")
    model = language.fit_languages(docs, max_rows=40, max_words=5)
    assert model.languages == ["aa", "zz"]
    words = model.tables[0]
    assert {w for w, (a, z) in words.items() if z < language.PENALTY} == {"zuzu", "qiqi", "xyxyxy"}
    assert 0 < sum(a < language.PENALTY for a, _ in words.values()) <= 5
    assert "ola" not in words and model.tables[3]["xyx"][1] < language.PENALTY and model.tables[1]["o"][1] < language.PENALTY
    counts = Counter(g for t, _ in rare for w in t.split() for p in [f" {w} "] for g in (p[i : i + 2] for i in range(len(p) - 1)))
    assert {g for g, (_, z) in model.tables[2].items() if z < language.PENALTY} >= {g for g, n in counts.items() if n > 1}


# 4 -----------------------------------------------------------------------------------------------------------------
def test_packing_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "Hello WORLD it's <|endoftext|>  we'll", "naïve ÀÉ×÷ ß İstanbul ΣΑΣ 3a4 .. 日本", prose(3, 9000), "a\n\nb\tc", " lead trail "]
    docs = frame(spark, texts + texts[2:3], [*range(len(texts)), None]).repartition(3)
    whole = Tokenizer.from_file(packing.vocabulary())
    got = packing.concatenate_and_cut(docs, packing.vocabulary()).collect()
    digests = packing.concatenate_and_cut(docs, packing.vocabulary(), digest=True).select("doc_id", "length", "ids_crc32").collect()
    assert sorted(map(repr, digests)) == sorted(f"Row(doc_id={p['doc_id']!r}, length={p['length']}, ids_crc32={zlib.crc32(struct.pack('<%dI' % p['length'], *p['ids']))})" for p in got)
    for i, text in [*enumerate(texts), (None, texts[2])]:
        ids = []
        for p in sorted((p for p in got if p["doc_id"] == i), key=lambda p: p["start"]):
            assert p["start"] == len(ids) and p["length"] == len(p["ids"])
            ids += p["ids"]
        assert ids == [*whole.encode(text or "", add_special_tokens=False).ids, 1]
    lengths = Counter()
    for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == lengths[p["sequence_id"]]
        lengths[p["sequence_id"]] += p["length"]
    assert [lengths[i] for i in range(len(lengths) - 1)] == [2048] * (len(lengths) - 1)
    assert packing.concatenate_and_cut(frame(spark, []), packing.vocabulary()).count() == 0


# 5 -----------------------------------------------------------------------------------------------------------------
def test_passages_of_the_benchmark_are_found_with_words_replaced(spark):
    item = prose(1, 40).split()
    fifth = [w if i % 5 else f"r{i}" for i, w in enumerate(item)]
    half = [w if i % 2 else f"r{i}" for i, w in enumerate(item)]
    texts = [None, "", prose(2, 100), prose(3, 50) + " " + " ".join(item).upper() + "! " + prose(4, 5000), prose(5, 30) + " " + " ".join(fifth), prose(6, 30) + " " + " ".join(half), " ".join(item[:20]), "of the and to in"]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (10, "one two three four five six seven")], "item_id long, text string")
    docs = frame(spark, texts + texts[3:4], [*range(len(texts)), None])
    got = {(r["doc_id"], r["item_id"]): (r["matched_words"], r["best_stretch"]) for r in decontaminate.benchmark_overlaps(docs, benchmark).collect()}
    assert set(got) == {(3, 7), (None, 7), (4, 7), (6, 7)} and got[3, 7] == (40, 13) and got[4, 7] == (32, 11)
    assert decontaminate.benchmark_overlaps(docs, benchmark.limit(0)).count() == decontaminate.benchmark_overlaps(docs.limit(0), benchmark).count() == 0


def test_a_large_benchmark_is_joined_without_a_broadcast_hint(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 0)
    benchmark = spark.createDataFrame([(7, prose(1, 40))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.benchmark_overlaps(frame(spark, [prose(1, 40), prose(2, 40)]), benchmark).collect()] == [(0, 7, 40, 40, 13)]


# 6 -----------------------------------------------------------------------------------------------------------------
def brute_counts(text):
    w = (text or "").encode().split()
    w = [x.decode() for x in w]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + o for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_a_plain_version_and_junk_is_told_by_its_group(spark, monkeypatch):
    few = "a b a b a b c\n" * 40
    texts = [None, "", "  \n\n ", "é日 ß", few, few + prose(1, 200, 20), prose(2, 9000, 15), "x\nx \nx\n y", "a b", "a b c a b c"]
    clean = [prose(i, 120) for i in range(80)]
    junk = [" ".join(w + "***" for w in prose(i, 120).split()) for i in range(3)]
    docs = frame(spark, texts + clean + junk)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, text in enumerate(texts + clean + junk):
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(text)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert all(got[len(texts) + i]["kept"] for i in range(80)) and not any(got[len(texts) + 80 + i]["kept"] for i in range(3))
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0
    monkeypatch.setattr(quality_rules, "FEW", 0)
    again = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert again == got


def test_sketches_merge_and_know_values_to_a_32nd(spark):
    values = spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("x"), (F.col("id") % 3).alias("lang"), F.lit("m").alias("measure"))
    whole = quality_rules.quartiles(quality_rules.merge(quality_rules.sketch(values, ["lang"]), []), []).head()
    assert whole["total"] == 20_000 and abs(whole["q1"] - 5_000) <= 5_000 / 32 and abs(whole["q3"] - 15_000) <= 15_000 / 32


# 7 -----------------------------------------------------------------------------------------------------------------
def test_quality_is_learnt_and_held_out_rows_are_told(spark):
    good, bad = [prose(i, 80) for i in range(150)], [" ".join(w + "$$$" for w in prose(i, 80).split()) for i in range(150)]
    texts = [t for pair in zip(good, bad) for t in pair] + [None, "", "x" * 200_000]
    docs = frame(spark, texts + texts[:1], [*range(len(texts)), None])
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(0, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.score_quality(docs, labels).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + 1 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in got if got[i]["held_out"]} == {i for i in [*held, 300, 301, 302] if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(got[i]["predicted"] == 1 - i % 2 for i in held) >= 0.95 * len(held)
    assert {r["score"] for r in quality_model.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.score_quality(docs.limit(0), labels).count() == 0


# 8 -----------------------------------------------------------------------------------------------------------------
def test_licenses_are_found_whole_and_nearly_whole(spark):
    notice = license_scan.TEMPLATES["mit-notice"]
    damaged = notice.replace("granted", "given")
    texts = [None, "", "short", prose(1, 300), f"{prose(2, 77)} {notice} {prose(3, 3000)}", f"{prose(4, 10)}\n{damaged}", "Released under the MIT License.", f"{prose(5, 33)} This work is licensed under the GNU General Public License, version 3. End"]
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(frame(spark, texts + texts[6:7], [*range(len(texts)), None])).collect()}
    assert got == {(4, "mit-notice"), (5, "mit-notice"), (6, "mit"), (None, "mit"), (7, "gpl-3.0")}
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0 and license_scan.scan_licenses(frame(spark, texts), {}).count() == 0


# 9 -----------------------------------------------------------------------------------------------------------------
def test_compact_windows_hold_every_passage_once():
    import numpy as np

    values = np.random.default_rng(1).permutation(60).astype(np.uint64)
    found = passages.compact_windows(values, 10)
    for i in range(60):
        for j in range(i + 9, 60):
            center = i + int(values[i : j + 1].argmin())
            assert sum(left <= i <= c <= j <= right and c == center for left, c, right in found) == 1


def test_repeated_passages_are_found_and_clean_texts_are_not(spark):
    shared, other = prose(1, 60), prose(2, 55).split()
    edited = list(other)
    edited[3] = "edited"
    texts = [prose(10, 80) + " " + shared, prose(11, 7000) + " " + shared + " " + prose(12, 30), prose(13, 300), None, "", prose(14, 40), shared.upper(), " ".join(other) + " " + prose(15, 90), prose(16, 90) + " " + " ".join(edited), prose(17, 60), prose(17, 60)]
    rows = passages.repeated_passages(frame(spark, texts, [*range(len(texts))]).repartition(3)).collect()
    spans = {}
    for r in rows:
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["other_doc_id"]))
    assert set(spans) == {1, 6, 8, 10} and {o for s in spans.values() for *_, o in s} <= {0, 1, 7, 9}
    assert any(s <= 7000 and e >= 7060 for s, e, _ in spans[1]) and max(e - s for s, e, _ in spans[1]) <= 70
    assert (0, 60, 9) in spans[10] and any(s <= 95 and e >= 145 for s, e, _ in spans[8])
    assert passages.repeated_passages(frame(spark, [])).count() == 0
    repeated = passages.repeated_passages(frame(spark, [shared, shared, shared], [None, 5, 5])).collect()
    assert sorted((r["doc_id"], r["other_doc_id"]) for r in repeated) == [(5, None), (5, None)]


def test_every_later_holder_is_reported_whatever_the_order_of_the_files(spark):
    shared = prose(1, 60)
    texts = [f"{prose(100 + i, 40)} {shared} {prose(200 + i, 40)}" for i in range(50)]
    order = random.Random(3).sample(range(50), 50)
    docs = frame(spark, [texts[i] for i in order], order).repartition(5)
    rows = passages.repeated_passages(docs).collect()
    covered = {i: set() for i in range(50)}
    for r in rows:
        assert r["other_doc_id"] < r["doc_id"]
        covered[r["doc_id"]] |= set(range(r["start"], r["end"]))
    assert not covered[0] and all(covered[i] >= set(range(40, 100)) for i in range(1, 50))


def test_an_edit_at_any_place_is_accepted_as_far_as_the_similarity_says():
    import numpy as np

    draw = np.random.default_rng(2)
    for words in (50, 55, 60, 70, 85, 100):
        for edit in range(1, words - 1):
            lead, n = 30, words - 4
            x = draw.integers(1, 1 << 32, lead + n + 40, np.uint32)
            y = np.concatenate([draw.integers(1, 1 << 32, 13, np.uint32), x[lead : lead + n], draw.integers(1, 1 << 32, 20, np.uint32)])
            hit = [k for k in range(max(0, edit - 4), min(n, edit + 1))]  # the shingles that hold the replaced word
            y[[13 + k for k in hit]] = draw.integers(1, 1 << 32, len(hit), np.uint32)
            if hit[0] == 0 or hit[-1] == n - 1:
                continue  # the passage is shorter then
            for center in set(range(n)) - set(hit):
                got = passages.same_passage(x, y, (0, lead + center, len(x) - 1), (0, 13 + center, len(y) - 1), 5, 50, 0.8)
                assert got == [(lead, lead + edit, 13, 13 + edit), (lead + edit + 1, lead + words, 13 + edit + 1, 13 + words)]
    one, two = draw.integers(1, 1 << 32, 300, np.uint32), draw.integers(1, 1 << 32, 300, np.uint32)
    two[100:140], two[5] = one[100:140], one[160]  # 44 words and a match out of order
    assert passages.same_passage(one, two, (0, 120, 299), (0, 120, 299), 5, 50, 0.8) is None


def test_texts_with_a_common_line_are_compared_beyond_its_first_and_last_holders(spark):
    import numpy as np

    from cadastre.llm import shingles

    hashes, seeds = shingles.WordHashes(), itertools.count(50_000)
    values = lambda text: shingles.mix(shingles.windows(hashes.of(shingles.split_words(text)), 5) ^ shingles.mix(np.full(1, 101, np.uint64))[0])
    line = next(p for p in (prose(next(seeds), 49) for _ in range(20_000)) if values(p)[22] < 0.005 * 2**64)  # no passage by itself
    texts = []
    while len(texts) < 12:
        before, after = prose(next(seeds), 20), prose(next(seeds), 20)
        texts += [f"{before} {line} {after}"] * (int(values(f"{before} {line} {after}").argmin()) == 42)
    parts = [t.split(f" {line} ") for t in texts]
    texts[6], texts[7], texts[8] = (f"{b} {line} {a}" for b, a in ((parts[6][0], parts[3][1]), (parts[4][0], parts[7][1]), (parts[4][0], parts[3][1])))
    assert all(int(values(t).argmin()) == 42 for t in texts)  # one window each, with its center amid the line
    covered = {}
    for r in passages.repeated_passages(frame(spark, texts), functions=1).collect():
        assert r["other_doc_id"] < r["doc_id"]
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert covered == {6: set(range(20, 89)), 7: set(range(69)), 8: set(range(89))}


# 10 ----------------------------------------------------------------------------------------------------------------
def test_shards_are_near_equal_and_slots_have_no_gaps(spark):
    hot = prose(1, 50)
    texts = [None, ""] + [hot] * 400 + [prose(i, random.Random(i).randrange(1, 200)) for i in range(800)]
    docs = frame(spark, texts, [None, *range(1, len(texts))])
    rows = sharding.shard_by_bytes(docs).collect()
    assert len(rows) == len(texts)
    sizes, slots = Counter(), {}
    for r in rows:
        text = (texts[r["doc_id"]] if r["doc_id"] is not None else None) or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) < 0.1 * sum(sizes.values()) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_by_bytes(frame(spark, [])).count() == 0
    assert sorted(r["slot"] for r in sharding.shard_by_bytes(frame(spark, ["x"] * 3, [1, 1, 1])).filter("shard is not null").collect()) in ([0, 0, 0], [0, 0, 1], [0, 1, 2])


def test_rows_that_repeat_as_a_whole_are_spread(spark):
    texts = ["same text of some words"] * 1800 + [prose(i, 5) for i in range(200)]
    docs = frame(spark, texts, [7] * 1800 + list(range(200)))
    rows = sharding.shard_by_bytes(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert len(rows) == 2000 and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) < 0.1 * sum(sizes.values()) / 16


def test_texts_of_numerals_have_no_language(spark):
    rows = [(i, "papa mama lala", "aa") for i in range(40)] + [(50, "² ½ ①", None), (51, "Ⅷ", None), (52, "papa²", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs).collect()}
    assert got[50] == got[51] == ("und", 0.0) and got[52][0] == "aa"
    model = language.fit_languages(docs, max_rows=10, id_col="doc_id")
    assert 0 < sum(10 ** -s[0] for s in model.tables[0].values()) and model.languages == ["aa"]  # copies of one text are drawn one by one


def test_the_language_sample_is_bounded_by_bytes_and_keeps_all_its_words(spark):
    docs = spark.createDataFrame([(i, f"palabra{i % 300:03d}".translate(str.maketrans("0123456789", "abcdefghij")) + " ", "aa") for i in range(600)] + [(-1, "zu " * 50_000, "bb")], "id long, text string, lang string")
    whole = language.fit_languages(docs, id_col="id")
    assert len([w for w in whole.tables[0] if w.startswith("palabra")]) == 300 and "zu" in whole.tables[0]
    small = language.fit_languages(docs, id_col="id", max_bytes=2_000)
    assert small.languages == ["aa", "bb"] and 0 < len(small.tables[0]) < 200  # a language's only row stays, however long
