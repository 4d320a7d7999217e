"""Source divergence against plain arithmetic over all terms and pairs, with leaves of a few cells."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from cadastre.llm import divergence, numbering

SCHEMA = "doc_id long, text string, lang string, source string, term string, row int, value int, part string"
SCALE = 10**9


def plain(rows, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in rows):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    kept = {lang: [t for t, n in c.items() if n >= 3] for lang, c in docs.items()}
    share = {}
    for lang, source in groups:
        terms = kept.get(lang, [])
        total = sum(counts[lang, source][t] for t in terms)
        share[lang, source] = {t: 1 + SCALE * (counts[lang, source][t] + 1) // (total + len(terms)) for t in terms}
    out = []
    for lang, source in groups:
        p = share[lang, source]
        pairs = [(-sum((p[t] - q) ** 2 // q for t, q in share[lang, o].items()), o.encode()) for g, o in groups if g == lang and o != source]
        every = {t: sum(counts[lang, o][t] for g, o in groups if g == lang) for t in p}
        q = {t: 1 + SCALE * (n + 1) // (sum(every.values()) + len(p)) for t, n in every.items()}
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in p if counts[lang, source][t] > 0 and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            out += [(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(found)) if part == "pair" or k < top]
    return sorted(out)


def corpus(seed):
    draw = random.Random(seed)
    rows = [(None, None, None), ("", "aa", ""), ("12 --", "aa", "none"), ("once", "solo", "s"), ("Été ÉTÉ été_x日本 Z", "aa", "s1"), ("same same", "zz", "a"), ("same", "zz", "b"), ("same", "zz", "c"), ("y" * 60_000, "aa", "s2")]
    for i in range(160):
        source = f"s{draw.choice([0, 0, 0, *range(14)])}"
        words = [f"w{'abcdefghij'[draw.randrange(10)]}{'xyz'[hash(source) % 2 if draw.random() < 0.5 else 2]}{draw.choice(['', source[1:].translate(str.maketrans('0123456789', 'klmnopqrst'))])}" for _ in range(draw.randrange(60))]
        rows.append((draw.choice([" ", "1", "\n"]).join(words), draw.choice(["aa", "aa", "bb", None]), source if i % 17 else None))
    return rows + rows[-1:]


@pytest.mark.parametrize(("rows", "cols", "chunk", "top"), [(32, 4096, 4096, 200), (2, 8, 3, 4)])
def test_values_equal_plain_arithmetic(spark, monkeypatch, rows, cols, chunk, top):
    for name, value in (("ROWS", rows), ("COLS", cols), ("CHUNK", chunk)):
        monkeypatch.setattr(divergence, name, value)
    data = corpus(rows)
    docs = spark.createDataFrame([(i, t, g, s, "t", 1, 2, "p") for i, (t, g, s) in enumerate(data)], SCHEMA).repartition(3)
    got = divergence.divergence(docs, top=top)
    assert sorted(map(tuple, got.collect())) == plain(data, top)


def test_languages_without_terms_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "aa", s, "t", 1, 2, "p") for s in ("x", None, "y")] + [(1, None, "aa", "x", "t", 1, 2, "p")], SCHEMA)
    docs = docs.filter("source IS NULL OR source <> 'y'")  # a and b are in two documents each
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == [("aa", "", "pair", "x", 0, 1), ("aa", "x", "pair", "", 0, 1)]
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_shares_pass_64_bits(spark):
    row = spark.createDataFrame([(7 * 10**12, 9 * 10**12, 3 * 10**9)], "c long, n long, v long")
    assert row.select(divergence._share("c", "n", "v")).head()[0] == 1 + SCALE * (7 * 10**12 + 1) // (9 * 10**12 + 3 * 10**9)


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 AS x")
    got, n = numbering.numbered(rows, ["x"], "k", "test")
    assert n == 1000 and all(r["k"] == r["x"] for r in got.collect())
    assert numbering.numbered(rows.limit(0), ["x"], "k", "test")[1] == 0


def test_a_task_sends_each_of_many_terms_once():
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    texts = [" ".join(map(word, range(k, k + 2_000))) for k in range(0, 400_000, 2_000)] * 2
    batch = pa.RecordBatch.from_pydict({"lang": ["aa"] * len(texts), "source": ["s"] * len(texts), "text": texts})
    sent = pa.Table.from_batches(list(divergence._counted(iter([batch]))))
    assert sent.num_rows == 400_000 and set(sent["count"].to_pylist()) == set(sent["docs"].to_pylist()) == {2}
