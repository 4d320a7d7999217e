"""Texts reach Python in batches of a bounded number, whatever the session's number is; results do not depend on it."""

import random

import corpus_pipeline
import pyarrow as pa

from cadastre import session
from cadastre.llm import packing, set_join

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _sizes(df):
    return [r["n"] for r in session.materialize(df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long"), "sizes").collect()]


def test_batches_are_small_only_inside(spark):
    df, before = spark.range(0, 2500, 1, 1), spark.conf.get(ROWS)
    with session.arrow_rows(spark, 1000):
        assert sorted(_sizes(df)) == [500, 1000, 1000]
    assert spark.conf.get(ROWS) == before and max(_sizes(df)) > 1000


def test_texts_are_packed_from_small_batches(spark, monkeypatch):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["Alpha", "beta", "\u00e9t\u00e9", "x" * 9]) for _ in range(draw.randrange(60))) for _ in range(2300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    seen, encode = [], packing.tokenize

    def tokenize(*args):
        seen.append(spark.conf.get(ROWS))
        return encode(*args)

    monkeypatch.setattr(packing, "tokenize", tokenize)
    rows = packing.concatenate_and_cut(docs, packing.vocabulary()).collect()
    assert seen == [str(packing.TEXTS)] and len({r["doc_id"] for r in rows}) == len(texts)
    line = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert [s * 2048 + o for s, o, _ in line] == [sum(n for *_, n in line[:k]) for k in range(len(line))]
    whole = packing.encoder_of(packing.vocabulary()).whole
    ids = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids.setdefault(r["doc_id"], []).extend(r["ids"])
    assert all(ids[i] == [*whole.encode(texts[i], add_special_tokens=False).ids, 1] for i in range(0, len(texts), 97))


def test_cutting_passages_runs_in_one_set_of_workers(spark):
    """Texts are cut once: a second evaluation for the filter doubles the Python workers of an executor, which stay for a minute."""
    draw = random.Random(5)
    prose = lambda n: " ".join(f"w{draw.randrange(900)}" for _ in range(n))
    shared, whole = prose(60), prose(70)
    texts = [shared + " " + prose(20), prose(20) + " " + shared, whole, whole, None, "few words"]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    cut = corpus_pipeline.cut_repeated_passages(spark, docs, "")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert set(rows) == {0, 1, 2, 4, 5} and rows[0]["text"] == texts[0] and rows[4]["text"] is None
    assert len(rows[1]["text"].split()) == 20 and rows[1]["n_chars"] == len(rows[1]["text"])


def test_whole_sets_of_texts_reach_python_in_small_batches(spark, monkeypatch):
    draw, seen, write = random.Random(6), {}, set_join.materialize
    texts = [" ".join(f"w{draw.randrange(3)}" for _ in range(12)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20])], "doc_id long, text string")

    def materialize(df, label):
        seen.setdefault(label, set()).add(spark.conf.get(ROWS))
        return write(df, label)

    monkeypatch.setattr(set_join, "materialize", materialize)
    rows = {r["doc_id"]: r["component_id"] for r in set_join.jaccard_components(docs, "doc_id", "text", width=4, percent=85).collect()}
    assert all(rows[300 + i] == rows[i] for i in range(20))
    assert all(seen[label] == {str(set_join.TEXTS)} for label in ("sets", "whole", "links", "poor-tokens"))


def test_a_batch_of_texts_is_read_a_few_at_a_time():
    import tracemalloc

    from cadastre.llm import language, text

    texts = [f"{i} " + "word " * 400 if i % 9 else None for i in range(5000)]
    assert list(text.each_value(pa.array(["gone", *texts]).slice(1))) == texts
    batch = pa.RecordBatch.from_arrays([pa.array(["aa"] * len(texts)), pa.array([t or "" for t in texts])], ["lang", "text"])
    del texts
    tracemalloc.start()
    (found,) = language._count(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < batch.nbytes // 2 and dict(zip(found["word"].to_pylist(), found["n"].to_pylist()))["word"] == 400 * (5000 - 556)


def test_languages_are_told_from_small_batches(spark, monkeypatch):
    seen, write = {}, corpus_pipeline.materialize

    def materialize(df, label):
        seen[label] = spark.conf.get(ROWS)
        return write(df, label)

    monkeypatch.setattr(corpus_pipeline, "materialize", materialize)
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("una mala lana", "aa"), ("qixy zuwo joxy", "bb")] * 20)] + [(90, None, "aa")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.keep_known_languages(spark, docs, "")
    assert seen["known"] == "1000" and kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(40))
