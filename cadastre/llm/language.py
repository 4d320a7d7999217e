"""Language identification, words first: known words are scored by their log frequency in each language,
unseen ones by their longest known character n-grams.

A word that some language knows scores -log10 of its relative frequency there, and a fixed penalty in
languages that lack it. A word that none knows is scored by the mean over those of its n-grams (padded
with a space) that some language knows, trying 5 characters first, then 4, 3, 2 and 1; if nothing is known it is
skipped. A document's score in a language is the mean over its words, and the lowest score wins.

The model is fitted on about `max_rows` labelled rows and `max_bytes` of text, chosen by a hash, so that it stays
small at any size of the corpus; languages share this bound evenly, and those with fewer rows than their share give all. Every row is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.llm.text import crc_fold, each_value, table
from cadastre.session import materialize

LONGEST = 5
LETTERS = re.compile(r"[^\W\d_]+")
CACHE = 100_000  # words outside the model whose scores a worker keeps at once
PENALTY = 7.0  # of a feature that a language lacks, as -log10 of a frequency


@dataclass(frozen=True)
class LanguageModel:
    """languages; number of characters (0 for words) -> feature -> its row among the scores of that number, a column for each language. `kept` is what one worker has met."""

    languages: list[str]
    rows: dict[int, dict[str, int]]
    scores: dict[int, np.ndarray]
    kept: dict = field(default_factory=dict)

    @property
    def tables(self) -> dict[int, dict[str, tuple[float, ...]]]:
        """number of characters -> feature -> its score in each language."""
        return {n: {f: tuple(self.scores[n][at].tolist()) for f, at in found.items()} for n, found in self.rows.items()}

    def memory(self) -> tuple[dict[str, int], np.ndarray]:
        """Other words and their rows in a table that begins with the model's words; its last column tells whether anything is known of the word."""
        if not self.kept:
            values = np.zeros((len(self.rows[0]) + CACHE, len(self.languages) + 1))
            values[: len(self.rows[0])] = np.c_[self.scores[0], np.ones(len(self.rows[0]))]
            self.kept.update(rows={}, values=values)
        return self.kept["rows"], self.kept["values"]

    def unseen(self, word: str) -> np.ndarray | None:
        """Mean scores of the longest known n-grams of a word that is not in the model."""
        padded = f" {word} "
        for n in range(LONGEST, 0, -1):
            known = self.rows[n]
            found = [at for i in range(len(padded) - n + 1) if (at := known.get(padded[i : i + n])) is not None]
            if found:
                return self.scores[n][found].sum(axis=0) / len(found)
        return None


def has_letter(words: list[str]) -> bool:
    """Whether any word has a letter: LETTERS also finds numerals that are not decimal digits."""
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each batch."""
    for batch in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), each_value(batch.column(1))):
            found.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        rows = [(lang, w, n) for lang, counts in found.items() for w, n in counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"]
        )


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) -> (lang, gram, n) of each batch, 1 to LONGEST characters of the padded word."""
    for batch in batches:
        found: dict[str, Counter] = {}
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            counts, padded = found.setdefault(lang, Counter()), f" {word} "
            for size in range(1, LONGEST + 1):
                for i in range(len(padded) - size + 1):
                    counts[padded[i : i + size]] += n
        rows = [(lang, g, n) for lang, counts in found.items() for g, n in counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "gram", "n"]
        )


def _even_share(sizes: list[int], total: int) -> float:
    """The most rows a group may give so that all give `total` at most; groups with fewer give all, but none less than one row."""
    left = total
    for k, size in enumerate(sorted(sizes)):
        share = left / (len(sizes) - k)
        if size > share:
            return max(1.0, share)
        left -= size
    return float(max(sizes, default=1))


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = 10_000, least_count: int = 2, max_words: int | None = None, id_col: str | None = None, max_bytes: int = 64 << 20) -> LanguageModel:
    """Word and n-gram log frequencies of each language.

    `max_rows` and `max_bytes` bound the labelled rows used and their texts (a hash of the text and, if given, the id picks them, so copies are drawn one by one;
    about that many), both shared evenly by the languages; a row of each language is always wanted. Words seen less than `least_count` times only count through their
    n-grams, which are counted over all words of these rows. No word of these rows is left out otherwise, unless a caller sets `max_words` for each language:
    then the least count that fits is raised where more are left.
    """
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), (F.col(id_col) if id_col else F.lit(0)).cast("string").alias("id")).filter("lang is not null and text is not null")
    volumes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    sizes, lengths = {r["lang"]: r["n"] for r in volumes}, {r["lang"]: r["size"] for r in volumes}
    if not sizes:
        return _model([], {n: {} for n in range(LONGEST + 1)})
    share, room = _even_share(list(sizes.values()), max_rows), _even_share(list(lengths.values()), max_bytes)
    below = {lang: int(min(1.0, share / n, max(1 / n, room / max(1, lengths[lang]))) * (1 << 40)) for lang, n in sizes.items()}
    roof = F.element_at(F.create_map(*[F.lit(x) for pair in below.items() for x in pair]), F.col("lang"))
    picked = labelled.filter(F.pmod(F.xxhash64("text", "id", F.lit("fit")), F.lit(1 << 40)) < roof).select("lang", "text")
    counted = picked.mapInArrow(_count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "words")
    per = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum((F.col("n") >= least_count).cast("long")).alias("n")).collect()}
    languages = sorted(per)
    if not languages:
        return _model([], {n: {} for n in range(LONGEST + 1)})
    least = dict.fromkeys(languages, least_count)
    crowded = [lang for lang in languages if max_words is not None and per[lang] > max_words]
    if crowded:
        steps = counted.filter(F.col("lang").isin(crowded) & (F.col("n") >= least_count)).groupBy("lang", "n").agg(F.count("*").alias("c")).collect()
        for lang in crowded:
            total = 0
            for n, c in sorted(((r["n"], r["c"]) for r in steps if r["lang"] == lang), reverse=True):
                total += c
                if total > max_words:
                    least[lang] = n + 1
                    break
    enough = F.element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("lang"))
    words = counted.filter(F.col("n") >= enough).select("lang", F.col("word").alias("feature"), "n")
    grams = counted.mapInArrow(_grams, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumnRenamed("gram", "feature")
    at = {name: i for i, name in enumerate(languages)}
    features: dict[int, dict[str, list[int]]] = {n: {} for n in range(LONGEST + 1)}
    for frame, is_word in ((words, True), (grams, False)):
        known = frame.groupBy("feature").agg(F.collect_list(F.struct("lang", "n")).alias("found"), F.sum("n").alias("all"))
        for batch in known.filter(F.col("all") >= least_count).select("feature", "found.lang", "found.n").toArrow().to_batches():
            for feature, langs, counts in zip(*(c.to_pylist() for c in batch.columns)):
                row = features[0 if is_word else len(feature)][feature] = [0] * len(languages)
                for lang, n in zip(langs, counts):
                    row[at[lang]] = n
    return _model(languages, features)


def _model(languages: list[str], features: dict[int, dict[str, list[int]]]) -> LanguageModel:
    """Counts of each feature in each language as -log10 of its share there."""
    scores = {}
    for n, kept in features.items():
        counts = np.array(list(kept.values()), np.float64).reshape(len(kept), len(languages))
        shares = np.divide(counts, counts.sum(axis=0), out=np.zeros_like(counts), where=counts > 0)
        scores[n] = np.full(counts.shape, PENALTY)
        np.negative(np.log10(shares, where=counts > 0, out=np.zeros_like(counts)), where=counts > 0, out=scores[n])
    return LanguageModel(languages, {n: {f: i for i, f in enumerate(kept)} for n, kept in features.items()}, scores)


def language_of(model: LanguageModel, spark) -> callable:
    """A function text -> struct(lang_pred, score), for use as a column.

    `und` with score 0: NULL text, a text without letters, or a model without languages. A text of which no word and no
    n-gram is known gets the first language with score 1 / languages. The score is the share of the winner in the
    likelihood of up to ten words at the document's mean; ties go to the first language in order.
    """
    shared = spark.sparkContext.broadcast(model)  # bounded by fit_languages' max_rows and max_bytes

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted: LanguageModel = shared.value
        width = len(fitted.languages)
        known, (others, values) = fitted.rows[0], fitted.memory()
        for part in parts:
            names, scores = [], []
            for text in each_value(part):
                found = LETTERS.findall(text.lower()) if text and width else []
                if not has_letter(found):
                    names.append("und")
                    scores.append(0.0)
                    continue
                total = np.zeros(width + 1)
                for begin in range(0, len(found), 10_000):
                    some = found[begin : begin + 10_000]
                    kinds = dict.fromkeys(some)
                    if len(others) + len(kinds) > CACHE:
                        others.clear()
                    for w in kinds:
                        at = known.get(w)
                        if at is None:
                            at = others.get(w)
                        if at is None:
                            at = others[w] = len(known) + len(others)
                            one = fitted.unseen(w)
                            values[at] = 0 if one is None else [*one, 1]
                        kinds[w] = at
                    total += values[[kinds[w] for w in some]].sum(axis=0)
                if not total[width]:
                    names.append(fitted.languages[0])
                    scores.append(1.0 / width)
                    continue
                mean = total[:width] / total[width]
                best = int(mean.argmin())
                names.append(fitted.languages[best])
                scores.append(float(1 / (10 ** ((mean[best] - mean) * min(10, total[width]))).sum()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predict


def held_out(key: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a NULL id is not held out."""
    return F.coalesce(crc_fold(key, 4) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score; learns from rows with a language that are not held out."""
    model = fit_languages(docs.filter(~held_out(F.col(id_col))), text_col, lang_col, id_col=id_col)
    guess = language_of(model, docs.sparkSession)(F.col(text_col)).alias("guess")
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), guess).select(id_col, "held_out", "guess.lang_pred", "guess.score")


def op3_word_backoff(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
