"""Quality classifier: random Fourier features over document statistics, ridge by summed normal equations, isotonic calibration.

Each text gives a fixed list of statistics, standardised by the labelled rows. Random Fourier features
z(x) = sqrt(2 / D) cos(W x + b) approximate a Gaussian kernel. Each partition sums z z' and z y of its labelled rows; the sums of a
few partitions meet on the driver (D x D numbers each) and give the ridge weights. A fifth of the labelled rows stays out
of the fit: their raw scores, counted in fixed bins, are made monotone by pooling adjacent violators.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastre.llm.text import crc_fold, table
from cadastre.session import materialize

STATISTICS = (
    "log_words", "word_length", "word_length_spread", "distinct_share", "top_word_share", "repeat_share", "upper_share", "digit_share", "symbol_share",
    "punctuation_share", "pipe_share", "bang_share", "letter_share", "line_words", "dup_line_share", "entropy",
)
CLASSES = [re.compile(p) for p in (r"[A-Z]", r"[0-9]", r"[#*$%&|<>]", r"[.,;:?!]", r"[|]", r"[!]", r"\s")]
FEATURES, RIDGE, BINS, SEED = 256, 1e-2, 1000, 7


def statistics_of(text: str | None) -> list[float]:
    """The STATISTICS of one text; all zero for a NULL or blank one."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(STATISTICS)
    n, counts = len(words), Counter(words)
    sizes = np.fromiter(map(len, words), float, n)
    upper, digit, symbol, stop, pipe, bang, blank = (len(text) - len(c.sub("", text)) for c in CLASSES)
    chars = max(1, len(text) - blank)
    times = np.fromiter(counts.values(), float, len(counts))
    lines = [x for x in text.split("\n") if x.strip()]
    trigrams = Counter(zip(words, words[1:], words[2:]))
    repeated = sum(c for c in trigrams.values() if c > 1)
    return [
        float(np.log1p(n)), sizes.mean(), sizes.std(), len(counts) / n, times.max() / n, repeated / max(1, n - 2), upper / chars, digit / chars, symbol / chars,
        stop / chars, pipe / chars, bang / chars, 1 - (digit + symbol + stop) / chars, float(np.log1p(n / len(lines))), 1 - len(set(lines)) / len(lines),
        float(-(times / n * np.log(times / n)).sum() / np.log(n + 1)),
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_statistics(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        yield pa.array([statistics_of(t) for t in part.to_pylist()], pa.list_(pa.float64()))


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of raw statistics, and a constant."""
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        z = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, 0, 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def pool_adjacent_violators(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the blocks of the isotonic fit, at the blocks' mean x."""
    blocks: list[list[float]] = []
    for a, t, c in zip(x, total, count):
        blocks.append([a * c, t, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))
    return x, batch.column(1).to_numpy(zero_copy_only=False)


def fit_quality(labelled: DataFrame, max_rows: int = 50_000, partitions: int = 8) -> QualityModel | None:
    """Fit from rows (stats, label 0/1, draw): draw is a number in [0, 1) that does not depend on the label.

    `max_rows` bounds the labelled rows used (those with the lowest draws; about that many). None without any row.
    """
    total = labelled.count()
    if not total:
        return None
    share = min(1.0, max_rows / total)
    used = materialize(labelled.filter(F.col("draw") < share).select("stats", F.col("label").cast("double").alias("label"), (F.col("draw") / share).alias("draw")).repartition(partitions), "labelled")
    each = [F.col("stats")[i] for i in range(len(STATISTICS))]
    moments = used.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).head()
    mean, spread = np.array(moments[: len(each)], float), np.array(moments[len(each) :], float)
    random = np.random.default_rng(SEED)
    blank = QualityModel(
        np.nan_to_num(mean), np.where(spread > 1e-9, spread, 1.0), random.normal(size=(len(each), FEATURES)) / np.sqrt(len(each) / 2), random.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0])
    )
    fit_on = used.filter("draw < 0.8") if total >= 20 else used
    keep_out = used.filter("draw >= 0.8") if total >= 20 else used

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            x, y = _rows(batch)
            z = blank.features(x)
            gram += z.T @ z
            target += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([gram.ravel()], pa.list_(pa.float64())), pa.array([target], pa.list_(pa.float64()))], names=["gram", "target"])

    sums = fit_on.select("stats", "label").coalesce(partitions).mapInArrow(normal_equations, "gram array<double>, target array<double>").collect()  # `partitions` rows
    gram = sum(np.array(r["gram"]) for r in sums).reshape(FEATURES + 1, FEATURES + 1)
    target = sum(np.array(r["target"]) for r in sums)
    n = max(1.0, gram[-1, -1])
    weights = np.linalg.solve(gram + RIDGE * n / FEATURES * np.eye(FEATURES + 1), target)
    raw = QualityModel(**{**blank.__dict__, "weights": weights})

    @F.arrow_udf(T.IntegerType())
    def bin_of(stats: pa.Array) -> pa.Array:
        return pa.array((raw.raw(stats.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))) * BINS).astype(np.int32))

    bins = keep_out.groupBy(bin_of("stats").alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("bin").collect()  # at most BINS + 1
    if not bins:
        return raw
    at, n_in, good = (np.array([r[k] for r in bins], float) for k in ("bin", "n", "good"))
    prior = good.sum() / n_in.sum()
    knots, levels = pool_adjacent_violators((at + 0.5) / BINS, good + prior, n_in + 1)
    return QualityModel(**{**raw.__dict__, "knots": knots, "levels": levels})


def held_out(key: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a NULL id is not held out."""
    return F.coalesce(crc_fold(key, 3) == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Labels are taken from ids that are not held out; NULL labels count as none, several for one id as their mean rounded.
    NULL and empty texts have all-zero statistics and are scored like any other; repeated rows are each scored. Without any label
    every score is 0.5.
    """
    picked = docs.select(F.col(id_col).alias("key"), held_out(F.col(id_col)).alias("held_out"), text_statistics(F.col(text_col)).alias("stats"))
    known = materialize(picked, "statistics")
    marks = labels.select(F.col(id_col).alias("key"), F.col(label_col).alias("label")).filter("label is not null").groupBy("key").agg(F.round(F.avg("label")).alias("label"))
    draw = F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    model = fit_quality(known.filter("not held_out").join(marks, "key").select("stats", "label", draw.alias("draw")))

    @F.arrow_udf(T.DoubleType())
    def score(stats: pa.Array) -> pa.Array:
        x = stats.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
        return pa.array(model.scores(x))

    scored = score("stats") if model else F.lit(0.5)
    return known.select(F.col("key").alias(id_col), "held_out", scored.alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op7_fourier_ridge(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
