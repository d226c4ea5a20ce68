"""Operator 7: a quality classifier from trusted positives and unlabelled text (positive-unlabelled learning).

Features are counts over words and lines, and shares of hashed word shapes and of hashed words. The class prior is estimated
by the best bin of first positive-against-unlabelled classifiers (the least ratio of unlabelled to positive rows above a
score, with a confidence term): ids fall into halves by hash, each half's sample fits a classifier, and it ranks every
document of the other half, whose ranks are added up as a histogram; the prior is the mean of both. Then a linear model
minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

Fitting uses bounded samples, POSITIVES and UNLABELLED documents with the smallest hashes of their ids; their feature rows
are stored and meet in one task. The prior rests on all unlabelled documents and all positives. The models and the
histograms of BINS bins alone reach the driver. All documents are scored.

Defined results: null texts count as empty and are scored like any text; rows with null id are never used to learn; with
fewer than two sampled positives or unlabelled texts in a half all scores are 0.5; equal texts have equal scores; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import discard, remainder, smallest, stored, table

#: Bounds of the samples, in documents.
POSITIVES, UNLABELLED = 8_000, 16_000
#: Buckets of word shapes and of words.
SHAPES, WORDS = 64, 256
#: Bins of the histograms behind the class prior.
BINS = 4096
#: Shrinkage of weights, and of those of word buckets, which are many.
DECAY, WORD_DECAY = 1e-4, 1e-2
_DENSE = 14
WIDTH = 2 * _DENSE + SHAPES + WORDS

#: A word's shape: runs of digits, of capitals and of other letters as one character each.
_SHAPE = ((r"\p{Nd}+", "9"), (r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "a"))


def _of_words(words: pa.Array) -> np.ndarray:
    """Of distinct words: length, flags, and the buckets of their shapes and of themselves."""
    words = words.cast(pa.large_string())
    length = pc.utf8_length(words).to_numpy()
    has = lambda pattern: pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)
    shape = words
    for pattern, by in _SHAPE:
        shape = pc.replace_substring_regex(shape, pattern, by)
    shape = shape.dictionary_encode()
    buckets = np.array([zlib.crc32(x.encode()) % SHAPES for x in shape.dictionary.to_pylist()], int)[shape.indices.to_numpy()]
    own = [zlib.crc32(x) % WORDS for x in pc.utf8_lower(words).cast(pa.large_binary()).to_pylist()]
    shouted = pc.utf8_is_upper(words).to_numpy(zero_copy_only=False) & (length > 1)
    return np.column_stack([length, has(r"[#*$%&|<>]"), pc.ends_with(words, "!!").to_numpy(zero_copy_only=False), shouted, has(r"\p{Nd}"), has(r"[.!?]$"), ~has(r"[\p{L}\p{N}]"), buckets, np.array(own, int)]).astype(float)


def features(texts: pa.Array) -> np.ndarray:
    """A row for each text."""
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    n, distinct = len(texts), words.dictionary
    of = _of_words(distinct)
    code = words.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
    full = of[code, 0] > 0  # no word comes from the ends of a text
    code, doc = code[full], doc[full]
    many = np.bincount(doc, minlength=n)
    at_least = np.maximum(many, 1)
    sums = np.stack([np.bincount(doc, of[code, k], minlength=n) for k in range(7)], axis=1) / at_least[:, None]
    pairs, times = np.unique(doc * max(1, len(distinct)) + code, return_counts=True)
    owner = pairs // max(1, len(distinct))
    most = np.zeros(n)
    np.maximum.at(most, owner, times)
    same = np.bincount(doc[1:], (code[1:] == code[:-1]) & (doc[1:] == doc[:-1]), minlength=n) if len(doc) > 1 else np.zeros(n)
    lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False)
    dense = np.column_stack([np.log1p(many), many < 20, sums, np.bincount(owner, minlength=n) / at_least, most / at_least, same / at_least, np.minimum(lines / at_least, 1), many == 0])
    shares = [np.bincount(doc * size + of[code, k].astype(np.int64), minlength=n * size).reshape(n, size) for k, size in ((7, SHAPES), (8, WORDS))]
    return np.column_stack([dense, dense**2, *(np.sqrt(x / at_least[:, None]) for x in shares)])


class Linear:
    """Scaled features, weights and bias."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale, self.weight, self.bias = mean, scale, np.zeros(len(mean)), 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float | None) -> np.ndarray:
    """Of the non-negative risk with the logistic loss: where its second part is below zero, the step that raises this part
    again. Without a prior, of plain positive against unlabelled."""
    w = w.astype(p.dtype)
    zp, zu = p @ w, u @ w
    sp, su = _sigmoid(zp), _sigmoid(zu)
    up = p.T @ (sp - 1) / len(p)  # gradient of R+ on positives
    down_p, down_u = p.T @ sp / len(p), u.T @ su / len(u)  # of R-
    if prior is None:
        return up + down_u
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return prior * up + (down_u - prior * down_p) if negative >= 0 else prior * down_p - down_u


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, rounds: int = 400, rate: float = 0.05) -> Linear:
    """Full-batch Adam."""
    both = np.concatenate([positive, unlabelled])
    model = Linear(both.mean(0), both.std(0) + 1e-6)
    p, u = (np.column_stack([np.clip((x - model.mean) / model.scale, -8, 8), np.ones(len(x))]).astype(np.float32) for x in (positive, unlabelled))
    w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    decay = np.full(p.shape[1], DECAY)
    if p.shape[1] == WIDTH + 1:
        decay[WIDTH - WORDS : WIDTH] = WORD_DECAY
    for t in range(1, rounds + 1):
        g = risk_gradient(w, p, u, prior) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weight, model.bias = w[:-1], float(w[-1])
    return model


def bins(margin: np.ndarray) -> np.ndarray:
    return ((np.tanh(margin / 8) + 1) / 2 * (BINS - 1)).astype(np.int32)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from the numbers of positive and of unlabelled rows in each bin, least scores first."""
    p, u = positive[::-1].cumsum()[::-1], unlabelled[::-1].cumsum()[::-1]  # rows of a bin or more
    slack = np.sqrt(np.log(4 / 0.1) / (2 * u[0])) + np.sqrt(np.log(4 / 0.1) / (2 * p[0]))
    at = np.flatnonzero(p)
    above_p, above_u = p[at] / p[0], u[at] / u[0]
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def _model(row) -> Linear:
    model = Linear(np.array(row.mean), np.array(row.scale))
    model.weight, model.bias = np.array(row.weight), row.bias
    return model


_MODEL = pa.schema([("half", pa.int32()), *((c, pa.list_(pa.float64())) for c in ("mean", "scale", "weight")), ("bias", pa.float64())])


def _fitted(rows: DataFrame, prior: float | None) -> list:
    """rows: half, known, x of the bounded samples. Without a prior a model for each half, else one for all."""

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("known", "ascending"), ("doc_id", "ascending")])
        half, known, x = rows.column("half")[0].as_py(), rows.column("known").to_numpy(), rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).astype(float)
        p, u = x[known == 1], x[known == 0]
        made = [] if len(p) < 2 or len(u) < 2 else [_fit(p, u, prior)]
        return pa.table([[half] * len(made), *([list(map(float, getattr(m, c))) for m in made] for c in ("mean", "scale", "weight")), [float(m.bias) for m in made]], schema=_MODEL)

    return rows.groupBy(*(["half"] if prior is None else [])).applyInArrow(fit, "half int, mean array<double>, scale array<double>, weight array<double>, bias double").collect()


def class_prior(docs: DataFrame, positive: DataFrame, models: dict[int, Linear]) -> float:
    """docs: doc_id, half, text, all ranked by the model of the other half; positive: distinct doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                x, half = features(some.column("text")), some.column("half").to_numpy()
                bin_ = np.where(half == 0, bins(shared.value[1].margin(x)), bins(shared.value[0].margin(x)))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("half"), pa.array(bin_, pa.int32())], names=["doc_id", "half", "bin"])

    ranked = docs.mapInArrow(run, "doc_id long, half int, bin int").join(positive.withColumn("known", F.lit(1)), "doc_id", "left")
    found = ranked.groupBy("half", "bin").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("p")).collect()  # at most 2 BINS rows
    counts = np.zeros((2, 2, BINS))
    for r in found:
        counts[r.half, :, r.bin] = r.p, r.n
    return float(np.mean([best_bin(*counts[h]) for h in (0, 1)]))


def learn(docs: DataFrame, positive: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Linear | None, float]:
    """The model and the class prior. docs: unlabelled text; positive: the ids of trusted positives among them."""
    half = F.pmod(F.xxhash64(F.lit("half"), F.col(id_col).cast("long")), F.lit(2)).cast("int")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), half.alias("half"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    positive = positive.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    trusted = docs.select("doc_id").join(positive, "doc_id", "left_semi")
    samples = smallest(trusted, "doc_id", positives).select("doc_id", F.lit(1).alias("known")).union(smallest(docs.select("doc_id"), "doc_id", unlabelled).select("doc_id", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([*map(some.column, ("doc_id", "half", "known")), pa.array(list(features(some.column("text")).astype(np.float32)), pa.list_(pa.float32()))], names=["doc_id", "half", "known", "x"])

    # the samples are bounded by their parameters
    rows = stored(docs.join(F.broadcast(samples), "doc_id").select("doc_id", "half", "known", "text").mapInArrow(run, "doc_id long, half int, known int, x array<float>"), "samples")
    models, model, prior = {r.half: _model(r) for r in _fitted(rows, None)}, None, 0.5
    if len(models) == 2:
        prior = class_prior(docs, positive, models)
        model = _model(_fitted(rows, prior)[0])
    discard(rows)
    return model, prior


def score(docs: DataFrame, model: Linear | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                x = features(some.column("text"))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(shared.value.score(x) if shared.value else np.full(len(x), 0.5))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model, _ = learn(docs.where(~held_out), labels.where(~held_out & (F.col("quality") == 1)))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
