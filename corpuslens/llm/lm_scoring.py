"""Operator 3: a bigram language model by deleted interpolation.

Training documents are split by a checksum of their id: retained documents give counts, deleted ones give the mixture
weights by expectation-maximisation, one weight vector per bucket of the context's frequency (powers of two). The final
model uses the counts of both with those weights:

    P(w | h) = a2[b] c(h, w) / c(h) + a1[b] c(w) / N + a0[b] / (V + 1),   b = bucket of c(h)

Documents are dealt into blocks of about BLOCK characters. A block sends each of its distinct n-grams once (64-bit key and
count, sorted, grouped by key range) to the range's owner and gets back the corpus-wide counts in the same order, so a
frequent n-gram costs one entry per block, never one per occurrence, and no count table is broadcast or collected. Ranges
follow the number of blocks, so an owner's share stays as large as a block; rows never outnumber a block's n-grams.
Only a histogram of quantised component probabilities (a fixed number of cells) reaches the driver.

Defined results: null text is empty and has the end token alone; null doc_id is a training document; equal rows are all
counted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import remainder, stored, table

#: Characters of text in a block, and in the part of all n-grams that one owner counts.
BLOCK = 5_000_000
RETAINED, DELETED, HELD_OUT = 0, 1, 2
BUCKETS = 24
#: Steps of the quantised probabilities for each factor of two, and their number.
FINE, CELLS = 4, 256

_MASK = np.uint64(0xFFFFFFFFFFFFFFFC)
_START = np.uint64(0x9E3779B97F4A7C14)  # low two bits: order of the n-gram, 0 for the start mark
_END = np.uint64(xxhash.xxh64_intdigest(b" ")) & _MASK | np.uint64(1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) & _MASK | np.uint64(2)


class Grams:
    """The n-grams of a block: a word's key for each place, start marks included, and a bigram's for each token."""

    def __init__(self, texts: list[bytes]):
        split = [t.lower().split() for t in texts]
        self.lengths = np.array([len(s) + 1 for s in split], np.int64)
        codes, distinct = pd.factorize(np.array(list(chain.from_iterable(split)) or [b"-"], dtype=object))
        hashed = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64) & _MASK | np.uint64(1)
        starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        one = np.empty(starts[-1], np.uint64)
        word = np.ones(len(one), bool)
        word[starts[:-1]] = word[starts[1:] - 1] = False
        one[word] = hashed[codes[: word.sum()]]
        one[starts[:-1]], one[starts[1:] - 1] = _START, _END
        token = np.ones(len(one), bool)
        token[starts[:-1]] = False
        at = np.flatnonzero(token)
        two = _mix(one[at - 1], one[at])
        self._all = one, two, at

    def unique(self) -> tuple[np.ndarray, np.ndarray]:
        one, two, _ = self._all
        return np.unique(np.concatenate([one, two]), return_counts=True)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token's context, word and bigram among the unique keys."""
        one, two, at = self._all
        _, inverse = np.unique(np.concatenate([one, two]), return_inverse=True)
        first = inverse[: len(one)]
        return first[at - 1], first[at], inverse[len(one) :]

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, np.concatenate([[0], np.cumsum(self.lengths)[:-1]])) if len(self.lengths) else values[:0]


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of whole numbers, which the shuffle's compressor shortens well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _sent(bits: int):
    def send(batch: pa.Table) -> pa.Table:
        keys, counts = Grams(_texts(batch.column("text"))).unique()
        block, role = batch.column("block")[0].as_py(), batch.column("role")[0].as_py()
        ends = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(keys)])
        rows = [(r, block, role, _planes(np.diff(keys[a:b], prepend=np.uint64(0))), _planes(counts[a:b].astype("<u4"))) for r, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
        return pa.table(list(map(list, zip(*rows, strict=True))), schema=pa.schema([("range", pa.int32()), ("block", pa.int32()), ("role", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return send


_COUNTED = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("total", pa.binary()), ("retained", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64()), ("retained_tokens", pa.int64())])


def _counted(batch: pa.Table) -> pa.Table:
    """Sums of a key range over all blocks, sent back to each block in the order of its own keys."""
    keys = [np.cumsum(_numbers(k, "<u8"), dtype=np.uint64) for k in batch.column("keys").to_pylist()]
    counts = np.concatenate([_numbers(c, "<u4") for c in batch.column("counts").to_pylist()]).astype(float)
    role = np.repeat(batch.column("role").to_numpy(), [len(k) for k in keys])
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, counts * (role != HELD_OUT))
    retained = np.bincount(inverse, counts * (role == RETAINED))
    one = (unique & np.uint64(3)) == 1
    ends = np.cumsum([len(k) for k in keys])[:-1]
    back = [[_planes(x.astype("<u8")) for x in np.split(of[inverse], ends)] for of in (total, retained)]  # a block's counts fit 32 bits, the corpus's may not
    once = lambda x: [int(x), *[0] * (len(keys) - 1)]
    return pa.table([batch.column("range").combine_chunks(), batch.column("block").combine_chunks(), *back, once((one & (total > 0)).sum()), once(total[one].sum()), once(retained[one].sum())], schema=_COUNTED)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def _cell(p: np.ndarray) -> np.ndarray:
    """0 for p = 0, else 1 + steps below 1."""
    return np.where(p > 0, np.minimum(1 + np.round(-FINE * np.log2(np.where(p > 0, p, 1))), CELLS - 1), 0).astype(np.int64)


def learn_weights(cells: np.ndarray, n: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation on a histogram: cells has bucket, cell of the bigram's and of the unigram's probability."""
    weights = np.tile([0.1, 0.3, 0.6], (BUCKETS, 1))
    p = np.stack([np.full(len(n), uniform), *(np.where(c > 0, 2.0 ** (-(c - 1) / FINE), 0) for c in (cells[:, 2], cells[:, 1]))], axis=1)
    for _ in range(rounds):
        share = weights[cells[:, 0]] * p
        share *= (n / share.sum(1))[:, None]
        sums = np.stack([np.bincount(cells[:, 0], share[:, k], minlength=BUCKETS) for k in range(3)], axis=1) + np.array([0.01, 0.01, 0.01])
        weights = sums / sums.sum(1, keepdims=True)
    weights[0, :2] += weights[0, 2] / 2  # an unseen context has no bigram
    weights[0, 2] = 0
    return weights


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, deleted: int = 0, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts."""
    spark = docs.sparkSession
    fold = remainder(F.col(id_col), folds)
    role = F.when(fold == held_out, HELD_OUT).when(fold == deleted, DELETED).otherwise(RETAINED)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), role.alias("role"))
    size = {r.role: max(1, -(-int(r.n or 0) // block)) for r in docs.groupBy("role").agg(F.sum(F.length("text")).alias("n")).collect()}
    of = F.create_map(*(F.lit(x) for r in (RETAINED, DELETED, HELD_OUT) for x in (r, size.get(r, 1))))
    docs = docs.withColumn("block", (F.pmod(F.xxhash64("doc_id", "text"), of[F.col("role")]) * 3 + F.col("role")).cast("int"))
    bits = max(0, (sum(size.values()) - 1).bit_length())
    sent = docs.groupBy("block").applyInArrow(_sent(bits), "range int, block int, role int, keys binary, counts binary")
    counts = stored(sent.groupBy("range").applyInArrow(_counted, "range int, block int, total binary, retained binary, types long, tokens long, retained_tokens long"), "ngrams")
    sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", "retained_tokens"))).first()
    uniform, tokens, kept = 1 / (sums.types + 1), max(1, sums.tokens), max(1, sums.retained_tokens)

    def aligned(right: pa.Table, column: str) -> np.ndarray:
        right = right.sort_by("range")
        return np.concatenate([_numbers(x, "<u8") for x in right.column(column).to_pylist()]).astype(float)

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([[], []], schema=pa.schema([("cell", pa.int64()), ("n", pa.int64())]))
        n = aligned(right, "retained")
        context, word, pair = (n[x] for x in Grams(_texts(left.column("text"))).places())
        cell = (_bucket(context) * CELLS + _cell(pair / np.maximum(context, 1))) * CELLS + _cell(word / kept)
        found, many = np.unique(cell, return_counts=True)
        return pa.table([found, many.astype(np.int64)], schema=pa.schema([("cell", pa.int64()), ("n", pa.int64())]))

    given = counts.select("range", "block", "total", "retained")
    of_deleted = given.where(F.col("block") % 3 == DELETED).drop("total").groupBy("block")
    histogram = docs.where(F.col("role") == DELETED).groupBy("block").cogroup(of_deleted).applyInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = np.tile([0.1, 0.3, 0.6], (BUCKETS, 1))
    if len(histogram):
        c = histogram.cell.to_numpy()
        weights = learn_weights(np.stack([c // CELLS // CELLS, c // CELLS % CELLS, c % CELLS], axis=1), histogram.n.to_numpy(float), uniform)
    shared = spark.sparkContext.broadcast(weights)
    types, trained = sums.types, sums.tokens

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not left.num_rows:
            return schema.empty_table()
        grams, n = Grams(_texts(left.column("text"))), aligned(right, "total")
        context, word, pair = (n[x] for x in grams.places())
        a = shared.value[_bucket(context)]
        p = a[:, 0] * uniform + a[:, 1] * word / tokens + a[:, 2] * pair / np.maximum(context, 1)
        base = np.log10((word + 0.5) / (trained + 0.5 * (types + 1)))
        out = grams.lengths.astype(np.int64), grams.sums((word > 0).astype(np.int64)), np.full(len(grams.lengths), trained), grams.sums(base), grams.sums(np.log10(p))
        role = left.column("role").to_numpy()
        return pa.table([left.column("doc_id").combine_chunks(), pa.array(role == HELD_OUT), *map(pa.array, out)], schema=schema)

    return docs.groupBy("block").cogroup(given.drop("retained").groupBy("block")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
