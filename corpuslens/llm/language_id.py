"""Operator 4: language identification with bit-sliced Bloom filters over character n-grams.

Each language contributes the n-grams that are frequent in its training text. All languages share one table of slots; a
slot holds one bit per language, so that the bitwise and of an n-gram's slots is the set of all languages that contain it.
A text's hits are counted per language, corrected for that language's false-positive rate, and the highest count decides.

An n-gram is kept for a language if it makes up MIN_RATE of the language's n-grams, so a language has at most 1 / MIN_RATE
of them: what reaches the driver and is broadcast has a fixed bound.

Defined results: null texts and texts without a letter are `und` with score 0; a text whose n-grams no language contains
gets the language with most training text, score 0; ties go to the first language in order; null doc_id counts as
training; an empty table gives an empty result, no labelled training text gives `und` for all; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import remainder, table

LONGEST = 4
MIN_RATE = 1e-5
SLOTS, PROBES = 1 << 21, 3
#: Distinct words looked at together.
CHUNK = 100_000

_LETTER: list = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)]))
    return _LETTER[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the token and hash of every n-gram of 1 to LONGEST characters; runs of letters have a mark at either end."""
    code = np.frombuffer(("\n" + "\n".join(tokens) + "\n").encode("utf-32-le"), np.uint32)
    owner = np.cumsum(code == 10) - 1
    letter = _letters()[code]
    char = np.where(letter, code, 1).astype(np.uint64)
    inside, h, owners, found = letter.copy(), np.zeros(len(code), np.uint64), [], []
    for n in range(1, LONGEST + 1):
        size = len(code) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(0x100000001B3) + char[n - 1 :]
        if n == 1:
            ok = letter
        elif n == 2:
            ok = letter[:-1] | letter[1:]
        else:
            inside = letter[1:size + 1] if n == 3 else inside[:size] & letter[n - 2 : n - 2 + size]
            ok = inside
        at = np.flatnonzero(ok)
        found.append(_mixed(h[at] + np.uint64(n)))
        owners.append(owner[np.where(letter[at], at, at + 1)])
    return np.concatenate(owners), np.concatenate(found)


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Document and distinct-token index of each token, and the distinct tokens."""
    split = [(t or "").lower().split() for t in texts]
    flat = [w for s in split for w in s]
    codes, distinct = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
    return np.repeat(np.arange(len(split)), [len(s) for s in split]), codes, list(distinct)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a partition, each pair once for every few batches."""
    held: dict[str, list] = {}

    def merged() -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang, parts in held.items():
            keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            yield lang, keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]))

    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            batch = whole.slice(lo, 1000)
            langs, lang_of = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object), return_inverse=True)
            doc, codes, distinct = _tokens(batch.column("text").to_pylist())
            for start in range(0, len(distinct), CHUNK):
                owner, gram = grams(distinct[start : start + CHUNK])
                for k, lang in enumerate(langs):
                    times = np.bincount(codes[lang_of[doc] == k], minlength=len(distinct))[start : start + CHUNK][owner].astype(float)
                    keys, inverse = np.unique(gram[times > 0], return_inverse=True)
                    held.setdefault(lang, []).append((keys, np.bincount(inverse, times[times > 0], minlength=len(keys))))
            for lang, keys, n in list(merged()) if any(len(p) > 8 for p in held.values()) else []:
                held[lang] = [(keys, n)]
    for lang, keys, n in merged():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Filter:
    """One bit per language in each slot; slots are rows of words where languages outnumber a word's bits.

    pairs: gram and k, the index of a language that contains it."""

    def __init__(self, langs: list[str], pairs: pd.DataFrame, majority: str | None):
        self.langs, self.majority = langs, majority
        self.kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(langs) <= np.dtype(k).itemsize * 8), np.uint64)
        self.bits = np.dtype(self.kind).itemsize * 8
        self.slots = np.zeros((max(1, -(-len(langs) // self.bits)), SLOTS), self.kind)
        k = pairs.k.to_numpy(np.int64)
        for at in self._probes(pairs.gram.to_numpy(np.int64).view(np.uint64)):
            np.bitwise_or.at(self.slots, (k // self.bits, at), self.kind(1) << (k % self.bits).astype(self.kind))
        self.false_rate = np.array([self._bit(self.slots, i).mean() for i in range(len(langs))]) ** PROBES

    def _bit(self, mask: np.ndarray, k: int) -> np.ndarray:
        """Whether language k is in each mask, words first."""
        return mask[k // self.bits] >> self.kind(k % self.bits) & self.kind(1)

    @staticmethod
    def _probes(gram: np.ndarray) -> list[np.ndarray]:
        step = (gram >> np.uint64(32)) | np.uint64(1)
        return [((gram + np.uint64(i) * step) % np.uint64(SLOTS)).astype(np.int64) for i in range(PROBES)]

    def hits(self, gram: np.ndarray) -> np.ndarray:
        """The set of languages that contain each n-gram: (words, grams)."""
        first, *others = self._probes(gram)
        mask = self.slots[:, first]
        for at in others:
            mask &= self.slots[:, at]
        return mask

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        doc, codes, distinct = _tokens(texts)
        per = np.zeros((len(distinct), len(self.langs) + 1))
        for lo in range(0, len(distinct), CHUNK):
            owner, gram = grams(distinct[lo : lo + CHUNK])
            mask, size = self.hits(gram), len(per[lo : lo + CHUNK])
            per[lo : lo + CHUNK, -1] = np.bincount(owner, minlength=size)
            for k in range(len(self.langs)):
                per[lo : lo + CHUNK, k] = np.bincount(owner, self._bit(mask, k), minlength=size)
        sums = np.stack([np.bincount(doc, per[codes, k], minlength=len(texts)) for k in range(per.shape[1])], axis=1)
        seen, total = sums[:, :-1], sums[:, -1:]
        fair = np.maximum((seen - self.false_rate * total) / (1 - self.false_rate), 0)
        all_of = fair.sum(1)
        best = fair.argmax(1) if self.langs else np.zeros(len(texts), int)
        score = np.where(all_of > 0, fair[np.arange(len(best)), best] / np.maximum(all_of, 1e-300), 0.0) if self.langs else np.zeros(len(texts))
        name = [("und" if not t or not self.langs else self.langs[b] if a > 0 else self.majority) for t, a, b in zip(total[:, 0], all_of, best, strict=True)]
        return name, score


def learn(train: DataFrame) -> Filter:
    """train: lang, text."""
    counts = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(totals.collect(), key=lambda r: r["lang"])  # one row per language
    if not langs:
        return Filter([], pd.DataFrame({"gram": np.zeros(0, np.int64), "k": np.zeros(0, np.int64)}), None)
    size = F.create_map(*(F.lit(x) for r in langs for x in (r.lang, float(r.total))))
    place = F.create_map(*(F.lit(x) for i, r in enumerate(langs) for x in (r.lang, i)))
    pairs = counts.where(F.col("n") >= MIN_RATE * size[F.col("lang")]).select("gram", place[F.col("lang")].alias("k")).toPandas()  # at most 1 / MIN_RATE a language
    counts.unpersist()
    return Filter([r.lang for r in langs], pairs, max(langs, key=lambda r: r.total).lang)


def identify(docs: DataFrame, found: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                name, score = shared.value.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    found = learn(docs.where(~held_out).select("lang", "text"))
    return identify(docs, found).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
