"""Operator 1: packing documents into sequences of a fixed capacity.

Method: a configuration linear program over the histogram of piece lengths. One variable per configuration (multiset of
lengths that fits), one covering row per length. Multiplicative weights keep a price per length; a knapsack dynamic
program prices configurations; the fractional solution is rounded down and what is left is solved again, then, when only
few sequences remain, filled item by item with a subset-sum dynamic program.

Only the histogram (at most `capacity` rows) reaches the driver. Pieces learn their place from (length, rank), where the
rank comes from per-partition counts and their prefix sums, so that no length is gathered in one task.

Defined results: null or empty texts become one piece that holds the end id alone; null doc_id stays null; equal rows are
packed separately; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import stored, table

CAPACITY = 2048
#: Words whose ids a worker keeps, in each of two generations.
CACHE = 200_000
#: Bytes of text tokenized at once: with CACHE, what a worker takes beside the tokenizer and the batch.
CHUNK = 4_000_000
#: Words in one call of the tokenizer, whose results take many times what is kept of them.
BATCH = 5_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


# ---------------------------------------------------------------- tokens

_STATE: dict = {}
#: Words of Latin letters, perhaps with marks after them: the tokenizer's rules make each part a word of its own.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{-~]{0,4})")


class Words:
    """The ids of words, as little-endian unsigned 32-bit numbers, with a bounded memory of words seen.

    The tokenizer drops white space and joins nothing across it, so ids are found once per distinct word. Plain words go
    straight to its merge model, in lower case and with bytes written as the byte-level alphabet writes them; all others
    go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.cores: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x100)}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        rest, plain, model, cores, marks = [], _PLAIN.fullmatch, self.model.tokenize, self.cores, self.marks
        for kept in (cores, marks):
            if len(kept) > CACHE:
                kept.clear()
        for word in words:
            if not (got := plain(word)):
                rest.append(word)
                continue
            letters, mark = got.groups()
            text = letters.lower()
            if text not in cores:
                cores[text] = array("I", [t.id for t in model(text if text.isascii() else text.translate(self.letters))]).tobytes()
            if mark not in marks:
                marks[mark] = self._ids(self.whole.encode(mark, add_special_tokens=False).ids)
            self.new[word] = cores[text] + marks[mark]
        for lo in range(0, len(rest), BATCH):
            some = rest[lo : lo + BATCH]
            for word, coded in zip(some, self.whole.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.new[word] = self._ids(coded.ids)

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (and the last end)."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        distinct, unseen = words.dictionary.to_pylist(), []
        for w in distinct:
            if w not in self.new:
                if w in self.old:
                    self.new[w] = self.old[w]
                else:
                    unseen.append(w)
        self.learn(unseen)
        found = [self.new[w] for w in distinct]
        flat, size = np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found] or [0], np.int64)
        first = np.cumsum(size) - size
        code = words.indices.to_numpy()
        many = size[code] if len(code) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.repeat(first[code] - ends[:-1], many) + np.arange(ends[-1])] if len(code) else flat
        return ids, ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


def _words(path: str) -> Words:
    if path not in _STATE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _STATE[path] = Words(path)
    return _STATE[path]


def _chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text."""
    end = np.cumsum(np.nan_to_num(np.array(pc.binary_length(batch.column(column)).to_pylist(), float)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece; rank numbers the pieces of one length within one partition."""
    end = np.asarray([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for whole in batches:
            for batch in _chunks(whole, 1):
                ids, starts = _words(vocabulary).coded(pc.fill_null(batch.column(1), ""))
                out: list[tuple] = []
                for nth, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    document = np.concatenate([ids[a:b], end])
                    for piece, at in enumerate(range(0, len(document), capacity)):
                        some = document[at : at + capacity]
                        out.append((nth, piece, at, len(some), zlib.crc32(some), part, seen[len(some)]))
                        seen[len(some)] += 1
                nth, *columns = zip(*out, strict=True)
                kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(nth)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- the linear program


def _price(weight: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value for each capacity, and the length taken last (0: one token stays empty)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int32)
    for c in range(1, capacity + 1):
        value = weight[1 : c + 1] + best[c - 1 :: -1] if c < capacity else weight[1:] + best[c - 1 :: -1]
        at = int(value.argmax())
        if value[at] > best[c - 1]:
            best[c], last[c] = value[at], at + 1
        else:
            best[c] = best[c - 1]
    return best, last


def _columns(weight: np.ndarray, capacity: int, lengths: np.ndarray, slack: float, most: int) -> tuple[list[dict[int, int]], float]:
    """Configurations worth within slack of the best, one for each first length, and the best's worth."""
    best, last = _price(weight, capacity)
    worth = weight[lengths] + best[capacity - lengths]
    order = np.argsort(-worth, kind="stable")[:most]
    found = {}
    for length in lengths[order[worth[order] >= (1 - slack) * worth[order[0]]]].tolist():
        config, room = {length: 1}, capacity - length
        while room > 0:
            take = int(last[room])
            config[take] = config.get(take, 0) + 1 if take else 0
            room -= take or 1
        config.pop(0, None)
        found[tuple(sorted(config.items()))] = config
    return list(found.values()), float(worth[order[0]])


def configuration_lp(counts: dict[int, int], capacity: int, step: float = 0.25, rounds: int = 160, slack: float = 0.02, most: int = 48) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Multiplicative weights on the covering program: (configuration, copies) that cover the demand about once, and a lower bound on copies."""
    lengths = np.array(sorted(counts))
    need = np.array([counts[x] for x in lengths.tolist()], float)
    row = {x: i for i, x in enumerate(lengths.tolist())}
    weight, covered, bound = lengths / capacity, np.zeros(len(lengths)), 0.0
    made: dict[tuple, list] = {}
    tokens = float(lengths @ need)
    for _ in range(rounds):
        dense = np.full(capacity + 1, -1.0)
        dense[lengths] = weight
        configs, worth = _columns(dense, capacity, lengths, slack, most)
        bound = max(bound, float(weight @ need) / worth)
        gain, copies = np.zeros(len(lengths)), []
        for config in configs:
            at, times = [row[x] for x in config], np.array(list(config.values()), float)
            copies.append(float((need[at] / times).min()))
            gain[at] += copies[-1] * times / need[at]
        scale = step / gain.max()
        for config, n in zip(configs, copies, strict=True):
            made.setdefault(tuple(sorted(config.items())), [config, 0.0])[1] += scale * n
        covered += scale * gain
        weight = weight * np.exp(-scale * gain)
        weight /= weight.max()
        if lengths @ (need * np.minimum(covered, 1)) >= 0.995 * tokens:
            break
    return [(c, x) for c, x in made.values()], bound


def _fill(left: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """Item by item: the largest piece left, and the others that fill its sequence best (subset sums as bits)."""
    out, full = [], (1 << (capacity + 1)) - 1
    left = {x: n for x, n in left.items() if n > 0}
    while left:
        order = sorted(left, reverse=True)
        config, room = {order[0]: 1}, capacity - order[0]
        reach, steps = 1, []
        for x in order:
            if x > room:
                continue
            for _ in range(min(left[x] - (x == order[0]), room // x)):
                steps.append((reach, x))
                reach = (reach | (reach << x)) & full
                if reach >> room & 1:
                    break
            if reach >> room & 1:
                break
        target = (reach & ((1 << (room + 1)) - 1)).bit_length() - 1
        for before, x in reversed(steps):
            if not before >> target & 1:
                config[x] = config.get(x, 0) + 1
                target -= x
        for x, n in config.items():
            left[x] -= n
            if not left[x]:
                del left[x]
        out.append(config)
    return out


def plan(histogram: dict[int, int], capacity: int, few: int = 3000, passes: int = 12) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Configurations with whole numbers of copies that use up the histogram exactly, and a lower bound on their number.

    Work depends on the number of distinct lengths (at most capacity), `few` and `passes`, not on the number of pieces.
    """
    left = {x: n for x, n in histogram.items() if n > 0}
    tokens = sum(x * n for x, n in left.items())
    out: list[tuple[dict[int, int], int]] = []
    bound, full = -(-tokens // capacity), left.pop(capacity, 0)
    if full:
        out.append(({capacity: 1}, full))
    for at in range(passes):
        size = sum(x * n for x, n in left.items())
        if not left or at and size <= few * capacity:
            break
        solved, lower = configuration_lp(left, capacity)
        if not at:
            bound = max(bound, full + int(np.ceil(lower - 1e-6)))
        total = sum(x * n * k for c, k in solved for x, n in c.items())
        placed = 0
        for config, copies in sorted(solved, key=lambda s: (sum(x * n for x, n in s[0].items()), s[1]), reverse=True):
            n = min(int(copies * size / total), *(left.get(x, 0) // k for x, k in config.items()))
            if n > 0:
                out.append((config, n))
                for x, k in config.items():
                    left[x] -= n * k
                    placed += n * k * x
        left = {x: n for x, n in left.items() if n > 0}
        if placed < 0.05 * size:
            break
    rest: dict[tuple, list] = {}
    for config in _fill(left, capacity):
        rest.setdefault(tuple(sorted(config.items())), [config, 0])[1] += 1
    return out + [(c, n) for c, n in rest.values()], bound


def places(planned: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """By length and first rank: where pieces with ranks from there on go."""
    rows, next_rank, sequence = [], defaultdict(int), 0
    for config, copies in planned:
        offset = 0
        for length, times in sorted(config.items(), reverse=True):
            rows.append((length, next_rank[length], times, sequence, offset))
            next_rank[length] += copies * times
            offset += length * times
        sequence += copies
    got = np.array(sorted(rows) or np.zeros((0, 5)), np.int64)
    return {k: got[:, i] for i, k in enumerate(("length", "rank", "times", "sequence", "offset"))}


# ---------------------------------------------------------------- the operator


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents over capacity are cut."""
    spark = docs.sparkSession
    pieces = stored(tokenized_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    planned, _ = plan(histogram, capacity)
    place = spark.sparkContext.broadcast(places(planned))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = place.value
        key = p["length"] * (1 << 44) + p["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            nth = rank - p["rank"][at]
            sequence = p["sequence"][at] + nth // p["times"][at]
            offset = p["offset"][at] + nth % p["times"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(first, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("first"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
