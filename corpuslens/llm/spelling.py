"""Operator 11: grouping spelling variants.

Words are counted in tasks and then over all. The counted vocabulary is put in order and cut into shards of at most SHARD words,
each a trie in flat arrays (children of a node side by side). Shards are broadcast in groups of at most GROUP bytes, one
group at a time, so a broadcast has a fixed bound and a larger vocabulary takes more rounds. Every word's automaton of
Levenshtein distance one runs through each shard depth-first; a task sends for each word the number of neighbours it accepted
and the best of them, and these are reduced over the shards. Shards hold words side by side in alphabetical order, so most of
them end at their first letters. Chains of forms are followed by pointer doubling; each step multiplies a word's count
by `factor` at least, so there are few.

Defined results: null texts have no words; a null id is an empty text in what is hashed; equal rows are all counted; of
equally frequent forms the first in code-point order is taken; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import discard, stored, table
from .resampling import CRC_TABLE, crc_sql

MIN_LENGTH, MIN_COUNT, FACTOR, DAMAGE = 6, 5, 5, 199
#: Words in a shard, bytes of shards in a broadcast, distinct words that a task counts before it sends them, and words whose neighbours a task finds.
SHARD, GROUP, HELD, TASK = 20_000, 16_000_000, 400_000, 5_000


def damaged(key: bytes, run: str, one_in: int = DAMAGE) -> str:
    """The run without one code point where the checksum of `key:run` is a multiple of one_in."""
    h = zlib.crc32(run.encode(), zlib.crc32(key + b":"))
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(min_length: int, one_in: int, held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """word, n of a task's texts. Shorter runs cannot become words."""
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                head = zlib.crc32(b"%s:" % (key or "").encode())
                crc = zlib.crc32
                for word, n in Counter(runs.findall((text or b"").lower().decode())).items():
                    if crc(word.encode(), head) % one_in:
                        total[word] += n
                    elif len(left := damaged((key or "").encode(), word, one_in)) >= min_length:
                        total[left] += n
                if len(total) >= held:
                    yield batch_of()
                    total.clear()
        if total:
            yield batch_of()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, one_in: int = DAMAGE, held: int = HELD) -> DataFrame:
    """word, n: the words of at least min_length code points that occur min_count times or more."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counted(min_length, one_in, held), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Trie:
    """Words in flat arrays: node k has the children first[k] to first[k + 1] - 1, with those letters; n is a word's count, or 0."""

    def __init__(self, labels: str, first: array, n: array):
        self.labels, self.first, self.n = labels, first, n

    @classmethod
    def of(cls, words: list[tuple[str, int]]) -> Trie:
        """words: distinct, in code-point order."""
        labels, first, n = [""], array("I"), array("q")
        level, depth = [(0, len(words))], 0
        while level:
            below = []
            for lo, hi in level:
                first.append(len(labels))
                whole = len(words[lo][0]) == depth if hi > lo else False
                n.append(words[lo][1] if whole else 0)
                at = lo + whole
                while at < hi:
                    letter, start = words[at][0][depth], at
                    while at < hi and words[at][0][depth] == letter:
                        at += 1
                    labels.append(letter)
                    below.append((start, at))
            level, depth = below, depth + 1
        first.append(len(labels))
        return cls("\x00" + "".join(labels), first, n)

    def pack(self) -> bytes:
        letters = self.labels.encode("utf-32-le")
        return b"".join([len(letters).to_bytes(8, "little"), len(self.first).to_bytes(8, "little"), letters, self.first.tobytes(), self.n.tobytes()])

    @classmethod
    def unpack(cls, raw: bytes) -> Trie:
        a, b = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
        first, n = array("I"), array("q")
        first.frombytes(raw[16 + a : 16 + a + 4 * b])
        n.frombytes(raw[16 + a + 4 * b :])
        return cls(raw[16 : 16 + a].decode("utf-32-le"), first, n)

    def near(self, word: str) -> dict[str, int]:
        """The words that one inserted, deleted or replaced code point makes of this one, with their counts.

        The automaton's states are (letters read, edits); a node is left as soon as no state is."""
        labels, first, counts, size = self.labels, self.first, self.n, len(word)
        find, found = labels.find, {}
        stack = [(0, 0, "")]  # nodes reached without an edit: node, letters read, path
        while stack:
            node, i, path = stack.pop()
            lo, hi = first[node], first[node + 1]
            rest = word[i + 1 :]
            # states with one edit: a letter of the word is passed over, or a child's letter is read in addition or in its place
            edited = [(node, i + 1, path)] if i < size else []
            for child in range(lo, hi):
                letter = labels[child]
                longer = path + letter
                if i < size and letter == word[i]:
                    stack.append((child, i + 1, longer))
                elif i < size:
                    edited.append((child, i + 1, longer))
                edited.append((child, i, longer))
            for at, k, path_ in edited:
                tail = word[k:] if k == i else rest
                for letter in tail:
                    at = find(letter, first[at], first[at + 1])
                    if at < 0:
                        break
                else:
                    if counts[at] and (made := path_ + tail) != word:
                        found[made] = counts[at]
        return found


_SHARDS = pa.schema([("bytes", pa.int64()), ("trie", pa.binary())])


def _shards(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []

        def cut() -> pa.RecordBatch:
            raw = Trie.of(held).pack()
            return pa.RecordBatch.from_arrays([pa.array([len(raw)], pa.int64()), pa.array([raw], pa.binary())], schema=_SHARDS)

        for batch in batches:
            for row in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                held.append(row)
                if len(held) == size:
                    yield cut()
                    held = []
        if held:
            yield cut()

    return run


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])


def _met(shards) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """word, n_near, best, best_n: each word's neighbours in the broadcast shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [Trie.unpack(raw) for raw in shards.value]
        for batch in batches:
            rows = []
            for word in batch.column("word").to_pylist():
                found = {}
                for trie in tries:
                    found |= trie.near(word)
                if found:
                    best = min(found, key=lambda w: (-found[w], w))
                    rows.append((word, len(found), best, found[best]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _NEAR.types, strict=True)], schema=_NEAR)

    return run


def near_words(words: DataFrame, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """word, n_near, best, best_n for the words (word, n; distinct) that have a word at distance one."""
    spark = words.sparkSession
    ordered = words.repartitionByRange("word").sortWithinPartitions("word")
    shards = stored(ordered.mapInArrow(_shards(shard), "bytes long, trie binary").withColumn("shard", F.monotonically_increasing_id()), "shards")
    groups, held = [[]], 0
    for r in shards.select("shard", "bytes").orderBy("shard").collect():  # a row for each shard
        if groups[-1] and held + r.bytes > group:
            groups.append([])
            held = 0
        groups[-1].append(r.shard)
        held += r.bytes
    parts, tasks = [], max(spark.sparkContext.defaultParallelism, -(-words.count() // TASK))  # the words are few bytes and much work
    for some in filter(None, groups):
        tries = spark.sparkContext.broadcast([r.trie for r in shards.where(F.col("shard").between(some[0], some[-1])).select("trie").collect()])  # at most `group` bytes
        parts.append(stored(words.select("word").repartition(tasks, F.xxhash64("word")).mapInArrow(_met(tries), "word string, n_near long, best string, best_n long"), "near"))
        tries.unpersist()
    discard(shards)
    if not parts:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n")).where("false")
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("best")))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.best", (-F.col("b.k")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of forms (word, form) from each word ends. Chains have no circle."""
    at, done = stored(forms.select("word", F.col("form").alias("root")), "roots"), False
    while not done:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        done = step.where("moved").isEmpty()
        discard(at)
        at = step.drop("moved")
        at._kept_at = step._kept_at
    return at


def variants(words: DataFrame, factor: int = FACTOR, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of the words (word, n)."""
    near = near_words(words, shard, group)
    form = F.coalesce(F.col("best_n") >= factor * F.col("n"), F.lit(False))
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n"))
    rows = stored(rows, "forms")
    chains = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(stored(word_counts(table(spark, sf_dir, "documents")), "words"))


def op11_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hashed = crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")
    return rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, n, {hashed} AS h FROM runs, crc_table),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
keys AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS key FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM keys a JOIN keys b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, k.n, w.word, w.n FROM keys k JOIN words w ON w.word = k.key
  UNION SELECT w.word, w.n, k.word, k.n FROM keys k JOIN words w ON w.word = k.key),
best AS (SELECT word, count(*) AS n_near, arg_max(other, (m, list_transform(string_split(other, ''), lambda c: -unicode(c)), -length(other))) AS form, max(m) AS m FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {FACTOR} * w.n THEN form END AS form, CASE WHEN m >= {FACTOR} * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
