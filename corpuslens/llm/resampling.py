"""Operator 13: importance resampling towards a target's distribution of n-grams.

Features are all runs of 1 to 3 words. Their dictionary is made in two steps: a task counts the distinct strings of about
BLOCK bytes of text at a time, and sends each of them once, compressed, to the owner of a range of strings; the owner adds up
the counts of both tables, and hashes each distinct string once. Buckets are summed over ranges, so the driver and the
broadcast hold `buckets` numbers, whatever the input. A second pass joins the buckets' gains to each document's features
and sums them; there a feature's bucket is put together from the checksums of its block's distinct words, as sending
buckets back to documents would cost another exchange of the text. Ranges follow the text, and a range is dealt by an
n-gram's first two words, so a frequent word is not one task's. Documents are ranked by ranges of scores, with the ranges'
sizes as offsets.

Defined results: null and blank texts have no features and weight 0; documents with null id count as text of the corpus
and are not drawn; equal rows are all counted, and rank in any order among themselves; an empty table gives an empty result,
an empty target gives every bucket its smoothed share; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import stored, table

BUCKETS, MIN_WORDS, PER_CENT, SEED = 10_000, 20, 5, 42
#: Bytes of text of which a task makes a dictionary at a time, and words after which a text is cut (with what its n-grams need of the next).
BLOCK, PIECE = 3_000_000, 1_000_000

#: Bytes of a text to those of its words: letters A-Z in lower case, separators as blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Shift:
    """What a CRC-32 becomes when so many bytes follow it, as tables of its four bytes for each number of bytes seen."""

    def __init__(self) -> None:
        self.row: dict[int, int] = {}
        self.tables = np.zeros((0, 1024), np.uint32)

    def rows(self, sizes: np.ndarray) -> np.ndarray:
        distinct, inverse = np.unique(sizes, return_inverse=True)
        new = [int(s) for s in distinct if int(s) not in self.row]
        if new:
            made = np.zeros((len(new), 4, 256), np.uint32)
            values = np.arange(256)
            for t, size in zip(made, new, strict=True):
                zeros = bytes(size)
                for bit in range(32):
                    t[bit // 8][(values >> bit % 8) & 1 == 1] ^= np.uint32(zlib.crc32(zeros, 1 << bit) ^ zlib.crc32(zeros))
                self.row[size] = len(self.row)
            self.tables = np.concatenate([self.tables, made.reshape(len(new), -1)])
        return np.array([self.row[int(s)] for s in distinct], np.int64)[inverse] * 1024

    def __call__(self, crc: np.ndarray, rows: np.ndarray) -> np.ndarray:
        flat, out = self.tables.ravel(), np.zeros(len(crc), np.uint32)
        for k in range(4):
            out ^= flat[rows + (k * 256 + ((crc >> np.uint32(8 * k)) & np.uint32(255)))]
        return out


class Block:
    """The words of some texts: `words` distinct, `at` the number of each place's word, `left` the words from there to its text's end, `own` where an n-gram may start."""

    def __init__(self, pieces: list[list[bytes]]):
        sizes = np.array([len(p) for p in pieces], np.int64)
        coded = pa.array(list(chain.from_iterable(pieces)), pa.binary()).dictionary_encode()
        self.words: pa.Array = coded.dictionary
        self.at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.sizes, self.left = sizes, np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.at))
        self.own = np.ones(len(self.at), bool)
        if len(long := np.flatnonzero(sizes > PIECE)):
            starts = np.cumsum(sizes) - sizes
            for k in long:
                self.own[starts[k] + PIECE : starts[k] + sizes[k]] = False

    def starts(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.own & (self.left >= n))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams as three word numbers from 1 (0: none) of 21 bits, in order, and their counts."""
        one = self.at + 1
        two, three = self.starts(2), self.starts(3)
        pair = (one[two] << 42) | (one[two + 1] << 21)
        return np.unique(np.concatenate([one[self.starts(1)] << 42, pair, (one[three] << 42) | (one[three + 1] << 21) | one[three + 2]]), return_counts=True)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    found = text.translate(_FOLD).split()
    for lo in range(0, len(found), PIECE):
        yield found[lo : lo + PIECE + 2]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, Block]]:
    """side and block, of about so many bytes of text."""
    kept: dict[int, tuple[list[list[bytes]], int]] = {}
    for batch in batches:
        for side, text in zip(batch.column("side").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            for piece in _pieces(text or b""):
                pieces, n = kept.get(side, ([], 0))
                pieces.append(piece)
                kept[side] = pieces, (n := n + (len(text) if len(piece) <= PIECE else size))
                if n >= size:
                    yield side, Block(kept.pop(side)[0])
    for side, (pieces, _) in kept.items():
        yield side, Block(pieces)


def _numbers(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_numbers(raw: memoryview) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_SENT = pa.schema([("range", pa.int32()), ("side", pa.int32()), ("strings", pa.binary())])


def _sent(ranges: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block's distinct n-grams by range: first words or pairs, their counts and numbers of third words, third words and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side, block in _blocks(batches, size):
            packer = zstandard.ZstdCompressor(level=1)
            keys, counts = block.grams()
            head = np.flatnonzero((keys & ((1 << 21) - 1)) == 0)  # words and pairs; the third words of a pair follow it
            fan = np.diff(head, append=len(keys)) - 1
            first, second = (keys[head] >> 42) - 1, ((keys[head] >> 21) & ((1 << 21) - 1)) - 1
            hashed = np.fromiter(map(zlib.crc32, block.words.to_numpy(zero_copy_only=False)), np.uint64, len(block.words))
            owner = ((hashed[first] * np.uint64(0x9E3779B1) + np.where(second < 0, np.uint64(0), hashed[second] * np.uint64(0x85EBCA77))) >> np.uint64(16)) % np.uint64(ranges)
            order = np.argsort(owner.astype(np.uint16 if ranges < 65536 else np.int64), kind="stable")
            owner, first, second, head, fan = owner[order].astype(np.int64), first[order], second[order], head[order], fan[order]
            w1 = block.words.take(pa.array(first))
            w2 = block.words.take(pa.array(second, mask=second < 0))
            pairs = pc.coalesce(pc.binary_join_element_wise(w1, w2, pa.scalar(b" ")), w1)
            ends = np.cumsum(fan)
            third = np.repeat(head + 1 - (ends - fan), fan) + np.arange(ends[-1] if len(ends) else 0)
            w3 = block.words.take(pa.array((keys[third] & ((1 << 21) - 1)) - 1))
            cut = np.flatnonzero(np.diff(owner, prepend=-1, append=ranges))  # where ranges start, and the end
            rows = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                a, b = (ends[lo] - fan[lo]), ends[hi - 1]
                parts = [*_text(pairs, lo, hi), _numbers(counts[head[lo:hi]]), _numbers(fan[lo:hi]), *_text(w3, a, b), _numbers(counts[third[a:b]])]
                rows.append((int(owner[lo]), side, packer.compress(b"".join([np.array([len(p) for p in parts], "<u8").tobytes(), *parts]))))
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 256], strict=True), _SENT.types, strict=True)], schema=_SENT)

    return run


def _text(strings: pa.Array, lo: int, hi: int) -> tuple[bytes, bytes]:
    """Lengths and bytes of some of the strings."""
    if hi <= lo:
        return b"", b""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[lo : hi + 1]
    data = strings.buffers()[2]
    return _numbers(np.diff(offsets)), data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data is not None else b""


def _from_text(lengths: memoryview, data: memoryview) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(_from_numbers(lengths))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


_SUMS = pa.schema([("bucket", pa.int32()), ("s", pa.int64()), ("t", pa.int64())])


def _dictionary(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """The strings of a range, counted over all blocks of both sides; each is hashed once."""

    def run(rows: pa.Table) -> pa.Table:
        unpack, parts = zstandard.ZstdDecompressor(), []
        for side, raw in zip(rows.column("side").to_pylist(), rows.column("strings").to_pylist(), strict=True):
            raw = memoryview(unpack.decompress(raw))
            sizes = np.frombuffer(raw[:56], "<u8").astype(np.int64)
            ends = np.cumsum(sizes) + 56
            long, pairs, counts, fan, long3, thirds, more = (raw[e - s : e] for s, e in zip(sizes, ends, strict=True))
            pairs = _from_text(long, pairs)
            n = np.concatenate([_from_numbers(counts), _from_numbers(more)])
            longer = pc.binary_join_element_wise(pairs.take(pa.array(np.repeat(np.arange(len(pairs)), _from_numbers(fan)))), _from_text(long3, thirds), pa.scalar(b" "))
            zero = np.zeros(len(n), np.int64)
            parts.append(pa.table({"feature": pa.concat_arrays([pairs, longer]), "s": n if side == 0 else zero, "t": n if side else zero}))
        found = pa.concat_tables(parts).group_by("feature", use_threads=False).aggregate([("s", "sum"), ("t", "sum")])
        del parts
        features = found.column("feature").combine_chunks()
        bucket = np.concatenate([np.fromiter(map(zlib.crc32, some.to_numpy(zero_copy_only=False)), np.uint32, len(some)) for at in range(0, len(found), 100_000) for some in [features.slice(at, 100_000)]]) % np.uint32(buckets)
        sums = [np.bincount(bucket, found.column(c).to_numpy().astype(np.float64), buckets).astype(np.int64) for c in ("s_sum", "t_sum")]
        some = np.flatnonzero(sums[0] + sums[1])
        return pa.table([some.astype(np.int32), *(x[some] for x in sums)], schema=_SUMS)

    return run


_WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def _weighed(gains, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's words, features and sum of gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = Shift()

        def out(ids: list[int | None], pieces: list[list[bytes]], of: list[int]) -> pa.RecordBatch:
            block, gain = Block(pieces), gains.value
            words, blank = block.words.to_numpy(zero_copy_only=False), zlib.crc32(b" ")
            alone = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
            behind = np.fromiter((zlib.crc32(w, blank) for w in words), np.uint32, len(words))
            rows = shift.rows(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            one, spaced, after = alone[block.at], behind[block.at], rows[block.at]
            total, n, crc = gain[one % np.uint32(len(gain))], block.own.astype(np.int64), one
            for k in (2, 3):  # the checksums of one word more
                at = np.flatnonzero(block.left >= k)
                longer = np.zeros_like(crc)
                longer[at] = shift(crc[at], after[at + (k - 1)]) ^ spaced[at + (k - 1)]
                total[at] += gain[longer[at] % np.uint32(len(gain))]
                n[at] += 1
                crc = longer
            total[~block.own] = n[~block.own] = 0
            ends = np.concatenate([[0], np.cumsum(np.bincount(np.array(of, np.int64), block.sizes, len(ids)).astype(np.int64))])  # of each document's words
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            words, n, weight = sums(block.own.astype(np.int64)), sums(n), sums(total)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words), pa.array(n), pa.array(weight)], schema=_WEIGHED)

        ids, pieces, of, held = [], [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                more = list(_pieces(text or b""))
                pieces += more
                of += [len(ids)] * len(more)
                ids.append(key)
                held += len(text or b"")
                if held >= size:
                    yield out(ids, pieces, of)
                    ids, pieces, of, held = [], [], [], 0
        if ids:
            yield out(ids, pieces, of)

    return run


def bucket_counts(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """bucket, s, t: occurrences of its features in docs and in target, for the buckets that have any."""
    side = lambda df, k: df.select(F.col(text_col).cast("string").alias("text"), F.lit(k).alias("side"))
    both = side(docs, 0).union(side(target, 1))
    ranges = max(1, -(-int(both.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block))
    sent = both.mapInArrow(_sent(ranges, block), "range int, side int, strings binary")
    return sent.groupBy("range").applyInArrow(_dictionary(buckets), "bucket int, s long, t long").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))


def gains(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():  # at most `buckets` rows
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the key's digest: the largest of many such sums are a draw without return."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with position (from 1) in that order; no task sees more than a range of it."""
    rows = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_k", within).join(sizes, "_range").withColumn("position", (F.col("_k") + F.col("_before")).cast("long")).drop("_range", "_k", "_before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, min_words: int = MIN_WORDS, per_cent: int = PER_CENT, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null where not drawn) for each row of docs."""
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(stored(bucket_counts(docs, target, text_col, buckets, block), "buckets"), buckets))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_weighed(gain, block), "doc_id long, n_words long, n_features long, weight long")
    score = (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")
    fit = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    rows = ranked(rows.withColumns({"score": score, "_fit": fit}), [F.desc("_fit"), F.desc("score"), F.asc("doc_id")])
    most = rows.agg(F.floor(per_cent * F.count(F.when(F.col("_fit"), 1)) / 100).alias("_most"))
    drawn = F.col("_fit") & (F.col("position") <= F.col("_most"))
    return rows.crossJoin(F.broadcast(most)).select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("position")).alias("rank"))  # one row


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of x, a text of characters below U+0800, in plain SQL.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crcs)"


def crc_sql(x: str) -> str:
    code = "unicode(ch)"
    utf8 = f"CASE WHEN {code} < 128 THEN [{code}] WHEN {code} < 2048 THEN [192 + ({code} >> 6), 128 + ({code} & 63)] ELSE [224 + ({code} >> 12), 128 + (({code} >> 6) & 63), 128 + ({code} & 63)] END"
    octets = f"flatten(list_transform(string_split({x}, ''), lambda ch: {utf8}))"
    return f"xor(list_reduce({octets}, lambda c, o: xor(c >> 8, crcs[(xor(c, o) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def op13_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = "list_transform(range(1, len(w) + 1), lambda i: w[i]) || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
    return rf"""
WITH {CRC_TABLE},
texts AS (SELECT row_number() OVER () AS row_id, doc_id, {found} AS w FROM documents),
f AS (SELECT row_id, feature, count(*) AS n FROM (SELECT row_id, unnest({grams}) AS feature FROM texts) GROUP BY ALL),
g AS (SELECT feature, count(*) AS n FROM (SELECT unnest({grams}) AS feature FROM (SELECT {found} AS w FROM benchmark)) GROUP BY ALL),
dictionary AS (SELECT feature, {crc_sql('feature')} % {BUCKETS} AS bucket FROM (SELECT feature FROM f UNION SELECT feature FROM g), crc_table),
sums AS (
  SELECT bucket, sum(s) AS s, sum(t) AS t FROM (SELECT bucket, n AS s, 0 AS t FROM f JOIN dictionary USING (feature) UNION ALL SELECT bucket, 0, n FROM g JOIN dictionary USING (feature)) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ()) + {BUCKETS}) / ((s + 1)::DOUBLE * ((sum(t) OVER ()) + {BUCKETS})))) AS gain FROM sums),
weights AS (SELECT row_id, sum(n) AS n, sum(n * gain) AS weight FROM f JOIN dictionary USING (feature) JOIN gain USING (bucket) GROUP BY row_id),
scored AS (
  SELECT row_id, doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || doc_id), 8))::BIGINT + 0.5) / 4294967296::DOUBLE))))::BIGINT AS score FROM texts LEFT JOIN weights USING (row_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY words >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (words >= {MIN_WORDS}) OVER () AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {MIN_WORDS} AND place <= {PER_CENT} * many // 100 THEN place END::BIGINT AS rank FROM placed"""
