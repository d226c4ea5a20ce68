"""Operator 6: near-duplicate documents by bottom-k sketches from one hash function.

1. Each text becomes its set of distinct shingle hashes; the K smallest are its sketch. Equal sets collapse at once, by a
   128-bit digest; one representative goes on.
2. Inverted lists of the retained values, pruned by the prefix principle: two sets over the threshold share at least
   `overlap(n)` retained values, so in an order by (frequency, value) they share one of the first size - overlap + 1.
   Values that only one set retains fill those places and are dropped, so frequent passages hardly make lists.
3. Every set that shares a list with another is first compared with one hub, the first set of the lists that it shares most
   (hubs with many sets in blocks), by exact Jaccard similarity. That unites groups of copies with one comparison a set.
4. Lists whose sets are united by then are done. In each other list the sets are compared by signatures of their sketches,
   SIGNATURE bits of which at least one stands for every retained value: bits that only one of two sets has come from values
   that the other lacks, of which a link allows a few, so a link always passes. What passes forms candidate groups (components
   over the united classes); lists alone would join most of a large table into one group by chance. A group is cut into
   blocks, a large class into blocks of its own, and blocks that are not of one class are compared in pairs, each pair in one
   task: overlaps of sketches, the union-sketch estimate as a filter, and the exact Jaccard similarity of the full sets. Tasks
   return only pairs and links that join something new, so no pair table is ever made.

For sets whose partners have at most K shingles the prefix is exact. For others the least overlap is the binomial quantile at
MISS / 2 of K values that are common with the probability of the threshold, the least there is (one text within the other), and
the estimate's cut is such a quantile for each size of the union sketch, so a link is missed with a probability of at most 2 MISS.

Defined results: texts without a word (null, blank) and rows with null id link with nothing and are kept; equal rows are
one component; rows that share an id and differ in text are documents of their own (`tag`, a hash of the text, tells them
apart), and of rows alike in both all are the first or none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ._graph import Union
from ._io import discard, stored, table

K = 64
#: The probability that the prefix drops a link at the threshold, and that the estimate does.
MISS = 1e-8
#: Documents in a block, and shingles in one; a task compares two blocks.
BLOCK, SHINGLES = 256, 1 << 18
#: Bits of a signature, sets in a block of a list, and rows of lists that a task compares at once.
SIGNATURE, LIST, ROWS = 512, 512, 4096


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word windows of each text; fewer words than width are one shingle."""
    split = [t.lower().split() for t in texts]
    codes, distinct = pd.factorize(np.array(list(chain.from_iterable(split)) or [b""], dtype=object))
    word = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)[codes]
    rolled = word.copy()
    for k in range(1, width):
        x = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[k:] if len(rolled) > 1 else rolled[:0]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        rolled = x ^ (x >> np.uint64(27))
    ends = np.cumsum([len(s) for s in split])
    out = []
    for end, s in zip(ends.tolist(), split, strict=True):
        n = len(s)
        if n >= width:
            out.append(np.unique(rolled[end - n : end - width + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b"\0".join(s))] if n else [], np.uint64))
    return out


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            sets = shingle_sets(_texts(batch.column("text")), width)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([s[:k].view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "tag", "n", "digest", "sketch"])

    return run


def signature(sketch: np.ndarray) -> bytes:
    bits = np.zeros(SIGNATURE, np.uint8)
    bits[sketch % np.uint64(SIGNATURE)] = 1
    return np.packbits(bits).tobytes()


def _full(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            sets = shingle_sets(_texts(batch.column("text")), width)
            signed = pa.array([signature(s[:k]) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), signed, pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "signature", "set"])

    return run


@functools.cache
def surely(n: int, share: float, miss: float) -> int:
    """The most m for which fewer than m of n draws, each common with probability share, have a probability of at most miss."""
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n, m) * share**m * (1 - share) ** (n - m)
        if below > miss:
            return m
    return n


def least_overlap(n: Column, threshold: float, k: int) -> Column:
    """Retained values that a set of n shingles shares at least with any set over the threshold.

    A value of the larger set is common with a probability of at least the threshold: just that where it holds the other set,
    2t / (1 + t) for sets of equal size. Either sketch may be the one that ends first, hence half of MISS for each."""
    sure = F.ceil(F.lit(threshold) * n)
    return F.when(n <= int(threshold * k), sure).otherwise(F.least(sure, F.lit(surely(k, threshold, MISS / 2))))


def _candidates(threshold: int, k: int):
    """Pairs of sets of one list, or of two blocks of it, that may link, are not united and join something new."""
    sure = surely(k, threshold / 100, MISS / 2)

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("value", "ascending"), ("p", "ascending"), ("q", "ascending")])
        value, p, q, side, node, known, n = (rows.column(c).to_numpy() for c in ("value", "p", "q", "side", "node", "class", "n"))
        bits = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint64).reshape(len(node), -1)
        need = -(-threshold * n // 100)
        need = np.where(n <= threshold * k // 100, need, np.minimum(need, sure))
        size = np.minimum(n, k)
        starts = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
        end = np.repeat(np.append(starts[1:], len(node)), np.diff(np.append(starts, len(node))))
        lone = lambda x, y: np.bitwise_count(bits[x] & ~bits[y]).sum(1, dtype=np.int64)
        distinct, at = np.unique(node, return_inverse=True)
        group, out, left, apart = Union(len(distinct)), [], np.arange(len(node)), 0
        while len(left := left[left + (apart := apart + 1) < end[left]]):
            a, b = left, left + apart
            maybe = (known[a] != known[b]) & ((p[a] == q[a]) | (side[a] != side[b])) & (100 * np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]))
            a, b = a[maybe], b[maybe]
            most = np.maximum(need[a], need[b])
            maybe = (lone(a, b) <= size[a] - most) & (lone(b, a) <= size[b] - most)
            out += [(x, y) for x, y in zip(a[maybe].tolist(), b[maybe].tolist(), strict=True) if group.join(at[x], at[y])]
        a, b = (np.array([o[i] for o in out], np.int64) for i in (0, 1))
        return pa.table([node[a], known[a], node[b], known[b]], names=["a", "a_class", "b", "b_class"])

    return compare


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table(list(map(list, zip(*pairs, strict=True))) or [[], []], schema=_LINKS)


def _to_hub(threshold: int):
    """Links between a hub and the sets of one of its blocks."""

    def compare(rows: pa.Table) -> pa.Table:
        ids, hub = rows.column("node").to_pylist(), rows.column("hub")[0].as_py()
        sets = dict(zip(ids, (np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()), strict=True))
        of, out = sets.pop(hub), []
        for node, s in sets.items():
            if 100 * min(len(s), len(of)) >= threshold * max(len(s), len(of)):
                at = np.minimum(np.searchsorted(of, s), len(of) - 1)
                both = int((of[at] == s).sum())
                if 100 * both >= threshold * (len(s) + len(of) - both):
                    out.append((hub, node))
        return _links(out)

    return compare


def _pairs(threshold: int, k: int):
    """Links between the sets of one block, or of two, that join something new."""
    #: Common values by the size of the union sketch, whichever it is.
    cut = np.array([surely(u, threshold / 100, MISS / (2 * k)) for u in range(2 * k + 1)])

    def compare(rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
        ids, side, known = (rows.column(c).to_numpy() for c in ("node", "side", "class"))
        n = np.array([len(s) for s in sets])
        sketch = [s[:k] for s in sets]
        values, inverse = np.unique(np.concatenate(sketch), return_inverse=True)
        seen = np.zeros((len(sets), len(values)), np.float32)
        seen[np.repeat(np.arange(len(sets)), [len(s) for s in sketch]), inverse] = 1
        overlap = seen @ seen.T
        last = np.array([s[-1] for s in sketch])  # a sketch is complete up to its last value, a whole set anywhere
        last[n <= k] = np.iinfo(np.uint64).max
        below = np.stack([np.searchsorted(s, last, side="right") for s in sketch])
        union = np.maximum(below + below.T - overlap, 1)
        maybe = (overlap >= cut[union.astype(np.int64)]) & (100 * np.minimum(n[:, None], n) >= threshold * np.maximum(n[:, None], n))
        maybe &= known[:, None] != known
        if side.any():
            maybe &= side[:, None] != side
        _, local = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(n)])
        flag = np.zeros(local.max() + 1, np.int64)
        _, label = np.unique(known, return_inverse=True)
        group, out = Union(len(sets)), []
        for a in np.argsort(-maybe.sum(1), kind="stable").tolist():
            others = [b for b in np.flatnonzero(maybe[a]).tolist() if group.find(label[a]) != group.find(label[b])]
            if not others:
                continue
            own = local[starts[a] : starts[a + 1]]
            flag[own] = 1
            for b in others:
                if group.find(label[a]) != group.find(label[b]):
                    both = int(flag[local[starts[b] : starts[b + 1]]].sum())
                    if 100 * both >= threshold * (n[a] + n[b] - both) and group.join(label[a], label[b]):
                        out.append((ids[a], ids[b]))
            flag[own] = 0
        return _links(out)

    return compare


def retained_lists(sets: DataFrame, threshold: int, k: int) -> DataFrame:
    """node, value for the values in a set's prefix that another set's prefix holds too. sets: node, n, sketch."""
    value = sets.select("node", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    frequent = value.groupBy("value").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    shared = value.join(frequent, "value").groupBy("node").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("many", "value"))).alias("of"))
    first = F.col("size") - least_overlap(F.col("n"), threshold / 100, k) + 1 - (F.col("size") - F.size("of"))
    lists = stored(shared.select("node", F.explode(F.slice("of", 1, F.greatest(first, F.lit(0)).cast("int"))).alias("v")).select("node", "v.value"), "prefixes")
    several = lists.groupBy("value").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("value")
    out = stored(lists.join(several, "value").select("node", "value"), "lists")
    discard(lists)
    return out


def hub_links(lists: DataFrame, full: DataFrame, threshold: int, block: int) -> DataFrame:
    """Links of each set with its hub."""
    hub = lists.groupBy("value").agg(F.min("node").alias("hub"))
    shared = lists.join(hub, "value").where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("many"))
    chosen = stored(shared.groupBy("node").agg(F.max_by("hub", "many").alias("hub")), "chosen")
    blocks = chosen.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = chosen.join(blocks, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    dealt = dealt.union(blocks.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    links = stored(full.select("node", "set").join(dealt, "node").groupBy("hub", "block").applyInArrow(_to_hub(threshold), "a long, b long"), "links")
    discard(chosen)
    return links


def remaining_links(lists: DataFrame, full: DataFrame, united: DataFrame, threshold: int, k: int, block: int) -> DataFrame | None:
    """Links between sets that share a list and are not united yet; None if no such sets may link."""
    placed = lists.join(united.withColumnRenamed("component", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    mixed = placed.groupBy("value").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("value", "least")
    rest = stored(placed.join(mixed, "value").select("value", "node", "class"), "rest")
    cut = rest.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("blocks"))
    own, other = F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sides = rest.join(cut, "value").select("value", "node", "class", own, "blocks").select("value", "node", "class", "own", other)
    sides = sides.select("value", "node", "class", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    batch = F.pmod(F.xxhash64("value", "p", "q"), F.lit(math.ceil(rest.count() / ROWS) or 1)).alias("batch")
    alike = sides.join(full.select("node", "n", "signature"), "node").groupBy(batch).applyInArrow(_candidates(threshold, k), "a long, a_class long, b long, b_class long")
    pairs = stored(alike, "candidates")
    discard(rest)
    if pairs.isEmpty():
        discard(pairs)
        return None
    groups = components(pairs.select(F.col("a_class").alias("a"), F.col("b_class").alias("b"))).select(F.col("node").alias("class"), F.col("component").alias("group"))
    found = pairs.select(F.col("a").alias("node"), F.col("a_class").alias("class")).union(pairs.select("b", "b_class")).distinct()
    members = stored(found.join(groups, "class").join(full.select("node", "n"), "node"), "members")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / SHINGLES)).cast("int").alias("blocks")
    own = members.groupBy("group", "class").agg(blocks)
    # large classes have blocks of their own, all others of a group share the blocks of class -1
    large = own.where("blocks > 1")
    pooled = members.join(large.select("class"), "class", "left_anti").groupBy("group").agg(blocks).select("group", F.lit(-1).cast("long").alias("c"), "blocks")
    of = pooled.union(large.select("group", F.col("class").alias("c"), "blocks"))
    every = of.select("group", "c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select("group", F.struct("c", "i").alias("p"))
    both = every.join(every.select("group", F.col("p").alias("q")), "group").where((F.col("p") <= F.col("q")) & ((F.col("p.c") != F.col("q.c")) | (F.col("p.c") == -1)))
    side = lambda k, at: both.select("group", "p", "q", F.lit(k).alias("side"), F.col(f"{at}.c").alias("c"), F.col(f"{at}.i").alias("i"))
    sides = side(0, "p").union(side(1, "q").where("p <> q"))
    dealt = members.join(large.select("class", F.col("blocks").alias("own")), "class", "left").join(pooled.select("group", F.col("blocks").alias("shared")), "group", "left")
    c, i = F.when(F.col("own").isNull(), -1).otherwise(F.col("class")).cast("long"), F.when(F.col("own").isNull(), F.pmod(F.xxhash64("class"), "shared")).otherwise(F.pmod(F.xxhash64("node"), "own")).cast("int")
    dealt = dealt.select("node", "class", "group", c.alias("c"), i.alias("i")).join(sides, ["group", "c", "i"]).select("node", "class", "group", "p", "q", "side")
    links = stored(full.select("node", "n", "set").join(dealt, "node").groupBy("group", "p", "q").applyInArrow(_pairs(threshold, k), "a long, b long"), "links")
    discard(pairs, members)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80, k: int = K, block: int = BLOCK) -> DataFrame:
    """doc_id, tag, n_shingles, component_id, kept, first for each row; threshold is in hundredths of the Jaccard similarity.

    kept: the id is the component's; first: the row is its component's first by (doc_id, tag)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    rows = stored(docs.mapInArrow(_sketches(width, k), "doc_id long, tag long, n long, digest binary, sketch array<long>"), "sketches")
    sets = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "tag")).alias("head"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = stored(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    lists = retained_lists(sets, threshold, k)
    wanted = lists.select("node").distinct().join(sets.select("node", "n", "head.doc_id", "head.tag"), "node")
    full = stored(docs.join(wanted.hint("shuffle_hash"), ["doc_id", "tag"]).dropDuplicates(["node"]).select("node", "n", "text").mapInArrow(_full(width, k), "node long, n long, signature binary, set binary"), "full")
    links = hub_links(lists, full, threshold, block)
    found = components(links)
    more = remaining_links(lists, full, found, threshold, k, block)
    if more is not None:
        united, found = found, components(links.union(more))
        discard(united, more)
    discard(links, lists, full)
    heads = found.join(sets.select("node", "head"), "node")
    heads = heads.join(heads.groupBy("component").agg(F.min("head").alias("of")), "component").select("node", "of")
    classes = sets.select("digest", "node", "head").join(heads, "node", "left").select("digest", F.coalesce("of", "head").alias("of"))
    out = rows.drop("sketch").withColumn("digest", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest"))).join(classes, "digest", "left")
    own = F.struct("doc_id", "tag")
    component = F.coalesce("of.doc_id", "doc_id")
    return out.select("doc_id", "tag", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), F.coalesce("of", own).eqNullSafe(own).alias("first"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=85).select("doc_id", "n_shingles", "component_id", "kept")
