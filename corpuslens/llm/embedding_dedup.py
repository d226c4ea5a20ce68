"""Operator 5: near-duplicate vectors by sorted projection passes.

Equal vectors collapse first. Each pass puts the vectors in lexicographic order of SIGNS concatenated signs of random
projections, deals ranges of that order to tasks, and compares every vector with the WINDOW next ones; the vectors at the ends of
neighbouring ranges are compared across the border. Verified pairs are united across passes. Two vectors at the threshold agree in a
sign with probability p = 1 - arccos(threshold) / pi, and stand within a window once they agree in log2(n / WINDOW)
signs, so `passes` takes as many as leave a lone pair out of all windows with a probability of at most MISS. No task sends
more links than join something new. Each united component is then compared within itself in pairs of blocks, which gives
every vector's exact number of links there. No pair is written out.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with null id, link with
nothing and are kept; vectors of different lengths never link; equal rows count as different vectors; equal keys stand in the order
of ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ._io import discard, stored, table

#: The probability that a lone link at the threshold is in no window, places that a vector is compared with, and signs of a key.
MISS, WINDOW, SIGNS = 1e-5, 512, 62
#: Rows of a range of the order, and in a block of a component; passes in a round.
ROWS, BLOCK, ROUND = 8192, 512, 4


def passes(n: int, threshold: float, miss: float = MISS, window: int = WINDOW) -> int:
    """Passes over n vectors that keep to the miss probability."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    met = agree ** max(0.0, math.log2(max(n, 1) / window))
    return 1 if met >= 1 else math.ceil(math.log(miss) / math.log1p(-met))


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keyed(first: int, last: int, signs: int):
    """Each vector once for each pass, with its key."""
    planes: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = np.asarray(batch.column("dim"))
            for d in np.unique(dim):
                some = batch.take(pa.array(np.flatnonzero(dim == d)))
                for t in range(first, last):
                    plane = planes.setdefault((t, int(d)), np.random.default_rng([t, int(d)]).standard_normal((int(d), signs)))
                    key = (_unit(some.column("vec")) @ plane > 0) @ (1 << np.arange(signs, dtype=np.int64)[::-1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key), *(some.column(c) for c in ("rep", "dim", "vec"))], names=["t", "key", "rep", "dim", "vec"])

    return run


def _joins(ids: np.ndarray, close: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of the close pairs of rows of left and right those that join what label (of all rows) holds apart; label is brought up to date."""
    for k in np.flatnonzero((close & (label[right] != label[left][:, None])).any(1)).tolist():
        a, near = left[k], right[close[k]]
        near = near[label[near] != label[a]]
        joined, first = np.unique(label[near], return_index=True)
        yield from ((int(ids[a]), int(ids[b])) for b in near[first])
        label[np.isin(label, joined)] = label[a]


def _compared(vec: str):
    """Columns of links (a, b) and of rows at a range's ends (border, side, place, rep, dim, vec)."""
    return f"a long, b long, border int, side int, place int, rep long, dim int, vec {vec}"


def _windows(threshold: float, window: int, strip: int = 256):
    """Links within a range of the order, and its first and last rows for what lies beyond its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seen, tail = TaskContext.get().partitionId(), 0, None

        def ends(rows: pa.RecordBatch, border: int, side: int, place: np.ndarray) -> pa.RecordBatch:
            n = rows.num_rows
            of = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *(pa.array(np.broadcast_to(np.asarray(x, np.int32), n)) for x in (border, side, place)), *(rows.column(c) for c in ("rep", "dim", "vec"))]
            return pa.RecordBatch.from_arrays(of, names=["a", "b", "border", "side", "place", "rep", "dim", "vec"])

        for batch in batches:
            batch = batch.select(["rep", "dim", "vec"])
            if seen < window and here > 0:
                some = batch.slice(0, window - seen)
                yield ends(some, here - 1, 1, seen + np.arange(some.num_rows))
            seen += batch.num_rows
            both = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks().to_batches()[0]
            old, links = both.num_rows - batch.num_rows, []
            dim, ids = np.asarray(both.column("dim")), np.asarray(both.column("rep"))
            cuts = np.flatnonzero(np.diff(dim, prepend=-1, append=-1))
            label = np.arange(len(ids))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                x = _unit(both.column("vec").slice(lo, hi - lo))
                for at in range(max(old - lo, 0), hi - lo, strip):
                    rows, cols = np.arange(at, min(at + strip, hi - lo)), np.arange(max(0, at - window), min(at + strip, hi - lo))
                    gap = rows[:, None] - cols
                    close = (x[rows] @ x[cols].T >= threshold) & (gap > 0) & (gap <= window)
                    links += _joins(ids, close, lo + rows, lo + cols, label)
            if links:
                n = len(links)
                a, b = zip(*links, strict=True)
                none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), batch.schema.field("vec").type)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none], names=["a", "b", "border", "side", "place", "rep", "dim", "vec"])
            tail = both.slice(max(0, both.num_rows - window))
        if tail is not None:
            yield ends(tail, here, 0, np.arange(tail.num_rows)[::-1])

    return run


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _across(threshold: float, window: int):
    """Links between the last rows before a border and the first ones after it."""

    def run(rows: pa.Table) -> pa.Table:
        side, place, dim, ids = (rows.column(c).to_numpy() for c in ("side", "place", "dim", "rep"))
        label, links = np.arange(len(ids)), []
        for d in np.unique(dim):
            left, right = (np.flatnonzero((dim == d) & (side == k)) for k in (0, 1))
            if len(left) and len(right):
                x, y = (_unit(rows.column("vec").take(pa.array(at))) for at in (left, right))
                close = (x @ y.T >= threshold) & (place[left][:, None] + place[right] < window)
                links += _joins(ids, close, left, right, label)
        return pa.table(list(map(list, zip(*links, strict=True))) or [[], []], schema=_LINKS)

    return run


def _counted(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        block, many = rows.column("block").to_numpy(), rows.column("many").to_numpy()
        x, ids = _unit(rows.column("vec")), rows.column("rep").to_numpy()
        close = x @ x.T >= threshold
        np.fill_diagonal(close, False)
        if rows.column("i")[0] != rows.column("j")[0]:
            close &= block[:, None] != block
        return pa.table([ids, close @ many], names=["rep", "n"])

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, miss: float = MISS, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fine = F.col("vec_id").isNotNull() & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0)
    df = df.withColumn("fine", F.coalesce(fine, F.lit(False)))
    digest = [F.xxhash64("vec").alias("d1"), F.xxhash64(F.reverse("vec")).alias("d2")]
    same = df.where("fine").groupBy(*digest).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"), F.first("vec").alias("vec"))
    same = stored(same.withColumn("dim", F.size("vec")), "vectors")
    n = same.count()
    turns, links = passes(n, threshold, miss, window), []
    for t in range(0, turns, ROUND):
        last = min(t + ROUND, turns)
        keyed = same.select("rep", "dim", "vec").mapInArrow(_keyed(t, last, SIGNS), f"t int, key long, rep long, dim int, vec {kind}")
        ordered = keyed.repartitionByRange(max(1, -(-n * (last - t) // ROWS)), "t", "dim", "key", "rep").sortWithinPartitions("t", "dim", "key", "rep")
        part = stored(ordered.mapInArrow(_windows(threshold, window), _compared(kind)), "windows")
        across = part.where("border is not null").select("border", "side", "place", "rep", "dim", "vec").groupBy("border").applyInArrow(_across(threshold, window), "a long, b long")
        links.append(stored(part.where("a is not null").select("a", "b").union(across).distinct(), "links"))
        discard(part)
    pairs = links[0]
    for x in links[1:]:
        pairs = pairs.union(x)
    found = components(pairs.distinct())
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    dealt = same.join(found.withColumnRenamed("node", "rep"), "rep").join(sizes, "component")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).select("rep", "vec", "many", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    counts = dealt.groupBy("component", "i", "j").applyInArrow(_counted(threshold), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    of = same.select("d1", "d2", "rep", "many").join(found.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    of = of.select("d1", "d2", F.coalesce("component", "rep").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n"))
    out = df.select("vec_id", "fine", *(F.when(F.col("fine"), d).alias(name) for d, name in zip(digest, ("d1", "d2"), strict=True))).join(of, ["d1", "d2"], "left")
    component = F.coalesce("of", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
