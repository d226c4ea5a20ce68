"""Exact quantiles by counts of ranges: no task and no driver holds more than a bounded number of values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges of a round within one range, the accuracy they are estimated with, and how many values of a range are looked at one by one.
_EDGES, _ACCURACY, _FEW = 256, 10_000, 20_000


def _counts(edges: np.ndarray):
    """For each partition, how many values are in each part of the edges: part 2 i + 1 is edge i itself, part 2 i lies before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(2 * len(edges) + 1, dtype=np.int64)
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            found += np.bincount(np.searchsorted(edges, v, "left") + np.searchsorted(edges, v, "right"), minlength=len(found))
        parts = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"part": parts.astype(np.int32), "n": found[parts]})

    return run


def _within(low: float, high: float) -> Column:
    """v strictly between two finite or infinite ends."""
    sides = [F.col("v") > low] if math.isfinite(low) else []
    sides += [F.col("v") < high] if math.isfinite(high) else []
    return sides[0] & sides[-1] if sides else F.lit(True)


def order_statistics(values: DataFrame, ranks: list[int], few: int = _FEW) -> dict[int, float]:
    """The values at ranks from 0 on, of a table v without nulls, NaN or infinite values; each rank must be below its number of rows.

    Round by round, estimated edges cut the range that holds a rank into some hundred parts, all values of it are counted by part,
    and the range becomes the part with the rank, or the rank's value is an edge itself. Ranges of up to `few` values are sorted
    at once. Estimates only choose the edges, so that the result is exact; repeated values are counted, not kept."""
    known: dict[int, float] = {}
    ranges = [(-math.inf, math.inf, 0, values.count(), sorted(set(ranks)))]  # ends, values before it, values in it, its ranks
    while ranges:
        small, large = [x for x in ranges if x[3] <= few], [x for x in ranges if x[3] > few]
        if small:
            of = values.where(F.expr("false") if not small else _any(_within(x[0], x[1]) for x in small))
            found = np.sort(of.toArrow().column("v").to_numpy())  # at most `few` a range, of which there are no more than ranks
            for low, high, before, n, wanted in small:
                own = found[np.searchsorted(found, low, "right") :][:n]
                known |= {k: float(own[k - before]) for k in wanted}
        ranges = []
        if not large:
            continue
        points = F.array(*(F.lit(k / _EDGES) for k in range(_EDGES + 1)))
        cuts = values.agg(*(F.percentile_approx(F.when(_within(x[0], x[1]), F.col("v")), points, F.lit(_ACCURACY)).alias(f"r{i}") for i, x in enumerate(large))).first()
        edges = np.unique(np.array([e for row in cuts for e in row], dtype=np.float64))
        rows = values.where(_any(_within(x[0], x[1]) for x in large)).mapInArrow(_counts(edges), "part int, n long").groupBy("part").agg(F.sum("n").alias("n"))
        counts = {r.part: r.n for r in rows.collect()}  # two for each edge
        for low, high, before, _, wanted in large:
            start, end = np.searchsorted(edges, low, "right"), np.searchsorted(edges, high, "left")
            at = before
            for part in range(2 * start, 2 * end + 1):
                n = counts.get(part, 0)
                here = [k for k in wanted if at <= k < at + n]
                if here and part % 2:
                    known |= dict.fromkeys(here, float(edges[part // 2]))
                elif here:
                    i = part // 2
                    ranges.append((float(edges[i - 1]) if i > start else low, float(edges[i]) if i < end else high, at, n, here))
                at += n
    return known


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def quantiles(df: DataFrame, value: Column, points: list[float], few: int = _FEW) -> list[float | None]:
    """The linear quantiles of the value at the points (0 to 1). Nulls, NaN and infinite values do not count; without any other, None."""
    v = value.cast("double")
    values = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    n = values.count()
    if not n:
        return [None] * len(points)
    places = [p * (n - 1) for p in points]
    known = order_statistics(values, [f(x) for x in places for f in (math.floor, math.ceil)], few)
    low, high = ([known[f(x)] for x in places] for f in (math.floor, math.ceil))
    return [a if a == b else (math.ceil(x) - x) * a + (x - math.floor(x)) * b for x, a, b in zip(places, low, high, strict=True)]


def quantile_table(df: DataFrame, value: Column, points: list[float], few: int = _FEW) -> DataFrame:
    """point, value: a row for each point."""
    found = quantiles(df, value, points, few)
    return df.sparkSession.createDataFrame([(float(p), x) for p, x in zip(points, found, strict=True)], "point double, value double")
