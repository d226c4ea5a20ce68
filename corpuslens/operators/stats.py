"""Grouped prevalence, tests and resampling. Flags are score >= threshold; null and NaN scores count as not flagged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import steady
from .quantiles import quantiles


def flag(score: str, threshold: float = 0.5) -> Column:
    return F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")) >= threshold, F.lit(False))


def percent(part: Column, of: Column, digits: int = 6) -> Column:
    return steady(F.when(of > 0, part / of * 100), digits)


def overall(df: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    """A1, A4: one row."""
    hit = F.sum(flag(score, threshold).cast("long"))
    n = F.count(F.lit(1))
    return df.agg(F.coalesce(hit, F.lit(0)).alias("n_flagged"), n.alias("n_total"), percent(F.coalesce(hit, F.lit(0)), n).alias("prevalence_pct"))


def estimate(df: DataFrame, score: str, threshold: float = 0.5, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """A1, A4 with B1: overall() with ci_low_pct and ci_high_pct, the 2.5 and 97.5 % points of resampled prevalence.

    A resample of n flags with x hits has a binomial total, so replicates need the two counts only. No rows: null interval."""

    @F.pandas_udf("struct<ci_low_pct:double,ci_high_pct:double>")
    def interval(n: pd.Series, hits: pd.Series) -> pd.DataFrame:
        found = [binomial_interval(int(a), int(b), replicates, seed) for a, b in zip(n, hits, strict=True)]
        return pd.DataFrame(found, columns=["ci_low_pct", "ci_high_pct"]) * 100

    row = overall(df, score, threshold).withColumn("_ci", interval("n_total", "n_flagged"))  # one row
    points = (F.when(F.col("n_total") > 0, steady(F.col(f"_ci.{c}"), 2)).alias(c) for c in ("ci_low_pct", "ci_high_pct"))
    return row.select("n_flagged", "n_total", "prevalence_pct", *points)


def largest(df: DataFrame, group: str, score: str, threshold: float = 0.5, least: int = 10, most: int = 20) -> DataFrame:
    """O2: of the groups of by_group() the `most` with most rows (then by name)."""
    return by_group(df, group, score, threshold, least).orderBy(F.desc("n_papers"), group).limit(most)


def by_group(df: DataFrame, group: str, score: str, threshold: float = 0.5, least: int = 10, extra: dict[str, Column] | None = None) -> DataFrame:
    """Groups of at least `least` rows; null groups are dropped; highest prevalence first."""
    hit, n = F.sum(flag(score, threshold).cast("long")), F.count(F.lit(1))
    rows = df.where(F.col(group).isNotNull()).groupBy(group).agg(n.alias("n_papers"), hit.alias("n_flagged"), steady(F.avg(F.nanvl(F.col(score).cast("double"), F.lit(None)))).alias("mean_prob"), percent(hit, n).alias("prevalence_pct"), *(c.alias(k) for k, c in (extra or {}).items()))
    return rows.where(F.col("n_papers") >= least).orderBy(F.desc("prevalence_pct"), group)


def summaries(df: DataFrame, groups: list[str], score: str, threshold: float = 0.5) -> DataFrame:
    """A1-A3, A7, A11 in one scan: grouping (a column's name, or all), value, and by_group()'s figures for each value of each column.

    Rows are expanded once for each grouping after the scan and added up before the one shuffle. Null groups are dropped."""
    p = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    rows = df.select(p.alias("_p"), flag(score, threshold).cast("long").alias("_f"), *(F.col(g).cast("string").alias(g) for g in groups))
    pairs = F.array(*(F.struct(F.lit(g).alias("grouping"), F.col(g).alias("value")) for g in groups), F.struct(F.lit("all").alias("grouping"), F.lit(None).cast("string").alias("value")))
    long = rows.select("_p", "_f", F.inline(pairs)).where(F.col("value").isNotNull() | (F.col("grouping") == "all"))
    n, hit = F.count(F.lit(1)), F.sum("_f")
    return long.groupBy("grouping", "value").agg(n.alias("n_papers"), hit.alias("n_flagged"), steady(F.avg("_p")).alias("mean_prob"), percent(hit, n).alias("prevalence_pct"))


def means(df: DataFrame, columns: list[str], above: dict[str, float] | None = None) -> DataFrame:
    """One row with the number of rows, the columns' means, and how many rows are above a value."""
    counts = (F.coalesce(F.sum((F.col(c) > v).cast("long")), F.lit(0)).alias(f"n_{c}") for c, v in (above or {}).items())
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *(steady(F.avg(c)).alias(f"mean_{c}") for c in columns), *counts)


def with_share(df: DataFrame, group: str, score: str, threshold: float = 0.5, least: int = 20) -> DataFrame:
    """A10: also the share of all rows, taken before small groups go."""
    rows = by_group(df, group, score, threshold, 0)
    share = percent(F.col("n_papers"), F.sum("n_papers").over(Window.partitionBy()))  # a row per group
    return rows.withColumn("publication_share", share).where(F.col("n_papers") >= least)


def means_by(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """A5."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*(steady(F.avg(c)).alias(c) for c in columns)).orderBy(group)


def before_after(df: DataFrame, year: str, score: str, cutoff: int, threshold: float = 0.5) -> DataFrame:
    """Pooled two-proportion z; null rates on an empty side; z is 0 where the pooled rate is 0 or 1."""
    late = F.col(year) >= cutoff
    hit = flag(score, threshold)
    side = lambda cond: (F.sum(F.when(cond, 1).otherwise(0)), F.sum(F.when(cond & hit, 1).otherwise(0)))
    (n0, x0), (n1, x1) = side(F.col(year) < cutoff), side(late)
    row = df.agg(n0.alias("n_before"), x0.alias("x0"), n1.alias("n_after"), x1.alias("x1"))
    p0, p1 = F.try_divide("x0", "n_before"), F.try_divide("x1", "n_after")
    pooled = F.try_divide(F.col("x0") + F.col("x1"), F.col("n_before") + F.col("n_after"))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("n_before")) + F.try_divide(F.lit(1.0), F.col("n_after"))))
    z = F.when((pooled <= 0) | (pooled >= 1), 0.0).otherwise((p1 - p0) / error)
    return row.select("n_before", "n_after", steady(p0 * 100).alias("rate_before"), steady(p1 * 100).alias("rate_after"), steady((p1 - p0) * 100).alias("change"), steady(z).alias("z"))


def two_sides(df: DataFrame, side: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row for a boolean column's true and false; nulls are in neither."""
    hit, p = flag(score, threshold), F.col(score).cast("double")
    out = []
    for name, cond in (("yes", F.col(side)), ("no", ~F.col(side))):
        n, x = F.sum(F.when(cond, 1).otherwise(0)), F.sum(F.when(cond & hit, 1).otherwise(0))
        out += [n.alias(f"n_{name}"), percent(x, n).alias(f"pct_{name}"), steady(F.avg(F.when(cond, p))).alias(f"mean_{name}")]
    return df.agg(*out)


def quartile(df: DataFrame, value: str, name: str = "quartile") -> DataFrame:
    """Right-closed cuts at the linear 25, 50 and 75 % points of the value, negatives as 0; ties share a quartile, missing values have none."""
    v = F.greatest(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    v = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), v)
    cuts = quantiles(df, v, [0.25, 0.5, 0.75])
    if cuts[0] is None:
        return df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumn(name, F.when(v <= cuts[0], "Q1").when(v <= cuts[1], "Q2").when(v <= cuts[2], "Q3").when(v.isNotNull(), "Q4"))


#: Odd 32-bit constants of the counter-based generator: a step for each replicate, and two multipliers of its mixing.
STEP, MIX = 0x9E3779B9, (0x7FEB352D, 0x846CA68B)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Well mixed 32-bit numbers, in place."""
    h ^= h >> np.uint32(16)
    h *= np.uint32(MIX[0])
    h ^= h >> np.uint32(15)
    h *= np.uint32(MIX[1])
    h ^= h >> np.uint32(16)
    return h


def poisson_cuts() -> list[float]:
    """Poisson(1): a uniform number's weight is the number of cuts that are not above it, 8 at most."""
    total, chance, cuts = 0.0, float(np.exp(-1)), []
    for k in range(8):
        total += chance
        cuts.append(round(total, 12))
        chance /= k + 1
    return cuts


def _replicate_sums(replicates: int, rows_at_once: int = 512):
    """For each partition a row for each replicate: the sum of weights and the sum of weighted values of all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(replicates, dtype=np.uint32) * np.uint32(STEP)
        bounds = (np.array(poisson_cuts()) * 2.0**32).astype(np.uint64)
        weights, sums, some = np.zeros(replicates), np.zeros(replicates), False
        for batch in batches:
            first, second, value = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for at in range(0, len(value), rows_at_once):
                part = slice(at, at + rows_at_once)
                h = _mixed(first[part].astype(np.uint32)[:, None] + numbers[None, :])
                h = _mixed(h ^ second[part].astype(np.uint32)[:, None])
                w = np.zeros(h.shape, dtype=np.int8)
                for bound in bounds:
                    w += h > np.uint32(bound)
                weights += w.sum(axis=0, dtype=np.int64)
                sums += value[part] @ w
                some = True
        if some:
            yield pa.RecordBatch.from_pydict({"b": np.arange(replicates, dtype=np.int32), "w": weights, "v": sums})

    return run


def poisson_replicates(df: DataFrame, key: str, value: Column, replicates: int = 2000) -> DataFrame:
    """b, m: each replicate's mean of the value, in one scan. Rows without a value or with NaN do not count; no rows, no replicates.

    A row's weight in a replicate is Poisson(1), from 64 bits of its key's hash and the replicate's number, so that the result
    does not depend on partitioning; rows of one key share their weights. A partition gives one sum a replicate, whatever its rows."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    rows = df.select(word(1).alias("first"), word(9).alias("second"), v.alias("v")).where("v IS NOT NULL")
    parts = rows.mapInArrow(_replicate_sums(replicates), "b int, w double, v double")
    return parts.groupBy("b").agg(F.try_divide(F.sum("v"), F.sum("w")).alias("m"))


def poisson_bootstrap(df: DataFrame, key: str, value: Column, replicates: int = 2000) -> DataFrame:
    """B1: low, high: 2.5 and 97.5 % points of poisson_replicates()."""
    means = poisson_replicates(df, key, value, replicates)  # a row for each replicate
    return means.agg(steady(F.percentile("m", 0.025)).alias("ci_low"), steady(F.percentile("m", 0.975)).alias("ci_high"))


def binomial_interval(n: int, hits: int, replicates: int = 2000, seed: int = 42) -> tuple[float, float]:
    """B1 for flags: a resample's total is binomial."""
    if not n:
        return float("nan"), float("nan")
    draws = np.random.default_rng(seed).binomial(n, hits / n, replicates) / n
    return tuple(float(x) for x in np.percentile(draws, [2.5, 97.5]))
