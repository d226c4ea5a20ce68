"""Quantiles by ranges, resampling by sums of partitions, author lists in blocks: against plain computations."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import graph as G
from corpuslens.operators import quantiles as Q
from corpuslens.operators import stats


def numbers(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id int, v double").repartition(3)


@pytest.mark.parametrize("few", [2, 50, 10**6])
@pytest.mark.parametrize("kind", ["spread", "ties", "mostly one", "few", "one"])
def test_quantiles(spark, kind, few):
    rng = np.random.default_rng(7)
    values = {
        "spread": rng.lognormal(0, 4, 3000), "ties": rng.integers(0, 9, 3000), "mostly one": np.where(rng.random(3000) < 0.6, 5.0, rng.normal(5, 1e-6, 3000)), "few": [3.0, -1.0, 2.0], "one": [4.0],
    }[kind]
    points = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    assert Q.quantiles(numbers(spark, values), F.col("v"), points, few) == pytest.approx(list(np.quantile(values, points)), rel=1e-12)


def test_quantiles_of_odd_values(spark):
    """Nulls, NaN and infinite values do not count; without any other there is no quantile and no quartile."""
    df = numbers(spark, [None, float("nan"), float("inf"), 1, 2, 3])
    assert Q.quantiles(df, F.col("v"), [0.5]) == [2.0]
    assert [r.q for r in stats.quartile(df, "v", "q").orderBy("id").collect()] == [None, None, "Q4", "Q1", "Q2", "Q4"]
    for empty in (df.limit(0), df.where("id < 2")):
        assert Q.quantiles(empty, F.col("v"), [0.1, 0.5]) == [None, None]
        assert {r.q for r in stats.quartile(empty, "v", "q").collect()} <= {None}


def test_order_statistics_count_rows_not_groups(spark):
    """A value that holds most rows is found by its count; the rest of the ranks stay right."""
    df = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).otherwise(7.5).alias("v"))
    want = np.sort([float(i) if i % 3 == 0 else 7.5 for i in range(100_000)])
    ranks = [0, 2, 3, 50_000, 66_669, 66_670, 80_001, 99_999]
    assert Q.order_statistics(df, ranks, few=100) == {k: want[k] for k in ranks}


def plain_means(keys, values, replicates):
    """The generator's definition, a row and a replicate at a time."""
    import hashlib

    def mixed(h):
        h ^= h >> 16
        h = h * stats.MIX[0] % 2**32
        h ^= h >> 15
        h = h * stats.MIX[1] % 2**32
        return h ^ h >> 16

    bounds = [int(c * 2**32) for c in stats.poisson_cuts()]
    out = []
    for b in range(replicates):
        w = []
        for k in keys:
            digest = hashlib.md5(str(k).encode()).hexdigest()
            h = mixed(mixed((int(digest[:8], 16) + b * stats.STEP) % 2**32) ^ int(digest[8:16], 16))
            w.append(sum(h > c for c in bounds))
        out.append(np.dot(w, values) / sum(w) if sum(w) else None)
    return out


def test_replicates(spark):
    values = [((i * 7) % 10) / 3 for i in range(40)]
    df = numbers(spark, values)
    want = plain_means(range(40), values, 30)
    for n in (1, 5):  # the same whatever the partitions are
        got = {r.b: r.m for r in stats.poisson_replicates(df.repartition(n), "id", F.col("v"), 30).collect()}
        assert [got[b] for b in range(30)] == pytest.approx(want)


def test_replicates_of_odd_rows(spark):
    """Rows without a value do not count, a null key is a key, repeated rows share weights, no rows give null ends."""
    df = numbers(spark, [1, 2, None, float("nan"), 4])
    assert stats.poisson_replicates(df, "id", F.col("v"), 20).collect() != [] and plain_means([0, 1, 4], [1, 2, 4], 20) == pytest.approx([r.m for r in stats.poisson_replicates(df, "id", F.col("v"), 20).orderBy("b").collect()])
    twice = {r.b: r.m for r in stats.poisson_replicates(df.union(df), "id", F.col("v"), 20).collect()}
    assert twice == pytest.approx({r.b: r.m for r in stats.poisson_replicates(df, "id", F.col("v"), 20).collect()})
    assert stats.poisson_replicates(df.withColumn("id", F.lit(None).cast("int")), "id", F.col("v"), 3).count() == 3
    assert tuple(stats.poisson_bootstrap(df.limit(0), "id", F.col("v")).first()) == (None, None)


def test_bootstrap_interval(spark):
    """Close to the normal interval of the mean."""
    v = np.random.default_rng(3).normal(10, 2, 2000)
    row = stats.poisson_bootstrap(numbers(spark, v), "id", F.col("v")).first()
    half = 1.96 * v.std() / np.sqrt(len(v))
    assert row.ci_low == pytest.approx(v.mean() - half, abs=half / 5) and row.ci_high == pytest.approx(v.mean() + half, abs=half / 5)


def test_one_scan_without_exploded_rows(spark):
    df = numbers(spark, range(10))
    plan = stats.poisson_replicates(df, "id", F.col("v"), 2000)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1


NET = {"P": "EABDCFG", "Q": "AB", "R": "A", "S": "GFEDA"}


def papers(spark, net):
    return spark.createDataFrame([(p, a) for p, of in net.items() for a in of] + [("P", "A"), ("P", None)], "paper string, author string")


@pytest.mark.parametrize("block", [1, 2, 3, 7, 256])
def test_pairs_in_blocks(spark, block):
    want = sorted((p, *pair) for p, of in NET.items() for pair in itertools.combinations(sorted(of), 2))
    assert sorted(map(tuple, G.author_pairs(papers(spark, NET), block=block).collect())) == want


def test_paper_of_many_authors(spark):
    """3 000 authors in blocks of 100: each pair once."""
    df = spark.range(3000).select(F.lit("P").alias("paper"), F.col("id").alias("author"))
    row = G.author_pairs(df, block=100).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b") - F.col("a")).alias("gaps"), F.min(F.col("b") - F.col("a")).alias("least")).first()
    assert (row.n, row.gaps, row.least) == (3000 * 2999 // 2, sum(d * (3000 - d) for d in range(3000)), 1)
