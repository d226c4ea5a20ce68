"""The stages from works to summaries, on small tables with results known beforehand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import graph as G
from corpuslens.operators import models, scoring, stats
from corpuslens.plans import stages
from corpuslens.sources import readers

SMALL = stages.Settings(years=(2018, 2025), folds=2, trees=5, boosts=2, replicates=200)


def work(i, **more):
    words = f"we study case{i} of the method with data{i % 5} and report result{i} in full".split()
    authors = [{"author": {"id": f"A{a}", "display_name": f"N{a}"}, "is_corresponding": False, "institutions": [{"country_code": "CN" if i % 2 else "US"}]} for a in (1, 2, 3 + i % 3)]
    out = {
        "id": f"W{i}", "doi": f"https://doi.org/10.1/{i}", "title": f"T{i}", "publication_year": 2019 + i % 6, "cited_by_count": i, "ids": {"pmcid": f"https://x.example/PMC{i}/"},
        "abstract_inverted_index": {w: [k] for k, w in enumerate(words)}, "authorships": authors, "primary_location": {"source": {"display_name": f"J{i % 2}"}}, "concepts": [], "open_access": {"is_oa": i % 2 == 0}, "referenced_works": ["W1"],
    }
    return out | more


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("works")
    odd = [work(90, publication_year=1999), work(91, abstract_inverted_index=None), work(3, cited_by_count=1, title="again"), {"id": "W92"}, {}]
    (folder / "part.json").write_text("\n".join(json.dumps(w) for w in [*(work(i) for i in range(40)), *odd]))
    return readers.works(spark, str(folder))


def test_collect(landed):
    rows = {r.paper_id: r for r in stages.collect(landed, SMALL).collect()}
    assert set(rows) == {f"W{i}" for i in range(40)} and rows["W3"].title == "T3" and rows["W3"].pmcid == "PMC3"
    few = stages.collect(landed, stages.Settings(most=5)).collect()
    assert [r.paper_id for r in few] == ["W39", "W38", "W37", "W36", "W35"]


def test_run_with_labels(spark, landed):
    flags = spark.createDataFrame([(f"10.1/{i}", None, "mill") for i in range(0, 40, 4)], "doi string, pmid string, reason string")
    methods = "The scans of every patient were read twice by two readers who did not know the outcome, and the median was kept."
    sections = [("Methods", methods)]
    articles = spark.createDataFrame([("PMC1", sections, ["Methods"], methods), ("PMC2", sections, ["Methods"], methods), ("PMC2", None, None, None), (None, sections, None, methods)], "pmcid string, sections array<struct<heading:string,text:string>>, section_headings array<string>, body_text string")
    cites = spark.createDataFrame([("W1", 1.0, 0.5)], "paper_id string, recency double, hhi double")
    out = stages.run(landed, flags, articles, cites, SMALL)
    rows = {r.paper_id: r for r in out.predictions.collect()}
    assert len(rows) == 40 and sum(r.is_retracted for r in rows.values()) == 10
    assert all(0 <= r.probability <= 1 and r.flagged == (r.probability >= 0.5) and r.probability_raw <= r.probability + 1e-12 for r in rows.values())
    assert (rows["W1"].methods_sim_max, rows["W1"].methods_in_cluster, rows["W3"].methods_sim_max, rows["W3"].methods_in_cluster) == (1.0, True, 0.0, False)
    assert (rows["W1"].recency, rows["W1"].hhi, rows["W2"].hhi) == (1.0, 0.5, 0.0)
    tables = {k: v.collect() for k, v in out.tables.items()}
    assert set(tables) == {"overall", "by_year", "before_after", "journals", "largest_journals", "open_access", "regions", "incomes", "author_pools", "geography"}
    assert tables["overall"][0].n_total == 40 == sum(r.n_papers for r in tables["journals"]) == sum(r.n_papers for r in tables["regions"])
    assert [r.publication_year for r in tables["by_year"]] == sorted(r.publication_year for r in tables["by_year"])
    assert {r.who_region_name for r in tables["regions"]} == {"Western Pacific Region", "Region of the Americas"}
    assert [(r.members, r.papers) for r in tables["author_pools"]] == [(5, 40)]
    row = out.evaluation.metrics.first()
    assert (row.n_labelled, row.n_positive) == (40, 10) and 0 <= row.roc_auc <= 1
    assert sorted(c for c, _ in out.evaluation.importances) == sorted(scoring.predictors(out.predictions)) and "roc_auc" in out.evaluation.summary()


def test_files_to_files(spark, landed, tmp_path):
    """From landed works and a label file, with a date out of range and a column name of its own kind, to written tables."""
    landed.write.json(str(tmp_path / "works"))
    rows = [f'10.1/{i},"Deep learning\nin medicine",paper mill,{"1/1/2021" if i else "1/1/1990"}' for i in range(0, 40, 4)]
    (tmp_path / "labels.csv").write_text("Original Paper DOI,Article Title,Reason,Date of retraction\n" + "\n".join(rows) + "\n")
    stages.run_files(spark, str(tmp_path / "works"), str(tmp_path / "out"), str(tmp_path / "labels.csv"), settings=SMALL)
    back = {r.paper_id: r for r in spark.read.parquet(str(tmp_path / "out" / "predictions")).collect()}
    assert len(back) == 40 and {k for k, r in back.items() if r.is_retracted} == {f"W{i}" for i in range(4, 40, 4)}
    csv = readers.predictions(spark, str(tmp_path / "out" / "predictions_csv"), spark.read.parquet(str(tmp_path / "out" / "predictions")).schema)
    assert {r.paper_id: r.flagged for r in csv.collect()} == {k: r.flagged for k, r in back.items()}
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "overall")).first().n_total == "40"
    assert spark.read.json(str(tmp_path / "out" / "evaluation")).first().n_positive == 9 and spark.read.json(str(tmp_path / "out" / "class_report")).count() == 2


def test_run_without_labels(spark, landed):
    two = spark.createDataFrame([("10.1/1", None, "mill"), ("10.1/2", None, "mill")], "doi string, pmid string, reason string")
    for given in (None, two):
        out = stages.run(landed, given, settings=SMALL)
        assert out.evaluation is None and "geography" not in out.tables and out.predictions.count() == 40


def test_run_of_nothing(spark, landed):
    out = stages.run(landed.limit(0), settings=SMALL)
    assert out.predictions.count() == 0
    row = out.tables["overall"].first()
    assert (row.n_total, row.ci_low_pct) == (0, None) and not out.tables["journals"].count()


def test_estimate(spark):
    flags = np.arange(400) % 5 == 0
    df = spark.createDataFrame([(float(x),) for x in flags], "p double")
    row = stats.estimate(df, "p").first()
    rng = np.random.default_rng(1)
    low, high = np.percentile([rng.choice(flags, 400).mean() * 100 for _ in range(4000)], [2.5, 97.5])
    assert (row.n_flagged, row.n_total, row.prevalence_pct) == (80, 400, 20.0)
    assert row.ci_low_pct == pytest.approx(low, abs=0.6) and row.ci_high_pct == pytest.approx(high, abs=0.6)


def test_largest(spark):
    df = spark.createDataFrame([(g, 1.0) for g in "aaabbbcc"], "g string, p double")
    assert [r.g for r in stats.largest(df, "g", "p", least=1, most=2).collect()] == ["a", "b"]


def test_predictors(spark, landed):
    assert len(scoring.PREDICTORS) == len(set(scoring.PREDICTORS)) == 41 and "cited_by_count" not in scoring.PREDICTORS
    features = stages.detect(stages.collect(landed, SMALL), settings=SMALL)
    assert set(scoring.PREDICTORS) - set(scoring.predictors(features)) == {"recency", "hhi"}
    assert models.geographic(scoring.PREDICTORS) == ["country_count", "geo_n_countries", "geo_is_international"]


def test_phrase_rows(spark):
    df = spark.createDataFrame([(1, "A Deep Way,\nthe deep way. deepway deep ways"), (2, None), (3, "")], "id int, text string")
    rows = T.phrase_rows(df, "text", {"deep way": "profound path", "way": None}, around=3).orderBy("phrase", "start").collect()
    assert [tuple(r) for r in rows] == [(1, "deep way", "profound path", 2, 10, "...A Deep Way, t..."), (1, "deep way", "profound path", 16, 24, "...he deep way. d..."), (1, "way", None, 7, 10, "...ep Way, t..."), (1, "way", None, 21, 24, "...ep way. d..."),]


def test_paper_citations(spark):
    df = spark.createDataFrame([(1, 2020, 2020, "J", ["a"], ["a"]), (1, 2020, None, "K", ["a"], ["b"]), (2, 2020, None, None, None, None)], "k int, y int, c int, j string, own array<string>, theirs array<string>")
    rows = G.paper_citations(df, "k", "y", "c", "j", "own", "theirs").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 1.0, 0.0, 0.5, 2, 0.5, 0.5), (2, 1, 0.0, 0.0, 0.0, 0, 0.0, 0.0)]


def test_leave_group_out(spark):
    df = spark.createDataFrame([(i, i % 4 == 0, float(i % 4 == 0) + (i % 7) / 5, float(i % 3)) for i in range(80)], "id int, y boolean, a double, b double").withColumn("y", F.col("y").cast("int"))
    row = models.leave_group_out(df, "y", "id", ["a", "b"], folds=2, trees=5, boosts=2, replicates=50).first()
    assert [t.feature for t in row.top_features] == ["a", "b"] and row.n_unlabelled == 60 and row.ci_low <= row.prevalence <= row.ci_high
