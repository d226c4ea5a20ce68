"""Hand-computed results of the library's own operators."""

import math

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import fixed_values as V
from corpuslens.functions import records as R
from corpuslens.functions import text as T
from corpuslens.operators import graph as G
from corpuslens.operators import labels as L
from corpuslens.operators import metrics as M
from corpuslens.operators import scoring, stats
from corpuslens.sources import readers


def one(spark, column, **values):
    schema = {str: "string", int: "int", float: "double", list: "array<string>"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {schema[type(v)] if v is not None else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def papers(spark, **of):
    return spark.createDataFrame([(p, a) for p, authors in of.items() for a in authors], "paper string, author string")


NET = {"P1": "ABC", "P2": "AB", "P3": "D", "P4": "AB"}


def test_network(spark):
    rows = {r.paper: tuple(round(x, 4) for x in r[1:]) for r in G.network_features(papers(spark, **NET)).collect()}
    assert rows["P1"] == (0.6667, 3, 0.3333, 1.0, 0.5556, 0.6667)
    assert rows["P2"] == rows["P4"] == (1.0, 3, 1.0, 0.5, 1.0, 0.0)
    assert rows["P3"] == (0.0, 1, 0.0, 0.0, 0.0, 1.0)


def test_network_repeated_author(spark):
    assert G.author_pairs(papers(spark, P="AAB")).collect() == [("P", "A", "B")]


def test_pools(spark):
    assert G.author_pools(papers(spark, **NET)).count() == 0
    assert [tuple(r) for r in G.author_pools(papers(spark, **NET), least=2).collect()] == [("A", 2, 3, 1.0)]


def test_ring(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "A"), ("C", "X")], "src string, dst string")
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "node string")
    assert {tuple(r) for r in G.citation_ring(nodes, edges).collect()} == {("A", 0.5), ("B", 1.0), ("C", 0.0)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r.node: r.component for r in G.components(edges).collect()}
    assert set(found[i] for i in range(41)) == {0} and found[101] == 100


def test_citations(spark):
    rows = spark.createDataFrame([(1, j) for j in ("J1", "J1", "J2", "", None)], "k int, j string")
    assert tuple(round(x, 4) for x in G.concentration(rows, "k", "j").first()[1:]) == (0.5556, 2, 0.6667)
    ages = spark.createDataFrame([(1, 2020, y) for y in (2020, 2019, 2015, None, 2021)], "k int, y int, c int")
    assert tuple(round(x, 4) for x in G.recency(ages, "k", "y", "c").first()[1:]) == (0.6667, 1.0)


def test_z_and_quartiles(spark):
    rows = spark.createDataFrame([(2022, p) for p in (0.9, 0.1, 0.1, 0.1)] + [(2023, p) for p in (0.9, 0.9, 0.9, 0.1)], "y int, p double")
    r = stats.before_after(rows, "y", "p", 2023).first()
    assert (r.rate_before, r.rate_after, r.change, round(r.z, 3)) == (25.0, 75.0, 50.0, 1.414)
    empty = stats.before_after(rows, "y", "p", 1900).first()
    assert empty.rate_before is None and empty.z is None
    values = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    assert [r.quartile for r in stats.quartile(values, "v").orderBy("v").collect()] == ["Q1", "Q1", "Q2", "Q3", "Q4"]


def test_flags_of_missing_scores(spark):
    rows = spark.createDataFrame([(0.9,), (None,), (float("nan"),)], "p double")
    assert tuple(stats.overall(rows, "p").first()) == (1, 3, 33.333333)


def test_interval():
    low, high = stats.binomial_interval(100, 50)
    assert 0.35 < low < 0.5 < high < 0.65 and math.isnan(stats.binomial_interval(0, 0)[0])


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, p double")
    assert M.roc_auc(rows, "y", "p").first()[0] == 0.75
    assert round(M.average_precision(rows, "y", "p").first()[0], 4) == 0.8333
    assert tuple(M.best_f1(rows, "y", "p").first()) == (0.7, 0.8)
    positives = spark.createDataFrame([(1, p, i) for i, p in enumerate((0.9, 0.8, 0.4))], "y int, p double, k int")
    assert tuple(M.label_frequency(positives, "y", "p", "k").first()) == pytest.approx((0.7, 0.9, 0.9))
    assert tuple(M.label_frequency(positives.where("y = 0"), "y", "p", "k").first()) == (1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        M.pu_summary(positives, "y", "p", "k", "e4")


def test_rule_score(spark):
    values = {"tortured_count": 1.0, "methods_sim_max": 0.5, "sim_max": 0.4, "coauthor_density": 0.2, "boilerplate_density": 10.0, "interaction_ai_x_tortured": 2.5, "author_reuse_rate": 0.5, "ai_sentence_uniformity": 0.6, "ai_vocab_diversity": 0.7, "ai_discourse_density": 15.0, "geo_is_international": 0.0}
    df = spark.createDataFrame([tuple(values.values())], list(values))
    assert df.select(scoring.rule_score(df).alias("s")).first().s == pytest.approx(0.515)
    assert df.select("sim_max").select(scoring.rule_score(df.select("sim_max")).alias("s")).first().s == pytest.approx(0.04)


def test_geography(spark):
    df = spark.createDataFrame([("CN;US", None), (None, " us"), ("", "")], "corresponding_countries string, all_countries string")
    rows = R.geography_features(R.with_geography(df), "corresponding_countries").collect()
    assert [(r.who_region, r.income_group) for r in rows] == [("WPR", "UMIC"), ("AMR", "HIC"), ("Unknown", "Unknown")]
    assert (rows[0].geo_n_countries, rows[0].geo_is_international) == (2.0, 1.0)
    assert len(V.COUNTRY_REGIONS) == 195 and len(V.COUNTRY_INCOMES) == 61


def test_index_round_trip(spark):
    df = spark.createDataFrame([({"deep": [0, 3], "learning": [1], "is": [2]},), ({},), (None,)], "m map<string,array<int>>")
    assert [r.t for r in df.select(R.abstract_from_index(F.col("m")).alias("t")).collect()] == ["deep learning is deep", None, None]


def test_phrases(spark):
    text = "Profound learning and profound learning; a collector working trademark bend.\nThe x-beam, xx-beam and profound\nlearning."
    made = T.phrase_signals(F.col("t"), list(V.PHRASES))
    row = spark.createDataFrame([(text,), (None,)], "t string").select(*(c.alias(k) for k, c in made.items())).collect()
    assert (row[0].tortured_count, row[0].tortured_unique) == (5, 5) and row[1].tortured_count == 0
    assert len(V.PHRASES) == 94


def test_length_gates(spark):
    for n, zero in ((99, True), (100, False)):
        text = ("word " * 40)[: n - 1] + "x"
        assert (one(spark, T.uniformity(F.col("t"))["vocabulary_diversity"], t=text) == 0) is zero
    assert one(spark, T.template_score(F.col("t")), t="The first sentence. The second sentence.") == 0.0
    got = one(spark, T.template_score(F.col("t")), t="With the rise of x. This study is new. We used data. In conclusion it works.")
    assert got == pytest.approx(1.0)


def test_headings(spark):
    headings = ["1. Introduction", "2. Methods", "2.1 Dataset", "2.2 Proposed Method", "2.3 Statistical Analysis", "3. Results", "4. Discussion", "5. Conclusion"]
    made = T.section_signals(F.col("h"))
    row = spark.createDataFrame([(headings,)], "h array<string>").select(*(c.alias(k) for k, c in made.items())).first()
    assert tuple(row) == (True, 8, 0.625)


def test_labels(spark):
    raw = spark.createDataFrame([("A deep learning paper", "J", "Paper Mill", "https://doi.org/10.1/X", "1/2/2021 0:00"), ("Other", "J", "Error", "10.1/y", "bad")], ["Title", "Journal", "Reason", "OriginalPaperDOI", "RetractionDate"])
    ready = L.prepared(raw, (2020, 2022))
    assert [(r.doi, r.retraction_year) for r in ready.collect()] == [("https://doi.org/10.1/X", 2021)]
    corpus = spark.createDataFrame([("10.1/x ", "5"), (None, "6")], "doi string, pmid string")
    rows = L.matched(corpus, ready.withColumn("pmid", F.lit("6"))).orderBy("pmid").collect()
    assert [(r.is_retracted, r.retraction_reason) for r in rows] == [(True, "Paper Mill"), (True, "")]


def test_article():
    xml = "<article><front><article-title>T</article-title></front><body><sec><title>A</title><p>x</p><sec><title>B</title><p>y <b>z</b></p></sec></sec><sec><title>C</title></sec></body><back><ref-list><ref/><ref/></ref-list></back></article>"
    got = readers.parse_article(xml)
    assert got["sections"] == [{"heading": "A", "text": "x"}, {"heading": "B", "text": "y z"}] and got["references_count"] == 2
    assert readers.parse_article("<broken")["sections"] == [] and readers.parse_article(None)["title"] == ""


def test_lexicon(spark, tmp_path):
    (tmp_path / "a.csv").write_text("tortured,correct\nFake Forest ,Random forest\n,x\n")
    (tmp_path / "b.json").write_text('{"fake forest": "other", "new one": "n"}')
    merged = readers.merged_lexicon(readers.lexicon(spark, str(tmp_path / "a.csv")), readers.lexicon(spark, str(tmp_path / "b.json")))
    assert {tuple(r) for r in merged.collect()} == {("fake forest", "other"), ("new one", "n")}


def test_label_columns(spark):
    """Common names of label tables, in any case; the first of a kind counts."""
    from corpuslens.operators import labels

    names = ["Article Title", "Journal", "Subject", "Reason", "DOI", "Original PMID", "Date Retracted", "Original Publication Date", "Notes"]
    df = spark.createDataFrame([("x",) * len(names)], ", ".join(f"`{n}` string" for n in names))
    assert labels.named(df).columns == ["title", "journal", "subject", "reason", "doi", "pmid", "retraction_date", "original_date", "Notes"]


def test_components_of_chains_and_stars(spark):
    from corpuslens.operators.graph import components

    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 200)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(10, 41)} | {i: 100 for i in range(100, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_certain_part():
    from corpuslens.functions.text import certain

    assert [certain(p) for p in ("delve into", "it'?s so", "(?:a|b) of cd?", "one|two", "x[ab]{2,3}yz", r"ab\d+cde")] == ["delve into", "s so", " of c", "", "yz", "cde"]
