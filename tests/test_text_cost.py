"""The signals of a text are made once each, and odd texts keep their figures."""

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.plans import text_queries


def test_rule_score_splits_a_text_once(spark, tmp_path):
    rows = [(i, f"Text {i} of the kind. It has three sentences. The third of them is longer than that, as it is the last one here.", "s") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    df = text_queries.rule_score_by_source(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(T._SPLIT) == 1  # sentences
    assert plan.count(r"\S++") == 2  # words of the text and of each sentence
    assert [(r.source, r.n_papers) for r in df.collect()] == [("s", 12)]


@pytest.mark.parametrize(
    ("text", "n"),
    [(None, 0), ("", 0), (" \t\n\x0b\f\r", 0), ("a", 1), (" a  b\r\nc ", 3), ("\u0085", 1), ("a b\u0085", 2), ("a b \u0085", 2), ("a \u2028", 1), ("a \u2029\n", 2), (" \u2028", 1), ("a b", 1), ("a \u0085 b", 3)],
)
def test_words_of_odd_texts(spark, text, n):
    df = spark.createDataFrame([(text,)], "t string")
    trimmed = F.regexp_replace(F.coalesce("t", F.lit("")), r"^\s+|\s+$", "")
    by_gaps = F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit(r"\s+")) + 1)
    row = df.select(T.n_words(F.col("t")).alias("n"), by_gaps.alias("gaps"), T.per_thousand(F.lit(3), T.n_words(F.col("t"))).alias("rate")).first()
    assert (row.n, row.gaps, row.rate) == (n, n, 3 / n * 1000 if n else 0.0)


def test_what_a_pattern_needs():
    found = {
        "delve into": ["delve into"], "(?:first|firstly),? .{10,80}(?:third|thirdly)": ["first"], "(?:x|y) (?:some|many) (?:problems|issues)": ["problems", "issues"],
        "(?:there (?:never|always)|it) is": [" is"], "(?:problems|issues)? of": [" of"], "one|(?:problems|issues)": [], r"[(](?:problems|issues)\(a": ["problems", "issues"], "(?!(?:problems|issues))of": ["of"], "[ab]": [],
    }
    assert {p: T.needed(p) for p in found} == found


def test_patterns_count_as_without_a_search(spark):
    texts = [None, "", "however, it still some issues", "nevertheless there are still many problems. However it remains several limitations", "HOWEVER", "first, 0123456789abcde second, 0123456789abcde thirdly", "compared with other methods, in comparison with existing approaches", "has become popular; has emerged as an important", "offering a novel method and provides a new strategy", "the findings reveal that the results show that"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low = T.lowered(F.col("t"))
    plain = sum((F.regexp_count(low, F.lit(p)) for p in text_queries.PATTERNS), F.lit(0))
    rows = df.select(T.count_patterns(F.col("t"), text_queries.PATTERNS).alias("n"), plain.alias("plain")).collect()
    assert [r.n for r in rows] == [r.plain for r in rows] == [0, 0, 1, 2, 0, 1, 2, 2, 2, 2]


def test_phrases_keep_their_edges(spark):
    text = "Of the of the, xof the of thex 1of the é of thé OF THE"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    made = T.phrase_signals(F.col("t"), ["of the", "the, "])
    assert [tuple(r) for r in df.select(made["tortured_count"], made["tortured_unique"]).collect()] == [(3, 3), (0, 0), (0, 0)]
