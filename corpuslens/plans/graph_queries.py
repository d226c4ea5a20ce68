"""Queries over author and citation graphs, text similarity and models, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import steady
from ..operators import graph as G
from ..operators import models, scoring
from ..operators import similarity as N
from ..operators.storage import spread
from .table_queries import labelled, read
from .text_queries import PATTERNS, PHRASES, WHITE, W, q, r

QUERIES, ORACLES = {}, {}
COLUMNS = ["n_chars", "boilerplate_density", "vocabulary_diversity", "sentence_length_cv", "ai_mean_word_length", "ai_hapax_ratio"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders as papers, suppliers as authors."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("author"))


_PAIRS = "e AS (SELECT DISTINCT l_orderkey AS paper, l_suppkey AS author FROM lineitem), p AS (SELECT x.paper, x.author AS a, y.author AS b FROM e x JOIN e y ON x.paper = y.paper AND x.author < y.author), n AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b)"


@query(f"WITH {_PAIRS} SELECT * FROM n")
def coauthor_pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.pair_counts(G.author_pairs(edges(spark, d)))


@query(f"""WITH {_PAIRS}, w AS (SELECT author, count(*) AS papers FROM e GROUP BY author), g AS (SELECT author, count(*) AS degree FROM (SELECT a AS author FROM n UNION ALL SELECT b FROM n) GROUP BY author),
m AS (SELECT paper, count(*) AS m FROM e GROUP BY paper),
x AS (SELECT paper, max(m) AS m, avg((papers > 1)::INTEGER) AS reuse, max(papers) AS most, avg(coalesce((m - 1)::DOUBLE / degree, 0)) AS shared FROM e JOIN w USING (author) LEFT JOIN g USING (author) JOIN m USING (paper) GROUP BY paper),
y AS (SELECT paper, avg((n > 1)::INTEGER) AS density, avg(least(n / 3.0::DOUBLE, 1.0)) AS clique FROM p JOIN n USING (a, b) GROUP BY paper)
SELECT paper, {r('reuse')} AS author_reuse_rate, most AS max_author_papers, {r('CASE WHEN m > 1 THEN density ELSE 0 END')} AS coauthor_density, {r('CASE WHEN m > 1 THEN shared ELSE 0 END')} AS shared_coauthor_ratio,
{r('CASE WHEN m > 1 THEN clique ELSE 0 END')} AS clique_score, {r('CASE WHEN m > 1 THEN 1 - density ELSE 1 END')} AS pair_novelty FROM x LEFT JOIN y USING (paper)""")
def author_network(spark: SparkSession, d: str) -> DataFrame:
    return G.network_features(edges(spark, d))


@query(f"""WITH RECURSIVE {_PAIRS}, s AS (SELECT a, b FROM n WHERE n >= 3), sym AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
reach AS (SELECT DISTINCT a AS node, a AS head FROM sym UNION SELECT sym.b, reach.head FROM reach JOIN sym ON sym.a = reach.node), h AS (SELECT node, min(head) AS pool FROM reach GROUP BY node),
z AS (SELECT pool, count(*) AS members FROM h GROUP BY pool HAVING count(*) >= 3), t AS (SELECT pool, count(*) AS ties FROM s JOIN h ON s.a = h.node GROUP BY pool), j AS (SELECT pool, count(DISTINCT paper) AS papers FROM e JOIN h ON e.author = h.node GROUP BY pool)
SELECT pool, members, papers, {r('ties / (members * (members - 1) / 2.0::DOUBLE)')} AS density FROM z JOIN t USING (pool) JOIN j USING (pool)""")
def author_pools(spark: SparkSession, d: str) -> DataFrame:
    return G.author_pools(edges(spark, d))


@query(f"""WITH c AS (SELECT DISTINCT l_orderkey AS src, l_orderkey + l_partkey % 9 - 4 AS dst FROM lineitem), i AS (SELECT * FROM c WHERE dst IN (SELECT l_orderkey FROM lineitem)),
x AS (SELECT a.src AS node, {r('count(b.src)::DOUBLE / count(*)')} AS ring_score FROM i a LEFT JOIN i b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
SELECT node, coalesce(ring_score, 0.0) AS ring_score FROM (SELECT DISTINCT l_orderkey AS node FROM lineitem) LEFT JOIN x USING (node)""")
def citation_ring(spark: SparkSession, d: str) -> DataFrame:
    """Orders as papers; each line cites an order nearby."""
    cites = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_orderkey") + F.col("l_partkey") % 9 - 4).alias("dst"))
    return G.citation_ring(cites.select(F.col("src").alias("node")), cites)


@query(f"""WITH c AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY l_suppkey) AS share FROM c)
SELECT l_suppkey, {r('sum(share * share)')} AS hhi, count(*) AS journals, {r('max(share)')} AS max_share FROM s GROUP BY l_suppkey""")
def citation_concentration(spark: SparkSession, d: str) -> DataFrame:
    refs = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(read(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return G.concentration(refs, "l_suppkey", "p_brand")


@query(f"SELECT l_suppkey, {r('avg((2000 - year(l_shipdate) <= 2)::INTEGER)')} AS recency, {r('quantile_cont(2000 - year(l_shipdate), 0.5)')} AS median_age FROM lineitem WHERE year(l_shipdate) <= 2000 GROUP BY l_suppkey")
def citation_recency(spark: SparkSession, d: str) -> DataFrame:
    refs = read(spark, d, "lineitem").select("l_suppkey", F.lit(2000).alias("year"), F.year("l_shipdate").alias("cited"))
    return G.recency(refs, "l_suppkey", "year", "cited")


@query(f"SELECT l_suppkey, {r('avg((l_suppkey % 7 = l_partkey % 7 OR l_suppkey % 7 = l_linenumber)::INTEGER)')} AS self_citation_rate FROM lineitem GROUP BY l_suppkey")
def self_citation(spark: SparkSession, d: str) -> DataFrame:
    refs = read(spark, d, "lineitem").select("l_suppkey", F.array(F.col("l_suppkey") % 7).alias("own"), F.array(F.col("l_partkey") % 7, F.col("l_linenumber").cast("long")).alias("theirs"))
    return G.self_citation(refs, "l_suppkey", "own", "theirs")


_stop = ", ".join(map(q, N.STOP_WORDS))
_tfidf = lambda most, longer: f"""d AS (SELECT doc_id, text AS t FROM documents WHERE length(trim(coalesce(text, ''), {WHITE})) > {longer}),
w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(t), '[{W}]{{2,}}'), lambda x: x NOT IN ({_stop})) AS w FROM d),
terms AS (SELECT doc_id, unnest(w || CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS term FROM w),
c AS (SELECT doc_id AS doc, term, count(*) AS n FROM terms GROUP BY ALL),
v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM d)) / (1.0 + count(*))) + 1.0 AS idf FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY sum(n) DESC, term LIMIT {most}),
x AS (SELECT doc, term, (1.0 + ln(n::DOUBLE)) * idf AS raw FROM c JOIN v USING (term)),
wt AS (SELECT doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS wt FROM x)"""  # noqa: E731
_TFIDF = _tfidf(5000, 50)
_COS = "cs AS (SELECT a.doc AS i, b.doc AS j, round(sum(a.wt * b.wt), 9) AS cos FROM wt a JOIN wt b ON a.term = b.term AND a.doc <> b.doc GROUP BY ALL)"


@query(f"WITH {_TFIDF} SELECT doc, term, {r('wt')} AS wt FROM wt")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return N.tfidf(read(spark, d, "documents"), "doc_id", "text").select("doc", "term", steady(F.col("wt")).alias("wt"))


@query(f"""WITH {_TFIDF}, {_COS}, f AS (SELECT i AS doc, max(cos) AS best, sum(cos) AS total, count(*) FILTER (cos >= 0.85) AS n_high, count(*) FILTER (cos >= 0.65) AS n_moderate FROM cs GROUP BY i),
near AS (SELECT i AS doc, min(j) AS nearest FROM cs JOIN f ON cs.i = f.doc AND cs.cos = f.best GROUP BY i)
SELECT doc_id AS doc, {r('coalesce(best, 0)')} AS sim_max, {r('coalesce(total / (SELECT count(DISTINCT doc) FROM wt), 0)')} AS sim_mean, coalesce(n_high, 0) AS n_high, coalesce(n_moderate, 0) AS n_moderate, coalesce(nearest, -1) AS nearest
FROM documents LEFT JOIN f ON doc_id = f.doc LEFT JOIN near ON doc_id = near.doc""")
def similarity_features(spark: SparkSession, d: str) -> DataFrame:
    return N.similarity_features(read(spark, d, "documents"), "doc_id", "text").na.fill(-1, ["nearest"])


@query(f"""WITH RECURSIVE {_TFIDF}, {_COS}, l AS (SELECT i, j FROM cs WHERE cos >= 0.85), reach AS (SELECT DISTINCT i AS node, i AS head FROM l UNION SELECT l.j, reach.head FROM reach JOIN l ON l.i = reach.node),
h AS (SELECT node, min(head) AS cluster FROM reach GROUP BY node), s AS (SELECT node AS doc, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM h) SELECT * FROM s WHERE size >= 3""")
def similarity_clusters(spark: SparkSession, d: str) -> DataFrame:
    return N.clusters(read(spark, d, "documents"), "doc_id", "text")


@query(f"""WITH {_tfidf(3000, 100)}, {_COS}, f AS (SELECT i AS doc, max(cos) AS best, sum(cos) AS total, count(*) FILTER (cos >= 0.85) AS n_high, count(*) FILTER (cos >= 0.65) AS n_moderate FROM cs GROUP BY i)
SELECT 'PMC' || doc_id AS pmcid, {r('coalesce(best, 0)')} AS methods_sim_max, {r('coalesce(total / (SELECT count(DISTINCT doc) FROM wt), 0)')} AS methods_sim_mean, coalesce(n_high, 0) AS methods_n_high, coalesce(n_moderate, 0) AS methods_n_moderate, coalesce(n_high, 0) >= 1 AS methods_in_cluster FROM documents LEFT JOIN f ON doc_id = f.doc""")
def methods_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.concat(F.lit("PMC"), F.col("doc_id")).alias("pmcid"), F.col("text").alias("methods"))
    return N.methods_similarity(rows).drop("methods_nearest")


@query(f"""WITH RECURSIVE {_tfidf(3000, 100)}, {_COS}, l AS (SELECT i, j FROM cs WHERE cos >= 0.85), reach AS (SELECT DISTINCT i AS node, i AS head FROM l UNION SELECT l.j, reach.head FROM reach JOIN l ON l.i = reach.node),
h AS (SELECT node, min(head) AS head FROM reach GROUP BY node), k AS (SELECT 'PMC' || node AS pmcid, head FROM h) SELECT pmcid, min(pmcid) OVER (PARTITION BY head) AS cluster, count(*) OVER (PARTITION BY head) AS size FROM k""")
def methods_clusters(spark: SparkSession, d: str) -> DataFrame:
    return N.methods_clusters(read(spark, d, "documents").select(F.concat(F.lit("PMC"), F.col("doc_id")).alias("pmcid"), F.col("text").alias("methods")))


_REFS = "x AS (SELECT l_orderkey, p_brand, l_suppkey, year(l_shipdate) AS cited, l_suppkey % 7 = l_partkey % 7 OR l_suppkey % 7 = l_linenumber AS own FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"


@query(f"""WITH {_REFS}, a AS (SELECT l_orderkey, count(*) AS "references", avg((2000 - cited <= 2)::INTEGER) FILTER (cited <= 2000) AS recency, quantile_cont(2000 - cited, 0.5) FILTER (cited <= 2000) AS median_age, avg(own::INTEGER) AS self_rate FROM x GROUP BY l_orderkey),
c AS (SELECT l_orderkey, p_brand, count(*) AS n FROM x WHERE trim(p_brand) <> '' GROUP BY ALL), s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY l_orderkey) AS share FROM c), h AS (SELECT l_orderkey, sum(share * share) AS hhi, count(*) AS journals, max(share) AS max_share FROM s GROUP BY l_orderkey)
SELECT l_orderkey, "references", {r('coalesce(recency, 0)')} AS recency, {r('coalesce(median_age, 0)')} AS median_age, {r('coalesce(hhi, 0)')} AS hhi, coalesce(journals, 0) AS journals, {r('coalesce(max_share, 0)')} AS max_share, {r('self_rate')} AS self_citation_rate FROM a LEFT JOIN h USING (l_orderkey)""")
def paper_citations(spark: SparkSession, d: str) -> DataFrame:
    refs = read(spark, d, "lineitem").join(read(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
    refs = refs.select("l_orderkey", F.lit(2000).alias("year"), F.year("l_shipdate").alias("cited"), "p_brand", F.array(F.col("l_suppkey") % 7).alias("own"), F.array(F.col("l_partkey") % 7, F.col("l_linenumber").cast("long")).alias("theirs"))
    return G.paper_citations(refs, "l_orderkey", "year", "cited", "p_brand", "own", "theirs")


@query()
def article_records(spark: SparkSession, d: str) -> DataFrame:
    """Every text as the XML of an article, parsed into sections, with its structure signals."""
    from ..sources.readers import articles

    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit("<article><front><article-title>Paper</article-title></front><body><sec><title>1. Methods</title><p>"), F.replace(escaped, F.lit("\n"), F.lit("</p></sec><sec><title>Results</title><p>")), F.lit("</p></sec></body></article>"))
    rows = articles(read(spark, d, "documents").select("doc_id", body.alias("xml")), "doc_id", "xml")
    made = T.section_signals(F.col("section_headings"))
    return rows.select("pmcid", F.size("sections").alias("n_sections"), made["section_count"].alias("section_count"), made["has_standard_imrad"].alias("has_standard_imrad"), T.methods_share(F.col("sections")).alias("methods_share"), F.length(T.methods_text(F.col("sections"), F.col("body_text"))).alias("methods_chars"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as papers, with made-up authors, countries and counts."""
    docs = read(spark, d, "documents")
    id_ = F.col("doc_id")
    return docs.select(
        id_.alias("paper_id"), F.concat(F.lit("PMC"), id_).alias("pmcid"), F.col("text").alias("abstract"), F.concat_ws(";", F.concat(F.lit("A"), id_ % 97), F.concat(F.lit("A"), (id_ * 7) % 89)).alias("author_ids"),
        F.concat(F.lit("A"), id_ % 97).alias("first_author_id"), F.when(id_ % 3 == 0, "CN").when(id_ % 3 == 1, "US;DE").alias("corresponding_countries"), F.when(id_ % 5 > 0, "US;IN").alias("all_countries"),
        (id_ % 41).alias("cited_by_count"), (id_ % 60).cast("int").alias("referenced_works_count"),
    )


@query()
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.feature_matrix(corpus(spark, d), PHRASES)
    return out.drop("abstract").withColumn("score", scoring.rule_score(out))


def _training(spark: SparkSession, d: str) -> DataFrame:
    made = T.boilerplate(F.col("text"), PATTERNS) | T.uniformity(F.col("text"))
    df = T.prepared(spread(read(spark, d, "documents")), F.col("text"))
    made |= T.generated_signals(F.col("text"))
    return df.select("doc_id", *(made[c].alias(c) for c in COLUMNS if c in made)).join(labelled(spark, d).select("doc_id", "source", "n_chars", "quality"), "doc_id").withColumn("bad", 1 - F.col("quality"))


@query()
def ensemble_oof(spark: SparkSession, d: str) -> DataFrame:
    return models.out_of_fold(_training(spark, d), "bad", "doc_id", COLUMNS, folds=3, trees=10, boosts=5).select("doc_id", "bad", "fold", "probability")


@query()
def predict_pu(spark: SparkSession, d: str) -> DataFrame:
    return models.predict(_training(spark, d), "bad", "doc_id", COLUMNS, folds=3, trees=10, boosts=5).select("doc_id", "probability_raw", "label_frequency", "probability", "flagged")


@query()
def sensitivity_without_columns(spark: SparkSession, d: str) -> DataFrame:
    return models.without_columns(_training(spark, d), "bad", "doc_id", COLUMNS, ["ai_mean_word_length", "n_chars"], folds=2, trees=10, boosts=5)


@query()
def leave_group_out(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.labels import without_journals

    return models.leave_group_out(without_journals(_training(spark, d), "source", ["src0$", "src7"]), "bad", "doc_id", COLUMNS, folds=2, trees=10, boosts=5, replicates=200)


@query()
def full_run(spark: SparkSession, d: str) -> DataFrame:
    """All stages over orders as works, labels from orders: predictions of every paper."""
    from . import stages
    from .table_queries import works

    flags = read(spark, d, "orders").where("o_totalprice > 400000").select(F.concat(F.lit("10.1/"), F.col("o_orderkey")).alias("doi"), F.lit(None).cast("string").alias("pmid"), F.col("o_orderstatus").alias("reason"))
    settings = stages.Settings(years=(1990, 2030), cutoff_year=1998, folds=2, trees=10, boosts=5, replicates=200)
    out = stages.run(works(spark, d), flags, settings=settings).predictions
    return out.select("paper_id", "is_retracted", "probability", "flagged")
