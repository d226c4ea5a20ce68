"""Queries over collections in order of arrival, lexicons as tables, one-pass summaries and reports at a chosen threshold, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.text import steady
from ..operators import collection as C
from ..operators import graph as G
from ..operators import lexicon as X
from ..operators import metrics as M
from ..operators import stats as S
from ..operators.manifest import Manifest
from ..operators.storage import shared_folder
from ..sources.readers import write_table
from . import text_queries
from .graph_queries import edges
from .table_queries import _BY, DOCS, labelled, read
from .text_queries import PHRASES, WORDS, W, docs, q, r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FIXED = V.PHRASES | {p: p.upper() for p in PHRASES}
#: More words than any phrase of FIXED has.
MOST_WORDS = 8


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """The built-in phrases, those of the other text queries, and the first two words of every document, if they differ."""
    fixed = spark.createDataFrame(sorted(FIXED.items()), "phrase string, correction string")
    part = lambda k: F.lower(F.regexp_extract("text", rf"^[^{W}]*+(([{W}]++)[^{W}]++([{W}]++))", k))
    own = docs(spark, d).where(part(2) != part(3)).select(part(1).alias("phrase"), F.lit(None).cast("string").alias("correction"))
    return fixed.union(own.distinct().join(fixed, "phrase", "left_anti"))


_PIECES = f"regexp_extract_all(coalesce(text, ''), '[{W}]+[^{W}]*')"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '[^{W}]+$', '')"


_FIXED = ", ".join(f"({q(a)}, {q(b)})" for a, b in sorted(FIXED.items()))
_LEXICON = f"""w AS (SELECT doc_id, text, {_PIECES} AS p FROM documents),
fixed(phrase, correction) AS (VALUES {_FIXED}),
own AS (SELECT DISTINCT lower({_bare('p[1] || p[2]')}) AS phrase FROM w WHERE len(p) > 1 AND lower({_bare('p[1]')}) <> lower({_bare('p[2]')})),
lexicon AS (SELECT phrase, correction FROM fixed UNION ALL SELECT phrase, NULL FROM own WHERE phrase NOT IN (SELECT phrase FROM fixed)),
runs AS (SELECT doc_id, i - 1 AS place, n, {_bare("array_to_string(list_slice(p, i, i + n - 1), '')")} AS surface FROM w, range(1, {MOST_WORDS}) AS a(n), unnest(range(1, len(p) + 1)) AS b(i) WHERE i + n - 1 <= len(p)),
found AS (SELECT doc_id, phrase, correction, place::INTEGER AS place, surface FROM runs JOIN lexicon ON lower(surface) = phrase)"""


@query(f"WITH {_LEXICON} SELECT * FROM found")
def lexicon_matches(spark: SparkSession, d: str) -> DataFrame:
    return X.matches(docs(spark, d), "doc_id", "text", lexicon(spark, d))


@query(f"""WITH {_LEXICON}, c AS (SELECT doc_id, count(*) AS n, count(DISTINCT surface) AS u FROM found GROUP BY doc_id), l AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS words FROM documents)
SELECT doc_id, coalesce(n, 0) AS tortured_count, {r('CASE WHEN words > 0 THEN coalesce(n, 0)::DOUBLE / words * 1000 ELSE 0.0 END')} AS tortured_density, coalesce(u, 0) AS tortured_unique FROM l LEFT JOIN c USING (doc_id)""")
def lexicon_signals(spark: SparkSession, d: str) -> DataFrame:
    out = X.signals(docs(spark, d), "doc_id", "text", lexicon(spark, d))
    return out.withColumn("tortured_density", steady(F.col("tortured_density")))


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as search results of five queries; a customer's orders are copies of one paper, open orders have no abstract."""
    key = F.col("o_orderkey")
    return read(spark, d, "orders").select((key % 5).cast("int").alias("query"), (key % 61).cast("int").alias("page"), key.cast("long").alias("place"), F.col("o_custkey").alias("id"), (F.col("o_orderstatus") != "O").alias("with_abstract"))


_HITS = "hits AS (SELECT (o_orderkey % 5)::INTEGER AS query, (o_orderkey % 61)::INTEGER AS page, o_orderkey AS place, o_custkey AS id, o_orderstatus <> 'O' AS with_abstract FROM orders)"


@query(f"""WITH {_HITS}, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query, page, place) AS k FROM hits),
a AS (SELECT query, page, place, id, row_number() OVER (ORDER BY query, page, place) AS arrival FROM f WHERE k = 1 AND with_abstract) SELECT * FROM a WHERE arrival <= 1000""")
def collected_papers(spark: SparkSession, d: str) -> DataFrame:
    """At most 1 000 papers in order of arrival, the operator's own cap."""
    return C.arrived(hits(spark, d), "id", F.col("with_abstract"), 1000).select("query", "page", "place", "id", "arrival")


def _searched_sql(queries: list[int], cap: int) -> str:
    parts, seen = [_HITS], []
    for k, n in enumerate(queries):
        old = " UNION ALL ".join(f"SELECT id FROM seen{j}" for j in seen) or "SELECT NULL::BIGINT AS id WHERE false"
        parts.append(f"new{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page, place) AS copy FROM hits WHERE query = {n} AND id NOT IN ({old})) WHERE copy = 1)")
        parts.append(f"run{k} AS (SELECT *, sum(with_abstract::INTEGER) OVER (ORDER BY page, place) AS kept FROM new{k})")
        parts.append(f"seen{k} AS (SELECT id FROM run{k} WHERE kept < {cap} OR (kept = {cap} AND with_abstract))")
        parts.append(f"taken{k} AS (SELECT {k}::INTEGER AS query_no, page, place, id, kept::BIGINT AS arrival FROM run{k} WHERE with_abstract AND kept <= {cap})")
        seen.append(k)
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM taken{k}" for k in seen)


@query(_searched_sql([3, 0, 4, 1, 2], 200))
def searched_papers(spark: SparkSession, d: str) -> DataFrame:
    """At most 200 papers a query, the operator's own cap."""
    return C.searched(hits(spark, d), "id", F.col("with_abstract"), 200, [3, 0, 4, 1, 2]).select("query_no", "page", "place", "id", "arrival")


_GROUPS = ["source", "lang", "year"]


@query(f"WITH {DOCS}, g AS (SELECT *, doc_id % 9 AS year FROM d) " + " UNION ALL ".join(f"""SELECT '{c}' AS grouping, {c}::VARCHAR AS value, count(*) AS n_papers, (count(*) FILTER (score >= 0.5))::BIGINT AS n_flagged, {r('avg(score)')} AS mean_prob,
{r('(count(*) FILTER (score >= 0.5))::DOUBLE / count(*) * 100')} AS prevalence_pct FROM g WHERE {c} IS NOT NULL GROUP BY {c}""" for c in _GROUPS) + f""" UNION ALL SELECT 'all', NULL, count(*), (count(*) FILTER (score >= 0.5))::BIGINT, {r('avg(score)')}, {r('(count(*) FILTER (score >= 0.5))::DOUBLE / count(*) * 100')} FROM g""")
def summaries_at_once(spark: SparkSession, d: str) -> DataFrame:
    return S.summaries(labelled(spark, d).withColumn("year", F.col("doc_id") % 9), _GROUPS, "score")


_NETWORK = """e AS (SELECT DISTINCT l_orderkey AS paper, l_suppkey AS author FROM lineitem), w AS (SELECT author, count(*) AS papers FROM e GROUP BY author), x AS (SELECT paper, avg((papers > 1)::INTEGER) AS reuse, max(papers) AS most FROM e JOIN w USING (author) GROUP BY paper)"""


@query(f"WITH {_NETWORK} SELECT count(*) AS n_rows, {r('avg(reuse)')} AS mean_author_reuse_rate, {r('avg(most)')} AS mean_max_author_papers, count(*) FILTER (reuse > 0.5) AS n_author_reuse_rate FROM x")
def network_means(spark: SparkSession, d: str) -> DataFrame:
    """A17 of the author network."""
    return S.means(G.network_features(edges(spark, d)), ["author_reuse_rate", "max_author_papers"], {"author_reuse_rate": 0.5})


@query(f"""WITH {DOCS}, {_BY}, f AS (SELECT p AS threshold, 2 * tp / (tp + fp + (SELECT sum(pos) FROM w)) AS f1 FROM w), best AS (SELECT threshold FROM f ORDER BY f1 DESC, threshold LIMIT 1),
k(class) AS (VALUES (0), (1)), z AS (SELECT quality, (score >= threshold)::INTEGER AS z FROM d, best WHERE quality IS NOT NULL),
x AS (SELECT class, count(*) FILTER (quality = class AND z = class) AS hit, count(*) FILTER (z = class) AS predicted, count(*) FILTER (quality = class) AS support FROM z, k GROUP BY class)
SELECT class, {r('coalesce(hit::DOUBLE / nullif(predicted, 0), 0)')} AS precision, {r('coalesce(hit::DOUBLE / nullif(support, 0), 0)')} AS recall, {r('2.0 * hit / (predicted + support)')} AS f1, support FROM x""")
def class_report_at_best(spark: SparkSession, d: str) -> DataFrame:
    return M.report_at_best(labelled(spark, d), "quality", "score")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE year(l_shipdate) = 1995 AND l_suppkey BETWEEN 3 AND 60 GROUP BY l_returnflag, l_linestatus")
def published_year(spark: SparkSession, d: str) -> DataFrame:
    """K1: the line items published by year of shipping and ranges of suppliers, read back by one year and some suppliers."""
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year"))
    write_table(lines, path, by=["year"], order=["l_suppkey"])
    rows = spark.read.parquet(path).where((F.col("year") == 1995) & F.col("l_suppkey").between(3, 60))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.count_distinct("l_orderkey").alias("orders"))


@query(text_queries.ORACLES["ai_text_features"])
def kept_text_signals(spark: SparkSession, d: str) -> DataFrame:
    """The signals of every document's text, kept by content: first of the texts of labelled documents, then of what is new."""
    book = Manifest(spark, f"{shared_folder(spark)}/signals-{uuid.uuid4().hex}")
    made = T.generated_signals(F.col("text"))
    signals = lambda rows: T.prepared(rows, F.col("text")).select("_digest", "text", *(c.alias(k) for k, c in made.items()))
    whole, labelled_ids = docs(spark, d).select("doc_id", "text"), read(spark, d, "labels").select("doc_id").distinct()
    book.by_content("signals", whole.join(labelled_ids, "doc_id", "left_semi"), ["text"], "generated", signals)
    out = book.by_content("signals", whole, ["text"], "generated", signals)
    return out.select("doc_id", *((F.col(k) if k == "ai_phrase_count" else steady(F.col(k))).alias(k) for k in made))
