"""Queries over statistics, metrics, labels and records, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import records as R
from ..functions.text import steady
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import stats as S
from ..operators.quantiles import quantile_table
from .text_queries import q, r


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels and a made-up score in hundredths."""
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", (((F.col("doc_id") * 37 + F.col("n_chars")) % 101) / 100).alias("score"))
    return docs.join(read(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("year"), F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("score"))


DOCS = "d AS (SELECT doc_id, source, lang, n_chars, ((doc_id * 37 + n_chars) % 101) / 100.0::DOUBLE AS score, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
ORDERS = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, year(o_orderdate)::INTEGER AS year, least(o_totalprice / 500000, 1.0) AS score FROM orders)"


def _group_sql(source: str, group: str, least: int, threshold: float, extra: str = "", where: str = "") -> str:
    return f"""SELECT {group}, count(*) AS n_papers, (count(*) FILTER (score >= {threshold}))::BIGINT AS n_flagged, {r('avg(score)')} AS mean_prob,
{r(f'(count(*) FILTER (score >= {threshold}))::DOUBLE / count(*) * 100')} AS prevalence_pct{extra} FROM {source} WHERE {group} IS NOT NULL {where} GROUP BY {group} HAVING count(*) >= {least}"""


QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {DOCS} SELECT (count(*) FILTER (score >= 0.5))::BIGINT AS n_flagged, count(*) AS n_total, {r('(count(*) FILTER (score >= 0.5))::DOUBLE / count(*) * 100')} AS prevalence_pct FROM d")
def prevalence_overall(spark: SparkSession, d: str) -> DataFrame:
    return S.overall(labelled(spark, d), "score")


@query(f"WITH {DOCS} " + _group_sql("d", "source", 10, 0.5))
def prevalence_by_group(spark: SparkSession, d: str) -> DataFrame:
    return S.by_group(labelled(spark, d), "source", "score")


@query(f"WITH {ORDERS} " + _group_sql("o", "year", 0, 0.5))
def prevalence_by_year(spark: SparkSession, d: str) -> DataFrame:
    return S.by_group(orders(spark, d), "year", "score", least=0)


def _poisson_sql(replicates: int) -> str:
    """The weights step by step, so that no expression is written twice."""
    step = lambda name, of, e: f"{name} AS (SELECT b, v, s2, {e} AS h FROM {of})"
    mixed, last = [], "x0"
    for turn in range(2):
        for shift, by in ((16, S.MIX[0]), (15, S.MIX[1]), (16, None)):
            name = f"x{len(mixed) + 1}"
            e = f"xor(h, h >> {shift})"
            mixed.append(step(name, last, f"({e} * {by}::UBIGINT) & 4294967295::UBIGINT" if by else e))
            last = name
        if not turn:
            name = f"x{len(mixed) + 1}"
            mixed.append(step(name, last, "xor(h, s2)"))
            last = name
    cuts = " + ".join(f"(h > {int(c * 2.0**32)})::INTEGER" for c in S.poisson_cuts())
    return f"""WITH {DOCS}, k AS (SELECT (score >= 0.5)::INTEGER::DOUBLE AS v, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT AS s1, ('0x' || substr(md5(doc_id::VARCHAR), 9, 8))::UBIGINT AS s2 FROM d),
x0 AS (SELECT b, v, s2, (s1 + b::UBIGINT * {S.STEP}::UBIGINT) & 4294967295::UBIGINT AS h FROM k, range({replicates}) AS t(b)), {', '.join(mixed)},
w AS (SELECT b, v, {cuts} AS w FROM {last}), m AS (SELECT b, sum(w * v) / sum(w) AS m FROM w GROUP BY b)
SELECT {r('quantile_cont(m, 0.025)')} AS ci_low, {r('quantile_cont(m, 0.975)')} AS ci_high FROM m"""


@query(_poisson_sql(2000))
def bootstrap_ci_poisson(spark: SparkSession, d: str) -> DataFrame:
    return S.poisson_bootstrap(labelled(spark, d), "doc_id", S.flag("score").cast("int"))


_POINTS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


@query(" UNION ALL ".join(f"SELECT {p}::DOUBLE AS point, {r(f'quantile_cont(l_extendedprice, {p})', 4)} AS value FROM lineitem" for p in _POINTS))
def price_quantiles(spark: SparkSession, d: str) -> DataFrame:
    out = quantile_table(read(spark, d, "lineitem"), F.col("l_extendedprice"), _POINTS)
    return out.withColumn("value", steady(F.col("value"), 4))


@query(f"""WITH {ORDERS}, c AS (SELECT count(*) FILTER (year < 1998) AS n0, count(*) FILTER (year < 1998 AND score >= 0.5) AS x0, count(*) FILTER (year >= 1998) AS n1, count(*) FILTER (year >= 1998 AND score >= 0.5) AS x1 FROM o),
p AS (SELECT *, x0::DOUBLE / n0 AS p0, x1::DOUBLE / n1 AS p1, (x0 + x1)::DOUBLE / (n0 + n1) AS p FROM c)
SELECT n0 AS n_before, n1 AS n_after, {r('p0 * 100')} AS rate_before, {r('p1 * 100')} AS rate_after, {r('(p1 - p0) * 100')} AS change, {r('(p1 - p0) / sqrt(p * (1 - p) * (1.0 / n0 + 1.0 / n1))')} AS z FROM p""")
def pre_post_ztest(spark: SparkSession, d: str) -> DataFrame:
    return S.before_after(orders(spark, d), "year", "score", 1998)


@query(f"WITH {ORDERS}, j AS (SELECT * FROM o JOIN customer ON o_custkey = c_custkey) " + _group_sql("j", "c_mktsegment", 5, 0.5, f", {r('avg(o_totalprice)', 2)} AS mean_price, {r(chr(40) + 'count(*) FILTER (o_orderstatus = ' + chr(39) + 'F' + chr(39) + '))::DOUBLE / count(*)')} AS closed_share"))
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    df = orders(spark, d).join(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return S.by_group(df, "c_mktsegment", "score", least=5, extra={"mean_price": steady(F.avg("o_totalprice"), 2), "closed_share": steady(F.avg((F.col("o_orderstatus") == "F").cast("double")))})


_SIDES = ", ".join(f"count(*) FILTER ({c}) AS n_{n}, {r(f'(count(*) FILTER ({c} AND score >= 0.5))::DOUBLE / (count(*) FILTER ({c})) * 100')} AS pct_{n}, {r(f'avg(score) FILTER ({c})')} AS mean_{n}" for n, c in (("yes", "o_orderstatus = 'F'"), ("no", "o_orderstatus <> 'F'")))


@query(f"WITH {ORDERS} SELECT {_SIDES} FROM o")
def binary_split_compare(spark: SparkSession, d: str) -> DataFrame:
    return S.two_sides(orders(spark, d).withColumn("closed", F.col("o_orderstatus") == "F"), "closed", "score")


@query(f"WITH {ORDERS}, c AS (SELECT quantile_cont(greatest(o_totalprice, 0), [0.25, 0.5, 0.75]) AS c FROM o), x AS (SELECT o.*, CASE WHEN greatest(o_totalprice, 0) <= c[1] THEN 'Q1' WHEN greatest(o_totalprice, 0) <= c[2] THEN 'Q2' WHEN greatest(o_totalprice, 0) <= c[3] THEN 'Q3' ELSE 'Q4' END AS quartile FROM o, c) " + _group_sql("x", "quartile", 5, 0.5))
def prevalence_by_quartile(spark: SparkSession, d: str) -> DataFrame:
    return S.by_group(S.quartile(orders(spark, d), "o_totalprice"), "quartile", "score", least=5)


@query(f"WITH {ORDERS} SELECT year, {r('avg(o_totalprice)', 2)} AS o_totalprice, {r('avg(score)')} AS score FROM o GROUP BY year")
def feature_trends(spark: SparkSession, d: str) -> DataFrame:
    out = S.means_by(orders(spark, d), "year", ["score"])
    return out.join(orders(spark, d).groupBy("year").agg(steady(F.avg("o_totalprice"), 2).alias("o_totalprice")), "year")


_SHARE = f"""SELECT *, {r('n_papers::DOUBLE / sum(n_papers) OVER () * 100')} AS publication_share FROM"""


@query(f"WITH {ORDERS}, j AS (SELECT r_name AS region, score FROM o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), g AS ({_group_sql('j', 'region', 0, 0.5)}), s AS ({_SHARE} g) SELECT * FROM s WHERE n_papers >= 20")
def region_prevalence(spark: SparkSession, d: str) -> DataFrame:
    places = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    df = orders(spark, d).join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return S.with_share(df, "region", "score")


_CODES = ["US", "CN", "in", " BR ", "ET", "FR", "XX", "", "CN;US", "US; ;CN"]
_income = " ".join(f"WHEN upper(trim(code)) = {q(c)} THEN {q(g)}" for c, g in V.COUNTRY_INCOMES.items())
_region = " ".join(f"WHEN upper(trim(code)) = {q(c)} THEN {q(g)}" for c, g in V.COUNTRY_REGIONS.items())


@query(f"WITH {ORDERS}, j AS (SELECT CASE {_income} ELSE 'Unknown' END AS income_group, score FROM (SELECT *, [{', '.join(map(q, _CODES))}][c_nationkey % 10 + 1] AS code FROM o JOIN customer ON o_custkey = c_custkey)) " + _group_sql("j", "income_group", 20, 0.5, where="AND income_group <> 'Unknown'"))
def income_prevalence(spark: SparkSession, d: str) -> DataFrame:
    code = F.get(F.array(*map(F.lit, _CODES)), F.col("c_nationkey") % 10)
    df = orders(spark, d).join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).withColumn("income_group", R.income(code))
    return S.by_group(df.where("income_group <> 'Unknown'"), "income_group", "score", least=20)


@query(f"""WITH v AS (SELECT c_custkey AS id, [{', '.join(map(q, _CODES))}][c_custkey % {len(_CODES)} + 1] AS every FROM customer), p AS (SELECT id, trim(split_part(every, ';', 1)) AS code, len(list_filter(string_split(every, ';'), lambda x: trim(x) <> '')) AS n FROM v)
SELECT id, code AS primary_country, CASE {_region} ELSE 'Unknown' END AS who_region, CASE {_income} ELSE 'Unknown' END AS income_group, n::DOUBLE AS geo_n_countries, (n > 1)::INTEGER::DOUBLE AS geo_is_international,
(CASE {_region} ELSE 'Unknown' END = 'WPR')::INTEGER::DOUBLE AS geo_region_WPR, (CASE {_income} ELSE 'Unknown' END = 'HIC')::INTEGER::DOUBLE AS geo_income_HIC FROM p""")
def geo_features(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("c_custkey") % len(_CODES) + 1).cast("int"))
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("corresponding_countries"), code.alias("all_countries"))
    out = R.geography_features(R.with_geography(rows))
    return out.select("id", "primary_country", "who_region", "income_group", "geo_n_countries", "geo_is_international", "geo_region_WPR", "geo_income_HIC")


_BY = "c AS (SELECT score AS p, sum(quality)::DOUBLE AS pos, count(*)::DOUBLE - sum(quality) AS neg FROM d WHERE quality IS NOT NULL GROUP BY score), w AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM c)"
_T = "(0.3), (0.4), (0.5), (0.6), (0.7), (0.8)"


@query(f"""WITH {DOCS}, t(threshold) AS (VALUES {_T}), x AS (SELECT threshold::DOUBLE AS threshold, count(*) FILTER (score >= threshold AND quality = 1) AS tp, count(*) FILTER (score >= threshold AND quality = 0) AS fp,
count(*) FILTER (score < threshold AND quality = 1) AS fn, count(*) FILTER (score < threshold AND quality = 0) AS tn FROM d, t WHERE quality IS NOT NULL GROUP BY threshold),
y AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS rc FROM x)
SELECT threshold, tp, fp, fn, tn, {r('p')} AS precision, {r('rc')} AS recall, {r('coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)')} AS specificity, {r('coalesce(2 * p * rc / nullif(p + rc, 0), 0)')} AS f1 FROM y""")
def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    return M.threshold_table(labelled(spark, d), "quality", "score")


@query(f"WITH {DOCS}, {_BY} SELECT {r('sum((tp - pos / 2) * neg) / (sum(pos) * sum(neg))')} AS roc_auc FROM w")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return M.roc_auc(labelled(spark, d), "quality", "score")


@query(f"WITH {DOCS}, {_BY} SELECT {r('sum(pos * tp / (tp + fp)) / sum(pos)')} AS average_precision FROM w")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return M.average_precision(labelled(spark, d), "quality", "score")


@query(f"WITH {DOCS}, {_BY}, f AS (SELECT p AS threshold, {r('2 * tp / (tp + fp + (SELECT sum(pos) FROM w))')} AS f1 FROM w) SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def best_f1(spark: SparkSession, d: str) -> DataFrame:
    return M.best_f1(labelled(spark, d), "quality", "score")


@query(f"""WITH {DOCS}, k(class) AS (VALUES (0), (1)), x AS (SELECT class, count(*) FILTER (quality = class AND (score >= 0.5)::INTEGER = class) AS hit, count(*) FILTER ((score >= 0.5)::INTEGER = class) AS predicted, count(*) FILTER (quality = class) AS support FROM d, k WHERE quality IS NOT NULL GROUP BY class)
SELECT class, {r('coalesce(hit::DOUBLE / nullif(predicted, 0), 0)')} AS precision, {r('coalesce(hit::DOUBLE / nullif(support, 0), 0)')} AS recall, {r('2.0 * hit / (predicted + support)')} AS f1, support FROM x""")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    return M.class_report(labelled(spark, d), "quality", "score")


_FREQ = f"f AS (SELECT score AS p, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM d WHERE quality = 1), e AS (SELECT least(greatest(avg(p), 0.01), 1.0) AS e1, least(greatest(max(p), 0.01), 1.0) AS e2, least(greatest(avg(p) FILTER (r <= greatest(n // 2, 1)), 0.01), 1.0) AS e3 FROM f)"


@query(f"WITH {DOCS}, {_FREQ} SELECT {r('e1')} AS e1, {r('e2')} AS e2, {r('e3')} AS e3 FROM e")
def label_frequency(spark: SparkSession, d: str) -> DataFrame:
    return M.label_frequency(labelled(spark, d), "quality", "score", "doc_id").select(*(steady(F.col(c)).alias(c) for c in ("e1", "e2", "e3")))


@query(f"WITH {DOCS}, {_FREQ} SELECT {r('max(e3)')} AS label_frequency, {r('avg(score)')} AS raw_prevalence, {r('avg(least(greatest(score / e3, 0), 1))')} AS corrected_prevalence, {r('greatest(sum(least(greatest(score / e3, 0), 1)) - sum(coalesce(quality, 0)), 0)', 4)} AS dark_figure FROM d, e")
def pu_correct(spark: SparkSession, d: str) -> DataFrame:
    return M.pu_summary(labelled(spark, d), "quality", "score", "doc_id")


@query("SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 5)::INTEGER AS fold FROM labels WHERE quality IS NOT NULL")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return M.stratified_folds(read(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("""WITH l AS (SELECT CASE doc_id % 3 WHEN 0 THEN ' https://doi.org/10.1/' || (doc_id // 2) WHEN 1 THEN '10.1/' || (doc_id // 2) || ' ' END AS doi, CASE WHEN doc_id % 5 = 0 THEN doc_id || ' ' END AS pmid, CASE WHEN doc_id % 4 > 0 THEN 'reason ' || (doc_id % 7) END AS reason, doc_id AS pos FROM labels),
a AS (SELECT regexp_replace(lower(trim(doi)), '^https?://(dx\\.)?doi\\.org/', '') AS k, arg_max(coalesce(reason, ''), pos) AS reason FROM l WHERE coalesce(trim(doi), '') <> '' GROUP BY 1),
b AS (SELECT DISTINCT trim(pmid) AS p FROM l WHERE coalesce(trim(pmid), '') <> '')
SELECT doc_id, (a.k IS NOT NULL OR b.p IS NOT NULL) AS is_retracted, coalesce(a.reason, '') AS retraction_reason FROM documents LEFT JOIN a ON a.k = '10.1/' || doc_id LEFT JOIN b ON b.p = doc_id::VARCHAR""")
def label_match(spark: SparkSession, d: str) -> DataFrame:
    """Two labels may have one DOI, written in two ways; a third of the labels has none, a fifth has a PMID."""
    id_ = F.col("doc_id")
    doi = F.when(id_ % 3 == 0, F.concat(F.lit(" https://doi.org/10.1/"), F.floor(id_ / 2))).when(id_ % 3 == 1, F.concat(F.lit("10.1/"), F.floor(id_ / 2), F.lit(" ")))
    rows = read(spark, d, "labels").select(doi.alias("doi"), F.when(id_ % 5 == 0, F.concat(id_, F.lit(" "))).alias("pmid"), F.when(id_ % 4 > 0, F.concat(F.lit("reason "), id_ % 7)).alias("reason"), id_.alias("at"))
    corpus = read(spark, d, "documents").select("doc_id", F.concat(F.lit("https://doi.org/10.1/"), id_).alias("doi"), id_.cast("string").alias("pmid"))
    return L.matched(corpus, rows, "at").select("doc_id", "is_retracted", "retraction_reason")


_TITLES = ["Deep Learning for ", "A U-Net study of ", "Began here: ", "Plain "]
_REASONS = ["Paper Mill; other", "Error", "concerns/issues about data", None, "UNRELIABLE DATA"]
_pick = lambda values, n: f"[{', '.join('NULL' if v is None else q(v) for v in values)}][{n} % {len(values)} + 1]"


@query(f"""WITH l AS (SELECT o_orderkey AS id, {_pick(_TITLES, 'o_orderkey')} || o_orderpriority AS title, CASE WHEN o_custkey % 3 > 0 THEN 'about LSTM ' || o_orderstatus END AS subject, {_pick(_REASONS, 'o_custkey')} AS reason, o_orderdate FROM orders)
SELECT id, coalesce(regexp_matches(reason, {q('(?i)' + '|'.join(V.FRAUD_REASONS))}), false) AS fraud, regexp_matches(coalesce(title, '') || ' ' || coalesce(subject, ''), {q('(?i)' + '|'.join(f'{chr(92)}b{t}{chr(92)}b' for t in V.TOPICS))}) AS on_topic,
CASE WHEN id % 4 = 3 THEN 0 ELSE year(o_orderdate) END::INTEGER AS year FROM l""")
def label_filters(spark: SparkSession, d: str) -> DataFrame:
    """Orders as labels; dates in three forms, and every fourth one no date."""
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col(n) % len(values)).cast("int"))
    form = F.col("o_orderkey") % 4
    day = F.when(form == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(form == 1, F.date_format("o_orderdate", "M/d/yyyy H:mm")).when(form == 2, F.date_format("o_orderdate", "yyyy/M/d")).otherwise("undated")
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(pick(_TITLES, "o_orderkey"), F.col("o_orderpriority")).alias("title"), F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("about LSTM "), F.col("o_orderstatus"))).alias("subject"), pick(_REASONS, "o_custkey").alias("reason"), day.alias("day"))
    return rows.select("id", L.fraud(F.col("reason")).alias("fraud"), L.on_topic(F.col("title"), F.col("subject")).alias("on_topic"), F.coalesce(F.year(L.lenient_date(F.col("day"))), F.lit(0)).alias("year"))


@query("SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedupe_first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("text_md5"))
    return L.first_seen(rows, "text_md5", ["doc_id"])


@query("SELECT doc_id, source FROM documents WHERE NOT coalesce(regexp_matches(source, '(?i)SRC1|src7'), false)")
def group_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return L.without_journals(read(spark, d, "documents").select("doc_id", "source"), "source", ["SRC1", "src7"])


_codes = lambda x: f"list_filter([CASE WHEN {x}.p % 2 = 0 THEN 'US' END, CASE WHEN {x}.p % 3 = 0 THEN 'CN' ELSE 'DE' END], lambda c: c IS NOT NULL)"


@query(f"""WITH l AS (SELECT l_orderkey, list({{'s': l_suppkey, 'p': l_partkey, 'f': l_returnflag, 'c': l_linestatus = 'F' AND l_linenumber > 1}} ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag, l_linestatus) AS a FROM lineitem GROUP BY l_orderkey),
w AS (SELECT *, list_filter(a, lambda x: x.c) AS m FROM orders JOIN l ON o_orderkey = l_orderkey), v AS (SELECT *, CASE WHEN len(m) > 0 THEN m[1] ELSE a[-1] END AS k FROM w)
SELECT 'W' || o_orderkey AS paper_id, CASE WHEN o_orderkey % 3 > 0 THEN '10.1/' || o_orderkey END AS doi, CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey)::VARCHAR END AS pmid, CASE WHEN o_orderkey % 5 > 0 THEN 'PMC' || o_custkey END AS pmcid, o_orderpriority AS title,
o_orderpriority || ' ' || o_orderstatus || ' ' || o_orderpriority AS abstract, year(o_orderdate)::INTEGER AS publication_year, o_custkey AS cited_by_count, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS journal_name, len(a)::INTEGER AS author_count,
'S' || a[1].s AS first_author_name, CASE WHEN a[1].s % 11 = 0 THEN '' ELSE 'A' || a[1].s END AS first_author_id, array_to_string(list_transform(list_filter(a, lambda x: x.s % 11 > 0), lambda x: 'A' || x.s), ';') AS author_ids, array_to_string({_codes('k')}, ';') AS corresponding_countries,
array_to_string(list_sort(list_distinct(flatten(list_transform(a, lambda x: {_codes('x')})))), ';') AS all_countries, array_to_string(list_transform(a[:10], lambda x: x.f), ';') AS concepts, o_orderstatus = 'F' AS is_oa, len(a)::INTEGER AS referenced_works_count, array_to_string(list_transform(a[:50], lambda x: 'W' || x.p), ';') AS referenced_works FROM v""")
def corpus_flatten(spark: SparkSession, d: str) -> DataFrame:
    return R.flat_record(works(spark, d))


def works(spark: SparkSession, d: str) -> DataFrame:
    """Orders as works, their lines as authors and references, through the JSON that works are landed in."""
    from ..sources.readers import WORK

    cols = ["l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus"]
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("of"))  # at most a few lines an order
    places = lambda x: F.array(F.struct(F.when(x["l_partkey"] % 2 == 0, "US").alias("country_code")), F.struct(F.when(x["l_partkey"] % 3 == 0, "CN").otherwise("DE").alias("country_code")))
    who = lambda x: F.struct(F.when(x["l_suppkey"] % 11 == 0, "").otherwise(F.concat(F.lit("A"), x["l_suppkey"])).alias("id"), F.concat(F.lit("S"), x["l_suppkey"]).alias("display_name"))
    author = lambda x: F.struct(who(x).alias("author"), ((x["l_linestatus"] == "F") & (x["l_linenumber"] > 1)).alias("is_corresponding"), places(x).alias("institutions"))
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    work = F.struct(
        F.concat(F.lit("W"), key).alias("id"), F.when(key % 3 > 0, F.concat(F.lit("10.1/"), key)).alias("doi"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("publication_year"), customer.alias("cited_by_count"),
        F.struct(F.when(key % 4 > 0, customer.cast("string")).alias("pmid"), F.when(key % 5 > 0, F.concat(F.lit("https://articles.example/PMC"), customer, F.lit("/"))).alias("pmcid")).alias("ids"),
        F.create_map("o_orderpriority", F.array(F.lit(0), F.lit(2)), "o_orderstatus", F.array(F.lit(1))).alias("abstract_inverted_index"), F.transform("of", author).alias("authorships"),
        F.when(key % 7 > 0, F.struct(F.struct(F.col("o_orderpriority").alias("display_name")).alias("source"))).alias("primary_location"), F.transform("of", lambda x: F.struct(x["l_returnflag"].alias("display_name"))).alias("concepts"),
        F.struct((F.col("o_orderstatus") == "F").alias("is_oa")).alias("open_access"), F.transform("of", lambda x: F.concat(F.lit("W"), x["l_partkey"])).alias("referenced_works"),
    )
    rows = read(spark, d, "orders").join(lines, key == F.col("l_orderkey"))
    return rows.select(F.from_json(F.to_json(work), WORK).alias("w")).select("w.*")


@query()
def prevalence_estimate(spark: SparkSession, d: str) -> DataFrame:
    return S.estimate(labelled(spark, d), "score")


@query(f"WITH {ORDERS}, g AS ({_group_sql('o', 'o_custkey', 10, 0.5)}) SELECT * FROM g ORDER BY n_papers DESC, o_custkey LIMIT 20")
def largest_groups(spark: SparkSession, d: str) -> DataFrame:
    return S.largest(orders(spark, d), "o_custkey", "score")
