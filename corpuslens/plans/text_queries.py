"""Queries over the text operators, with SQL that computes the same from the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import records as R
from ..functions import text as T
from ..functions.text import steady
from ..operators import scoring, stats
from ..operators.storage import spread

PHRASES = ["of the", "in the", "to be", "that is", "licensed under the", "idiot"]
PATTERNS = [*V.STOCK_SENTENCES, r"the [a-z]+ of", "licensed under", "all rights reserved"]
ROLES = {"background": "^(?:the|le|la|der|el)", "objective": "^(?:to|de|zu)", "methods": "^(?:of|in|en)", "results": "^(?:an|er|es)", "conclusion": "^(?:th|on|un)"}
HEADINGS = [
    ["1. Introduction", "2. Methods", "2.1 Dataset", "2.2 Proposed Method", "2.3 Statistical Analysis", "3. Results", "4. Discussion", "5. Conclusion"],
    ["Background", "Materials and Methods", "Findings", "Limitations", "Summary"],
    ["Introduction", "Methods", "Methods", "Results", "Discussion"],
    ["Abstract", "Our results in brief"],
    [],
]
SECTIONS = ["Intro", "2. Methods", "Results", "Study design and data", "Participants", "Other", "Notes"]


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet"))


def text_uniformity(spark: SparkSession, d: str) -> DataFrame:
    made = T.uniformity(F.col("text"))
    return docs(spark, d).select("doc_id", *(steady(c).alias(k) for k, c in made.items()))


def boilerplate_density(spark: SparkSession, d: str) -> DataFrame:
    made = T.boilerplate(F.col("text"), PATTERNS)
    return docs(spark, d).select("doc_id", made["boilerplate_count"].alias("boilerplate_count"), steady(made["boilerplate_density"]).alias("boilerplate_density"))


def phrase_detect(spark: SparkSession, d: str) -> DataFrame:
    made = T.phrase_signals(F.col("text"), PHRASES)
    return docs(spark, d).select("doc_id", made["tortured_count"].alias("tortured_count"), steady(made["tortured_density"]).alias("tortured_density"), made["tortured_unique"].alias("tortured_unique"))


def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    return T.phrase_rows(docs(spark, d).select("doc_id", "text"), "text", {p: p.upper() for p in PHRASES})


def ai_text_features(spark: SparkSession, d: str) -> DataFrame:
    df = T.prepared(docs(spark, d), F.col("text"))
    made = T.generated_signals(F.col("text"))
    return df.select("doc_id", *((c if k == "ai_phrase_count" else steady(c)).alias(k) for k, c in made.items()))


def abstract_template(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", steady(T.template_score(F.col("text"), ROLES)).alias("template_score"))


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def section_structure(spark: SparkSession, d: str) -> DataFrame:
    """A list of headings by the document's number, and the starts of its first lines."""
    given = F.element_at(F.array(*(F.array(*map(F.lit, h)).cast("array<string>") for h in HEADINGS)), (F.col("doc_id") % len(HEADINGS) + 1).cast("int"))
    rows = docs(spark, d).select("doc_id", F.concat(given, F.transform(F.slice(_lines(), 1, 3), lambda x: F.substring(x, 1, 30))).alias("headings"))
    made = T.section_signals(F.col("headings"))
    return rows.select("doc_id", made["has_standard_imrad"].alias("has_standard_imrad"), made["section_count"].alias("section_count"), steady(made["standard_section_fraction"]).alias("standard_section_fraction"))


def methods_text(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a document as a section, with a heading by its place."""
    name = lambda i: F.element_at(F.array(*map(F.lit, SECTIONS)), ((F.col("doc_id") + i) % len(SECTIONS) + 1).cast("int"))
    sections = F.transform(_lines(), lambda x, i: F.struct(name(i).alias("heading"), x.alias("text")))
    return docs(spark, d).select("doc_id", F.md5(T.methods_text(sections, F.coalesce("text", F.lit("")))).alias("methods_md5"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    df = scoring.with_interactions(scoring.text_features(docs(spark, d), "text", PHRASES, PATTERNS))
    return df.withColumn("score", scoring.rule_score(df))


def rule_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", steady(F.col("score")).alias("score"))


def rule_score_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: text signals, rule score, prevalence by source."""
    df = _scored(spark, d).select("source", steady(F.col("score")).alias("score"))
    return stats.by_group(df, "source", "score", 0.25)


def abstract_from_index(spark: SparkSession, d: str) -> DataFrame:
    """P1, a round trip: the words of each text as a map of positions, and back."""
    words = docs(spark, d).select("doc_id", F.posexplode(T.words(F.col("text"))).alias("at", "word"))
    index = words.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("at")).alias("places")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return index.select("doc_id", F.md5(R.abstract_from_index(F.col("index"))).alias("abstract_md5"))


QUERIES = {f.__name__: f for f in (text_uniformity, boilerplate_density, phrase_detect, phrase_matches, ai_text_features, abstract_template, section_structure, methods_text, rule_score, rule_score_by_source, abstract_from_index)}


# ---------------------------------------------------------------- SQL


def r(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * {10**digits}.0 + 0.500001) / {10**digits}.0"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WHITE = " || ".join(f"chr({ord(c)})" for c in T.WHITE)
W = r"\p{L}\p{M}\p{N}_"
WORDS = r"len(regexp_extract_all({}, '\S+'))"


def _sentences(longer: int) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, {WHITE})), lambda x: length(x) > {longer})"


def _cv(lens: str, least: int) -> str:
    n, s1, s2 = f"len({lens})", f"list_sum({lens})::DOUBLE", f"list_sum(list_transform({lens}, lambda x: x * x))::DOUBLE"
    return f"CASE WHEN {n} >= {least} AND {s1} > 0 THEN sqrt(greatest({s2} / {n} - ({s1} / {n}) * ({s1} / {n}), 0)) / ({s1} / {n}) ELSE 0.0 END"


BASE = "d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)"
UNIFORM = rf"""u0 AS (SELECT doc_id, t, list_transform({_sentences(10)}, lambda x: {WORDS.format('x')}) AS lens,
  list_transform(list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: trim(x, {WHITE})), lambda x: length(x) > 20), lambda x: {WORDS.format('x')}) AS plens,
  list_slice(list_transform(regexp_extract_all(t, '\S+'), lambda x: lower(x)), 1, 1000) AS f FROM d),
u AS (SELECT doc_id, CASE WHEN length(t) >= 100 THEN {_cv('lens', 3)} ELSE 0.0 END AS sentence_length_cv,
  CASE WHEN length(t) >= 100 THEN {_cv('plens', 2)} ELSE 0.0 END AS paragraph_length_cv,
  CASE WHEN length(t) >= 100 AND len(f) > 0 THEN len(list_distinct(f))::DOUBLE / len(f) ELSE 0.0 END AS vocabulary_diversity FROM u0)"""


def _count(patterns: list[str], text: str = "lower(t)") -> str:
    return " + ".join(f"len(regexp_extract_all({text}, {q(p)}))" for p in patterns)


BOILER = f"b AS (SELECT doc_id, {_count(PATTERNS)} AS boilerplate_count, {WORDS.format('t')} AS w FROM d)"
_SURFACES = " || ".join(f"regexp_extract_all(t2, {q(f'(?i)[^{W}](' + p.replace(' ', '  ') + f')[^{W}]')}, 1)" for p in PHRASES)
DOUBLED = rf"'  ' || regexp_replace(t, '([^{W}])', '\1\1', 'g') || '  '"
PHRASE = f"""p0 AS (SELECT doc_id, {WORDS.format('t')} AS w, {DOUBLED} AS t2 FROM d),
p AS (SELECT doc_id, w, {_SURFACES} AS found FROM p0)"""


def _edged(phrases: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all(t2, {q(f'[^{W}]' + p.replace(' ', '  ').replace(chr(39) + '?', chr(39) + '{0,2}') + f'[^{W}]')}))" for p in phrases)


GENERATED = rf"""g0 AS (SELECT doc_id, t, lower({DOUBLED}) AS t2,
  list_filter(regexp_extract_all(lower(t), '[{W}]+(?:''[a-z]+)?'), lambda x: regexp_full_match(x, '[a-z]+(''[a-z]+)?')) AS tk,
  list_transform({_sentences(5)}, lambda x: {WORDS.format('x')}) AS lens FROM d),
g1 AS (SELECT doc_id, count(*) AS types, count(*) FILTER (n = 1) AS once FROM (SELECT doc_id, tok, count(*) AS n FROM (SELECT doc_id, unnest(tk) AS tok FROM g0) GROUP BY ALL) GROUP BY doc_id),
g AS (SELECT doc_id, length(t) >= 100 AND len(tk) > 0 AS ok, len(list_distinct(list_slice(tk, 1, 1000)))::DOUBLE / nullif(least(len(tk), 1000), 0) AS ai_vocab_diversity,
  once::DOUBLE / types AS ai_hapax_ratio, CASE WHEN len(lens) >= 3 THEN greatest(0.0, 1 - {_cv('lens', 3)}) ELSE 0.0 END AS ai_sentence_uniformity,
  CASE WHEN len(lens) >= 3 THEN list_sum(lens)::DOUBLE / len(lens) ELSE 0.0 END AS ai_mean_sentence_length,
  ({_edged(V.DISCOURSE)})::DOUBLE / nullif(len(tk), 0) * 1000 AS ai_discourse_density, {_edged(V.GENERATED)} AS ai_phrase_count,
  ({_edged(V.GENERATED)})::DOUBLE / nullif(len(tk), 0) * 1000 AS ai_phrase_density, list_sum(list_transform(tk, lambda x: length(x)))::DOUBLE / nullif(len(tk), 0) AS ai_mean_word_length,
  len(list_filter(tk, lambda x: length(x) > 10))::DOUBLE / nullif(len(tk), 0) AS ai_long_word_ratio
  FROM g0 LEFT JOIN g1 USING (doc_id))"""
_AI = ["ai_vocab_diversity", "ai_hapax_ratio", "ai_sentence_uniformity", "ai_mean_sentence_length", "ai_discourse_density", "ai_phrase_density", "ai_mean_word_length", "ai_long_word_ratio"]
_roles = " ".join(f"WHEN regexp_matches(x, {q('(?i)' + p)}) THEN {i}" for i, p in enumerate(ROLES.values()))
SCORE = f"""s AS (SELECT doc_id, source, {r('''least(greatest(0.2 * CASE WHEN len(found) > 0 THEN 1 ELSE 0 END
  + 0.08 * least(CASE WHEN b.w > 0 THEN boilerplate_count::DOUBLE / b.w * 1000 ELSE 0.0 END, 20) / 20
  + 0.07 * least(CASE WHEN ok THEN ai_sentence_uniformity ELSE 0.0 END * least(len(found), 5), 5) / 5
  + 0.05 * least(CASE WHEN ok THEN ai_sentence_uniformity ELSE 0.0 END, 1) + 0.05 * (1 - least(CASE WHEN ok THEN ai_vocab_diversity ELSE 0.0 END, 1))
  + 0.03 * least(CASE WHEN ok THEN ai_discourse_density ELSE 0.0 END, 30) / 30, 0), 1)''')} AS score
  FROM d JOIN b USING (doc_id) JOIN p USING (doc_id) JOIN g USING (doc_id))"""


def _heading_sql(x: str) -> str:
    bare = rf"regexp_replace(lower(trim({x})), '^\d+[.)]\s*', '')"
    named = " ".join(f"WHEN {bare} = {q(a)} THEN {q(b)}" for a, b in V.SECTION_NAMES.items())
    inside = " ".join(f"WHEN contains({bare}, {q(s)}) THEN {q(s)}" for s in V.SECTIONS)
    return f"CASE {named} {inside} ELSE {bare} END"


_std = "[" + ", ".join(map(q, V.SECTIONS)) + "]"
_headings = "[" + ", ".join(f"[{', '.join(map(q, h))}]::VARCHAR[]" for h in HEADINGS) + f"][doc_id % {len(HEADINGS)} + 1]"
_sections = f"[{', '.join(map(q, SECTIONS))}]"

_starts = "list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(phrase)"
ORACLES = {
    "phrase_matches": f"""WITH v(phrase) AS (VALUES {', '.join(f'({q(p)})' for p in PHRASES)}), x AS (SELECT doc_id, text, phrase, string_split(lower(text), phrase) AS parts FROM documents, v WHERE contains(lower(text), phrase)),
y AS (SELECT *, unnest(range(1, len(parts))) AS i FROM x), z AS (SELECT doc_id, text, phrase, ({_starts})::INTEGER AS "start", ({_starts} + length(phrase))::INTEGER AS "end" FROM y)
SELECT doc_id, phrase, upper(phrase) AS correction, "start", "end", '...' || trim(replace(substr(text, greatest("start" - 50, 0) + 1, "end" + 50 - greatest("start" - 50, 0)), chr(10), ' ')) || '...' AS context FROM z
WHERE NOT regexp_matches(CASE WHEN "start" > 0 THEN substr(text, "start", 1) ELSE '' END, '[{W}]') AND NOT regexp_matches(substr(text, "end" + 1, 1), '[{W}]')""",
    "text_uniformity": f"WITH {BASE}, {UNIFORM} SELECT doc_id, {r('sentence_length_cv')} AS sentence_length_cv, {r('paragraph_length_cv')} AS paragraph_length_cv, {r('vocabulary_diversity')} AS vocabulary_diversity FROM u",
    "boilerplate_density": f"WITH {BASE}, {BOILER} SELECT doc_id, boilerplate_count, {r('CASE WHEN w > 0 THEN boilerplate_count::DOUBLE / w * 1000 ELSE 0.0 END')} AS boilerplate_density FROM b",
    "phrase_detect": f"WITH {BASE}, {PHRASE} SELECT doc_id, len(found) AS tortured_count, {r('CASE WHEN w > 0 THEN len(found)::DOUBLE / w * 1000 ELSE 0.0 END')} AS tortured_density, len(list_distinct(found)) AS tortured_unique FROM p",
    "ai_text_features": f"WITH {BASE}, {GENERATED} SELECT doc_id, CASE WHEN ok THEN ai_phrase_count ELSE 0 END AS ai_phrase_count, {', '.join(f'{r(f"CASE WHEN ok THEN {c} ELSE 0.0 END")} AS {c}' for c in _AI)} FROM g",
    "abstract_template": f"""WITH {BASE}, x AS (SELECT doc_id, list_transform({_sentences(10)}, lambda x: CASE {_roles} END) AS got FROM d),
k AS (SELECT doc_id, got, list_filter(got, lambda x: x IS NOT NULL) AS known FROM x)
SELECT doc_id, {r('''CASE WHEN len(got) >= 3 THEN 0.6 * len(known) / len(got) + 0.4 * CASE WHEN len(known) >= 3
  THEN len(list_filter(range(2, len(known) + 1), lambda i: known[i] >= known[i - 1]))::DOUBLE / (len(known) - 1) ELSE 0.0 END ELSE 0.0 END''')} AS template_score FROM k""",
    "section_structure": f"""WITH h AS (SELECT doc_id, {_headings} || list_transform(list_slice(string_split(coalesce(text, ''), chr(10)), 1, 3), lambda x: left(x, 30)) AS hs FROM documents),
n AS (SELECT doc_id, list_transform(hs, lambda x: {_heading_sql('x')}) AS names FROM h), f AS (SELECT doc_id, names, list_filter(names, lambda x: list_contains({_std}, x)) AS found, list_filter({_std}, lambda x: list_contains(names, x)) AS expected FROM n)
SELECT doc_id, found = expected AND len(expected) >= 4 AS has_standard_imrad, len(names) AS section_count, {r('CASE WHEN len(names) > 0 THEN len(found)::DOUBLE / len(names) ELSE 0.0 END')} AS standard_section_fraction FROM f""",
    "methods_text": rf"""WITH a AS (SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
s AS (SELECT *, list_transform(range(1, len(ls) + 1), lambda i: {{'heading': {_sections}[(doc_id + i - 1) % {len(SECTIONS)} + 1], 'body': ls[i]}}) AS sections FROM a),
c AS (SELECT doc_id, body, list_filter(sections, lambda s: regexp_matches(regexp_replace(lower(trim(s.heading)), '^\d+[.)]\s*', ''), {q('|'.join(V.METHODS_HEADINGS))})) AS chosen FROM s)
SELECT doc_id, md5(CASE WHEN len(chosen) > 0 THEN array_to_string(list_transform(chosen, lambda s: s.body), ' ') WHEN length(body) > 200 THEN substr(body, length(body) // 4 + 1, length(body) // 4) ELSE '' END) AS methods_md5 FROM c""",
    "rule_score": f"WITH {BASE}, {BOILER}, {PHRASE}, {GENERATED}, {SCORE} SELECT doc_id, score FROM s",
    "rule_score_by_source": f"""WITH {BASE}, {BOILER}, {PHRASE}, {GENERATED}, {SCORE} SELECT source, count(*) AS n_papers, (count(*) FILTER (score >= 0.25))::BIGINT AS n_flagged,
{r('avg(score)')} AS mean_prob, {r('(count(*) FILTER (score >= 0.25))::DOUBLE / count(*) * 100')} AS prevalence_pct FROM s WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 10""",
    "abstract_from_index": r"SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '\S+'), ' ')) AS abstract_md5 FROM documents WHERE regexp_matches(text, '\S')",
}
