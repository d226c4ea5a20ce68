"""Operator 2: line-first cleaning with DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines go, then documents that lose too
much of their text go. One projection per document, no shuffle.

Line rules (each on a line that has a word; blank lines stay and never count):
  shouting    two or more words that end in "!!"
  symbols     more than 1 symbol of #*$%&|<> for every 4 words
  navigation  three or more parts between | > » • with at most 3 words each on average
  boilerplate at most 30 words and a stock phrase (see BOILERPLATE)
  punctuation at most 8 words, none of . ! ? : ; , … or a closing quote or bracket at its end, not the only line

Defined results: null text has no words: base_failed is true and kept false; its cleaned text is null. Blank texts have no
words either. Equal rows give equal rows; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import SPACE, SPACES, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Share of a document's word characters that may be in failing lines.
MAX_LOST = 0.5
# Stock phrases, matched in any case.
BOILERPLATE = [
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "follow us on", "log in to",
    "privacy policy", "read more", "share this", "sign in to", "sign up", "skip to content", "subscribe to", "terms of service", "terms of use",
]
_PHRASES = "(?i)(" + "|".join(BOILERPLATE) + ")"
_END = "[.!?:;,…\"'”’»)\\]]$"
_PARTS = "[|>»•]"
_BANG = "!!([\\x20\\x09-\\x0D]|$)"


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column, alone: Column) -> Column:
    """Whether a line with a word fails a rule. alone: no other line of its document has a word."""
    line = F.btrim(line, F.lit(SPACES))
    n = F.regexp_count(line, F.lit(SPACE)) + 1
    parts = F.regexp_count(line, F.lit(_PARTS)) + 1
    return (
        (F.regexp_count(line, F.lit(_BANG)) >= 2)
        | (_count(line, SYMBOLS) * 4 > n)
        | ((parts >= 3) & (n <= parts * 4))
        | ((n <= 30) & line.rlike(_PHRASES))
        | ((n <= 8) & ~line.rlike(_END) & ~alone)
    )


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def repeated_words(tokens: Column, df: DataFrame) -> DataFrame:
    """df with n_repeat_words: words in windows of WINDOW words that occur at least twice.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes; only documents with an equal pair are sorted.
    """
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    df = df.withColumn("_h", hashes)
    df = df.withColumn("_w", F.when(F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda s, j: s["h"].eqNullSafe(F.get("_s", j)["h"])
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda s, j: same(s, j - 1) | same(s, j + 1)), lambda s: s["i"])))
    step = F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), p - F.coalesce(F.get("_p", j - 1), F.lit(-WINDOW))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("_h", "_w", "_s", "_p")


def judge(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """docs with its columns under `doc`, and cleaned, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, lost_chars, base_failed, kept."""
    df = docs.select(F.struct("*").alias("doc"), F.col(text_col).cast("string").alias("_text"))
    df = df.withColumn("_tokens", words(F.col("_text")))
    df = df.withColumn("n_words", F.size("_tokens").cast("long"))
    df = repeated_words(F.col("_tokens"), df).drop("_tokens")
    df = df.withColumn("_all", F.split(F.coalesce("_text", F.lit("")), "\n", -1))
    df = df.withColumn("_lines", F.filter("_all", _has_word))
    alone = F.size("_lines") <= 1
    df = df.withColumn("_good", F.filter("_all", lambda x: ~_has_word(x) | ~line_fails(x, alone)))
    chars = lambda text: F.length(F.translate(text, SPACES, ""))
    df = df.withColumns({
        "word_chars": F.coalesce(chars(F.col("_text")), F.lit(0)).cast("long"),
        "n_symbols": F.coalesce(_count(F.col("_text"), SYMBOLS), F.lit(0)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_lines_removed": (F.size("_all") - F.size("_good")).cast("long"),
        "cleaned": F.when(F.size("_all") == F.size("_good"), F.col("_text")).otherwise(F.array_join("_good", "\n")),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    })
    df = df.withColumn("lost_chars", F.col("word_chars") - F.coalesce(chars(F.col("cleaned")), F.lit(0)))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("word_chars")))
    return df.drop("_text", "_all", "_lines", "_good")


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their columns in order and the text without its failing lines; n_chars, if there, follows."""
    new = {text_col: F.col("cleaned")}
    if "n_chars" in docs.columns and text_col != "n_chars":
        new["n_chars"] = F.length("cleaned").cast(docs.schema["n_chars"].dataType)
    row = F.struct(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))
    # not a filter: pushed below the projections, it would repeat all of judge() within one predicate
    return judge(docs, text_col).select(F.inline(F.when(F.col("kept"), F.array(row))))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs).select(F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_chars")


def op2_sql() -> str:
    phrases = "|".join(BOILERPLATE)
    space = r"[\x20\x09-\x0D]+"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+7], ' ')) AS h
  FROM d, unnest(range(1, greatest(len(w) - 6, 1))) AS u(i)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT doc_id, sum(least(8, i - prev)) AS n_repeat_words
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS prev FROM dup) GROUP BY doc_id),
lines AS (
  SELECT doc_id, j, ls[j] AS raw, trim(ls[j], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l
  FROM d, unnest(range(1, len(ls) + 1)) AS u(j)),
counted AS (
  SELECT *, len(regexp_extract_all(l, '{space}')) + 1 AS n, len(regexp_extract_all(l, '[|>»•]')) + 1 AS parts,
         len(regexp_extract_all(l, '[#*$%&|<>]')) AS syms, length(regexp_replace(l, '{space}', '', 'g')) AS chars,
         count(*) OVER (PARTITION BY doc_id) AS many FROM lines WHERE l <> ''),
judged AS (
  SELECT *, len(regexp_extract_all(l, '!!([\x20\x09-\x0D]|$)')) >= 2 OR syms * 4 > n OR (parts >= 3 AND n <= parts * 4)
         OR (n <= 30 AND regexp_matches(l, '(?i)({phrases})'))
         OR (n <= 8 AND NOT regexp_matches(l, '[.!?:;,…"''”’»)\]]$') AND many > 1) AS bad FROM counted),
per AS (
  SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines, count(*) FILTER (bad) AS n_lines_removed,
         coalesce(sum(chars) FILTER (bad), 0) AS lost_chars FROM judged GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed,
         coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= {MAX_LOST} * word_chars AS kept,
       n_lines_removed, lost_chars
FROM base"""
