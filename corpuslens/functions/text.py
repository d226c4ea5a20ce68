"""Text signals of one document, as column expressions (native, no UDF)."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V

#: Word edges in any script: no letter, digit or underscore on that side.
_BEFORE, _AFTER = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"
_TOKEN = _BEFORE + r"[a-z]+(?:'[a-z]+)?" + _AFTER
_SPLIT = r"(?<=[.!?])\s+(?=[A-Z])"


def steady(x: Column, digits: int = 6) -> Column:
    """Rounding that SQL engines agree on: halves up, with a margin for the last bits."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.500001) / scale


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Runs of characters other than white space; a line or paragraph separator that ends the text belongs to the run before it."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S++(?:\s++[\x{85}\x{2028}\x{2029}]\z)?"))


#: White space of any kind.
WHITE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without white space of any kind around it."""
    return F.btrim(text, F.lit(WHITE))


def sentences(text: Column, longer_than: int) -> Column:
    """T3."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), _SPLIT), trimmed), lambda s: F.length(s) > longer_than)


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def certain(pattern: str) -> str:
    """The longest run of letters and spaces that every match of the pattern holds; empty if none is sure."""
    bare = re.sub(r"\\.", "()", pattern)
    bare = re.sub(r"\[[^\]]*\]", "()", bare)
    while bare != (bare := re.sub(r"\((?!\))[^()]*\)", "()", bare.replace("()", "\0"))):
        pass
    if "|" in bare:
        return ""
    runs = [m[0][:-1] if bare[m.end() : m.end() + 1] in ("?", "*", "{") else m[0] for m in re.finditer("[a-z ]+", bare)]
    return max(runs, key=len, default="")


def needed(pattern: str) -> list[str]:
    """Every match of the pattern holds one of these, none if nothing is sure: its certain part, or where that is a short word, as
    most texts have, the longest words of a group of alternatives that stands for itself."""
    part, best = certain(pattern), []
    bare = re.sub(r"\\.|\[[^\]]*\]", ".", pattern)
    for m in re.finditer(r"\(\?:([a-z]+(?:\|[a-z]+)+)\)(?![?*{])", bare):
        inside = bare[: m.start()].count("(") > bare[: m.start()].count(")")
        best = best if inside else max(best, m[1].split("|"), key=lambda words: min(map(len, words), default=0))
    outside = bare
    while outside != (outside := re.sub(r"\([^()]*\)", "", outside)):
        pass
    if "|" in outside or len(part.strip()) > 4 or min(map(len, best), default=0) <= len(part.strip()):
        return [part] if part else []
    return [w for w in best if not any(v != w and v in w for v in best)]


def count_patterns(text: Column, patterns: Sequence[str], low: Column | None = None) -> Column:
    """Sum of the matches of each pattern on its own; a plain search for what it needs spares most texts the pattern. low: lowered(text), made before."""
    low = lowered(text) if low is None else low
    total = F.lit(0)
    for p in patterns:
        parts, count = needed(p), F.regexp_count(low, F.lit(p))
        total = total + (F.when(functools.reduce(operator.or_, map(low.contains, parts)), count).otherwise(0) if parts else count)
    return total


def per_thousand(count: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(count, of) * 1000, F.lit(0.0))  # both are made once


def phrase_pattern(phrase: str) -> str:
    escaped = "".join("\\" + c if not (c.isalnum() or c.isspace()) else c for c in phrase)
    return f"(?={escaped})" + _BEFORE + escaped + _AFTER  # the edges are looked at only where the phrase stands


def phrase_signals(text: Column, phrases: Sequence[str], low: Column | None = None) -> dict[str, Column]:
    """tortured_count, tortured_density per 1000 words, tortured_unique (distinct surface forms). Phrases are scanned one by one,
    where the text has them at all. low: lowered(text), made before."""
    low, none = lowered(text) if low is None else low, F.array().cast("array<string>")
    surfaces = lambda p: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + phrase_pattern(p)), 0)
    found = F.flatten(F.array(*(F.when(low.contains(p.lower()), surfaces(p)).otherwise(none) for p in phrases)))
    count = F.size(found)
    return {"tortured_count": count.cast("long"), "tortured_density": per_thousand(count, n_words(text)), "tortured_unique": F.size(F.array_distinct(found)).cast("long")}


def phrase_rows(df: DataFrame, text: str, lexicon: dict[str, str | None], around: int = 50) -> DataFrame:
    """df's rows (without the text) once for each match of a phrase: phrase, correction, start, end, context; one scan.

    Places are code points from 0, from the lengths between matches. The context has `around` characters on both sides, line
    breaks as blanks, without outer blanks, between dots. A text without a match, or null, has no row."""
    made = F.col(text)
    kind = F.array().cast("array<struct<phrase:string,correction:string,start:int>>")

    def found(phrase: str, correction: str | None) -> Column:
        sizes = F.transform(F.split(made, "(?i)" + phrase_pattern(phrase), -1), lambda x: F.length(x))
        starts = lambda n: F.transform(F.slice(n, 1, F.size(n) - 1), lambda _, i: F.aggregate(F.slice(n, 1, i + 1), F.lit(0), lambda a, y: a + y) + i * len(phrase))
        places = F.element_at(F.transform(F.array(sizes), starts), 1)
        rows = F.transform(places, lambda at: F.struct(F.lit(phrase).alias("phrase"), F.lit(correction).cast("string").alias("correction"), at.cast("int").alias("start")))
        return F.when(F.col("_low").contains(phrase.lower()), rows).otherwise(kind)

    every = F.flatten(F.array(*(found(p, c) for p, c in lexicon.items())))
    rows = df.withColumn("_low", lowered(made)).withColumn("_m", F.explode(every)).withColumns({c: F.col(f"_m.{c}") for c in ("phrase", "correction", "start")})
    rows = rows.withColumn("end", F.col("start") + F.length("phrase"))
    lo = F.greatest(F.col("start") - around, F.lit(0))
    near = F.trim(F.replace(F.substring(made, lo + 1, F.col("end") + around - lo), F.lit("\n"), F.lit(" ")))
    return rows.withColumn("context", F.concat(F.lit("..."), near, F.lit("..."))).drop("_low", "_m", text)


def boilerplate(text: Column, patterns: Sequence[str] = V.STOCK_SENTENCES, low: Column | None = None) -> dict[str, Column]:
    """T2."""
    count = count_patterns(text, patterns, low)
    return {"boilerplate_count": count.cast("long"), "boilerplate_density": per_thousand(count, n_words(text))}


def template_score(text: Column, roles: dict[str, str] = V.SENTENCE_ROLES, longer_than: int = 10) -> Column:
    """T4: 0.6 times the share of sentences with a role, plus 0.4 times the share of adjacent roles in order."""
    parts = sentences(text, longer_than)

    def role(sentence: Column) -> Column:
        out = F.lit(None).cast("int")
        for i, pattern in reversed(list(enumerate(roles.values()))):
            out = F.when(sentence.rlike("(?i)" + pattern), i).otherwise(out)
        return out

    def score(got: Column) -> Column:  # got: role of each sentence, or null
        known = F.filter(got, lambda r: r.isNotNull())
        in_order = lambda k: F.size(F.filter(F.transform(k, lambda r, i: r >= F.get(k, i - 1)), lambda ok: ok))
        ordered = F.element_at(F.transform(F.array(known), in_order), 1)
        order = F.when(F.size(known) >= 3, ordered / (F.size(known) - 1)).otherwise(0.0)
        return F.when(F.size(got) >= 3, 0.6 * F.size(known) / F.size(got) + 0.4 * order).otherwise(0.0)

    return F.element_at(F.transform(F.array(F.transform(parts, role)), score), 1)


def variation(lengths: Column, least: int) -> Column:
    """Population deviation over mean of an array of counts; 0 for fewer than `least`."""

    def of(x: Column) -> Column:
        n = F.size(x)
        s1 = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
        s2 = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
        spread = F.sqrt(F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0)))
        return F.when((n >= least) & (s1 > 0), spread / (s1 / n)).otherwise(0.0)

    return F.element_at(F.transform(F.array(lengths), of), 1)  # the array is made once


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda s: n_words(s).cast("double"))


def uniformity(text: Column) -> dict[str, Column]:
    """T5."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), trimmed), lambda p: F.length(p) > 20)
    first = F.slice(F.transform(words(text), F.lower), 1, 1000)
    enough = F.length(F.coalesce(text, F.lit(""))) >= 100
    zero = lambda c: F.when(enough, c).otherwise(0.0)
    diversity = F.when(F.size(first) > 0, F.size(F.array_distinct(first)) / F.size(first)).otherwise(0.0)
    return {"sentence_length_cv": zero(variation(_lengths(sentences(text, 10)), 3)), "paragraph_length_cv": zero(variation(_lengths(paragraphs), 2)), "vocabulary_diversity": zero(diversity)}


def tokens(text: Column, low: Column | None = None) -> Column:
    return F.regexp_extract_all(lowered(text) if low is None else low, F.lit(_TOKEN), 0)


def _edged(phrases: Sequence[str]) -> list[str]:
    return [_BEFORE + p + _AFTER for p in phrases]


def prepared(df: DataFrame, text: Column) -> DataFrame:
    """df with what several signals need, each made once: _low, _tokens, _sorted, _lengths (words of sentences), _generated."""
    df = df.withColumn("_low", lowered(text))
    df = df.withColumns({"_tokens": tokens(text, F.col("_low")), "_lengths": _lengths(sentences(text, 5)), "_generated": count_patterns(text, _edged(V.GENERATED), F.col("_low"))})
    return df.withColumn("_sorted", F.sort_array("_tokens"))


def _once(sorted_tokens: Column) -> Column:
    """Types that occur once in a sorted array."""
    alone = lambda t, i: ~t.eqNullSafe(F.get(sorted_tokens, i - 1)) & ~t.eqNullSafe(F.get(sorted_tokens, i + 1))
    return F.size(F.filter(sorted_tokens, alone))


def generated_signals(text: Column) -> dict[str, Column]:
    """T6, on a frame that prepared() made."""
    token_column, sorted_column, lengths, low, generated = map(F.col, ("_tokens", "_sorted", "_lengths", "_low", "_generated"))
    n = F.size(token_column)
    enough = (F.length(F.coalesce(text, F.lit(""))) >= 100) & (n > 0)
    zero = lambda c: F.when(enough, c).otherwise(0.0)
    first = F.slice(token_column, 1, 1000)
    total = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x)
    return {
        "ai_vocab_diversity": zero(F.size(F.array_distinct(first)) / F.size(first)),
        "ai_hapax_ratio": zero(_once(sorted_column) / F.size(F.array_distinct(sorted_column))),
        "ai_sentence_uniformity": zero(F.when(F.size(lengths) >= 3, F.greatest(F.lit(0.0), 1 - variation(lengths, 3))).otherwise(0.0)),
        "ai_mean_sentence_length": zero(F.when(F.size(lengths) >= 3, total / F.size(lengths)).otherwise(0.0)),
        "ai_discourse_density": zero(count_patterns(text, _edged(V.DISCOURSE), low) / n * 1000),
        "ai_phrase_count": F.when(enough, generated).otherwise(0).cast("long"),
        "ai_phrase_density": zero(generated / n * 1000),
        "ai_mean_word_length": zero(F.aggregate(token_column, F.lit(0.0), lambda a, t: a + F.length(t)) / n),
        "ai_long_word_ratio": zero(F.size(F.filter(token_column, lambda t: F.length(t) > 10)) / n),
    }


def heading_name(heading: Column) -> Column:
    """Without a leading number, by its other names, then by the first standard name it contains."""
    bare = F.regexp_replace(F.lower(F.trim(heading)), r"^\d+[.)]\s*", "")
    named = F.create_map(*(F.lit(x) for kv in V.SECTION_NAMES.items() for x in kv))[bare]
    inside = bare
    for name in reversed(V.SECTIONS):
        inside = F.when(bare.contains(name), F.lit(name)).otherwise(inside)
    return F.coalesce(named, inside)


def section_signals(headings: Column) -> dict[str, Column]:
    """T8."""
    names = F.transform(headings, heading_name)
    standard = F.array(*map(F.lit, V.SECTIONS))
    found = F.filter(names, lambda n: F.array_contains(standard, n))
    expected = F.filter(standard, lambda s: F.array_contains(names, s))
    return {
        "has_standard_imrad": (found == expected) & (F.size(expected) >= 4),
        "section_count": F.size(names).cast("long"),
        "standard_section_fraction": F.when(F.size(names) > 0, F.size(found) / F.size(names)).otherwise(0.0),
    }


def methods_text(sections: Column, body: Column) -> Column:
    """T10. sections: array of struct(heading, text)."""
    bare = lambda h: F.regexp_replace(F.lower(F.trim(F.coalesce(h, F.lit("")))), r"^\d+[.)]\s*", "")
    wanted = "|".join(V.METHODS_HEADINGS)
    chosen = F.filter(sections, lambda s: bare(s["heading"]).rlike(wanted))
    quarter = F.floor(F.length(body) / 4).cast("int")
    fallback = F.when(F.length(body) > 200, F.substring(body, quarter + 1, quarter)).otherwise("")
    return F.when(F.size(chosen) > 0, F.array_join(F.transform(chosen, lambda s: F.coalesce(s["text"], F.lit(""))), " ")).otherwise(F.coalesce(fallback, F.lit("")))


def methods_share(sections: Column) -> Column:
    """Characters of sections named methods over those of all."""
    size = lambda s: F.length(F.coalesce(s["text"], F.lit(""))).cast("double")
    total = F.aggregate(F.transform(sections, size), F.lit(0.0), lambda a, x: a + x)
    own = F.aggregate(F.transform(F.filter(sections, lambda s: heading_name(s["heading"]) == "methods"), size), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, own / total).otherwise(0.0)
