"""Lexicons as tables, order of arrival and boosted trees, each against a plain version."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpuslens.functions import fixed_values as V
from corpuslens.operators import boosting, collection, lexicon
from corpuslens.operators.storage import kept

# ---- lexicons

PHRASES = {"deep way": "profound path", "the the": None, "a b a": "x", "Straße 1": None, "co-op": "coop", "it's so": None, "(odd": "never", "one": "1"}
TEXTS = [
    "The deep way. A DEEP WAY! deep  way deep\nway deeply way", "the the the the THE", "a b a b a b a a b", "straße 1 STRASSE 1 Straße 12", "co-op co op CO-OP; it's so, it’s so", "(odd one _one one_ one", "", None, " \x00é one", "one " * 500,
]


def plain_matches(text, phrases):
    word, out = r"\w", []
    for phrase in phrases:
        if re.match(word, phrase[0]) and re.match(word, phrase[-1]):
            for m in re.finditer(rf"(?<!{word}){re.escape(phrase)}(?!{word})", text or "", re.IGNORECASE):
                out.append((phrase, m.start(), m.group()))
    return out


@pytest.mark.parametrize("most", [lexicon.BROADCAST, 0])
def test_lexicon_matches(spark, monkeypatch, most):
    monkeypatch.setattr(lexicon, "BROADCAST", most)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "id long, text string, phrase string, place int")
    table = spark.createDataFrame([*PHRASES.items(), ("deep way", "zz")], "phrase string, correction string")
    found = lexicon.located(df, "id", "text", lexicon.matches(df, "id", "text", table)).collect()
    assert sorted((r.id, r.phrase, r.start, r.surface) for r in found) == sorted((i, *m) for i, t in enumerate(TEXTS) for m in plain_matches(t, PHRASES))
    assert all(TEXTS[r.id][r.start : r.end] == r.surface and r.context == "..." + TEXTS[r.id][max(0, r.start - 50) : r.end + 50].replace("\n", " ").strip() + "..." for r in found)
    rows = {r.id: r for r in lexicon.signals(df, "id", "text", table).collect()}
    for i, t in enumerate(TEXTS):
        some, n = plain_matches(t, PHRASES), len((t or "").split())
        assert (rows[i].tortured_count, rows[i].tortured_unique) == (len(some), len({m[2] for m in some})) and rows[i].tortured_density == pytest.approx(len(some) / n * 1000 if n else 0)
    assert lexicon.matches(df, "id", "text", table.where("false")).count() == 0 and lexicon.matches(df.where("false"), "id", "text", table).count() == 0


def test_lexicon_plan(spark):
    """The plan is the same for ten phrases and for ten thousand."""
    df = spark.createDataFrame([(1, "some deep way")], "id long, text string")

    def size(n):
        words = kept(spark.range(n).select(F.concat(F.lit("deep way"), F.when(F.col("id") > 0, F.col("id").cast("string")).otherwise("")).alias("phrase"), F.lit(None).cast("string").alias("correction")), "lexicon")
        out = lexicon.matches(df, "id", "text", words)
        assert out.count() == 1
        return len(out._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert size(10) == size(10_000)


def test_lexicon_without_shuffled_runs(spark):
    """No run of words is shuffled with a lexicon that is sent to all; rows with one key keep their own matches."""
    df = spark.createDataFrame([(1, "a b a b a, one"), (1, "A b a. ONE one"), (2, None)], "id long, text string")
    table = spark.createDataFrame(list(PHRASES.items()), "phrase string, correction string")
    out = lexicon.matches(df, "id", "text", table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("Generate") == 1
    assert sorted((r.phrase, r.place, r.surface) for r in out.collect()) == [("a b a", 0, "A b a"), ("a b a", 0, "a b a"), ("one", 3, "ONE"), ("one", 4, "one"), ("one", 5, "one")]
    assert {tuple(r) for r in lexicon.signals(df, "id", "text", table).select("id", "tortured_count", "tortured_unique").collect()} == {(1, 5, 4), (2, 0, 0)}


@pytest.mark.parametrize("most", [lexicon.BROADCAST, 0])
def test_lexicon_of_any_letters(spark, monkeypatch, most):
    """As Spark's lower() has it: a dotted capital I is two characters, a sigma ends a word in another form, signs beyond 16 bits."""
    monkeypatch.setattr(lexicon, "BROADCAST", most)
    texts = ["\u0130stanbul i\u0307STANBUL istanbul, \u0130\u0130 one", "\u03a3\u0391\u03a3 \u03c3\u03b1\u03c2 \u03c3\u03b1\u03c3", "\U0001f600 \U00010400x \U00010428X", "\u212aelvin kelvin \ufeffone"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(p, None) for p in ("\u0130STANBUL", "\u03c3\u03b1\u03c2", "\U00010428x", "Kelvin", "one")], "phrase string, correction string")
    found = sorted((r.id, r.place, r.surface) for r in lexicon.matches(df, "id", "text", table).collect())
    words = [(i, k, w) for i, t in enumerate(texts) for k, w in enumerate(re.findall(r"[\w\u0307]+", t))]
    low = {r.low for r in table.select(F.lower("phrase").alias("low")).collect()}
    lowered = spark.createDataFrame(words, "id int, k int, w string").select("id", "k", "w", F.lower("w").alias("low")).collect()
    assert found == sorted((r.id, r.k, r.w) for r in lowered if r.low in low) and len(found) == 10


def test_built_in_phrases(spark):
    """Every built-in phrase finds itself."""
    df = spark.createDataFrame([(i, f"Some {p.upper()}, then.") for i, p in enumerate(V.PHRASES)], "id long, text string")
    table = spark.createDataFrame(list(V.PHRASES.items()), "phrase string, correction string")
    found = {(r.id, r.phrase) for r in lexicon.matches(df, "id", "text", table).collect()}
    assert {(i, p) for i, p in enumerate(V.PHRASES)} <= found


# ---- order of arrival


def pages(seed):
    """query -> pages of (id, has an abstract); the last page of query 1 does not parse."""
    r = random.Random(seed)
    return {q: [[(f"W{r.randrange(60)}", r.random() < 0.7) for _ in range(r.choice([0, 3, 7]))] for _ in range(r.randint(1, 4))] for q in range(4)}


def landed(found, folder):
    for q, some in found.items():
        (folder / str(q)).mkdir()
        for k, page in enumerate(some):
            body = json.dumps({"meta": {}, "results": [{"id": i, "title": "t", "abstract_inverted_index": {"a": [0]} if ok else None} for i, ok in page]})
            (folder / str(q) / f"{k}.json").write_text(body if (q, k) != (1, len(some) - 1) else body[:-3] if body[:-3] else "x")
    if found[1]:
        found[1].pop()


@pytest.mark.parametrize("seed", range(3))
def test_arrival(spark, tmp_path, seed):
    found = pages(seed)
    landed(found, tmp_path)
    hits = collection.responses(spark, str(tmp_path)).select("query", "page", "place", F.col("work.id").alias("id"), F.col("work.abstract_inverted_index").isNotNull().alias("ok"))
    hits = kept(hits, "hits")
    assert sorted((r.query, r.page, r.place, r.id, r.ok) for r in hits.collect()) == [(q, k, p, i, ok) for q, some in sorted(found.items()) for k, page in enumerate(some) for p, (i, ok) in enumerate(page)]
    for most in (1, 10, 1000):
        seen, want = set(), []
        for q in sorted(found):
            for i, ok in (x for page in found[q] for x in page):
                if i not in seen and len(want) < most:
                    seen.add(i)
                    if ok:
                        want.append((len(want) + 1, q, i))
        assert sorted((r.arrival, r.query, r.id) for r in collection.arrived(hits, "id", F.col("ok"), most).collect()) == want
    for order in ([0, 1, 2, 3], [2, 0, 3, 1]):
        seen, want = set(), []
        for k, q in enumerate(order):
            n = 0
            for i, ok in (x for page in found[q] for x in page):
                if n == 4:
                    break
                if i not in seen:
                    seen.add(i)
                    if ok:
                        n += 1
                        want.append((k, n, i))
        assert sorted((r.query_no, r.arrival, r.id) for r in collection.searched(hits, "id", F.col("ok"), 4, order).collect()) == want
    assert collection.arrived(hits.where("false"), "id", F.col("ok"), 5).count() == 0


# ---- boosted trees


def plain_boosting(x, y, w, edges, base, trees, depth, rate=0.1, ridge=1.0, least=1.0):
    """Margins after so many trees, node by node and cut by cut."""
    margin = np.full(len(y), base)

    def grow(rows, g, h, level):
        if level < depth:
            best = (1e-6, None)
            for k, cuts in enumerate(edges):
                for cut in cuts:
                    left, right = rows[x[rows, k] <= cut], rows[x[rows, k] > cut]
                    if h[left].sum() >= least and h[right].sum() >= least:
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (left, right))
            if best[1]:
                for part in best[1]:
                    grow(part, g, h, level + 1)
                return
        step[rows] = -rate * g[rows].sum() / (h[rows].sum() + ridge)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        grow(np.arange(len(y)), (p - y) * w, p * (1 - p) * w, 0)
        margin = margin + step
    return margin


def sample(n=240):
    rng = np.random.default_rng(3)
    x = np.stack([rng.standard_normal(n), rng.integers(0, 5, n), rng.random(n), np.zeros(n)], axis=1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 2) | (rng.random(n) < 0.1)).astype(float)
    return x, y, np.where(y == 1, 2.0, 1.0)


def test_boosting(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    x, y, w = sample()
    df = spark.createDataFrame([(Vectors.dense(a.tolist()), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], ["features", "label", "weight"]).repartition(3)
    model = boosting.BoostedTrees(trees=5, depth=3, bins=16).fit(df)
    want = plain_boosting(x, y, w, model.edges, model.base, 5, 3)
    assert np.allclose(model.margin(x), want, atol=1e-9)
    got = np.array([r.p for r in df.select(model.probability("features").alias("p"), "features").collect()])
    assert np.allclose(np.sort(got), np.sort(1 / (1 + np.exp(-want))), atol=1e-9)
    share = model.importances()
    assert share.sum() == pytest.approx(1) and share[3] == 0 and share[:2].sum() > 0.8


def test_boosting_of_little(spark):
    """One class, one row, rows without features: the base rate alone."""
    one = spark.createDataFrame([(Vectors.dense([1.0]), 1.0, 1.0)], ["features", "label", "weight"])
    assert boosting.BoostedTrees(trees=2).fit(one).margin(np.array([[1.0], [5.0]])) == pytest.approx([boosting.BoostedTrees(trees=2).fit(one).margin(np.array([[1.0]]))[0]] * 2)
    assert boosting.BoostedTrees(trees=2).fit(one.where("false")).trees == []
