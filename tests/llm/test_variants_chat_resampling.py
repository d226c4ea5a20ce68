"""Operators 11 to 13 against brute force, exact round trips and SQL, and on nulls, blanks, long texts, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from corpuslens.llm import chat, queries, resampling, spelling

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "conversations")
LONG = " ".join(f"word{i % 977} andere{i % 13}." for i in range(30_000))
ROWS = [(1, "Once the harbour was quiet, harbour boats came."), (2, None), (3, ""), (4, " \n\t "), (5, "Once the harbour was quiet, harbour boats came."), (6, LONG), (None, "harbour harbours"), (9, "é€😀 \x00 ÀÉÿabc× a@b.co"), (9, "é€😀 \x00 ÀÉÿabc× a@b.co")]


@pytest.fixture(scope="module")
def odd(spark):
    """Extra columns have the names that operators use within."""
    return spark.createDataFrame([(i, t, "x", i, i, None, "y") for i, t in ROWS], "doc_id long, text string, word string, n long, side long, score double, rank string")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_chat_formatting", "op13_resampling"])
def test_sql(spark, sql, name):
    plain = lambda rows, columns: sorted(tuple(str(v) for _, v in sorted(zip(columns, r, strict=True))) for r in rows)
    got = queries.QUERIES[name](spark, SF)
    want = sql.execute(queries.oracles()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)


# ---- 11


def counted(rows, one_in=spelling.DAMAGE, least=1):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= least}


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def grouped(words, factor=5):
    letters = set("".join(words))
    near = {w: {x for x in edits(w, letters) if x in words and x != w} for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= factor * words[w] else None
    root = lambda w: w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n, len(near[w]), form[w] and words[form[w]]) for w, n in words.items()}


@pytest.mark.parametrize(("shard", "group"), [(7, 500), (1000, 16_000_000)])
def test_variants(spark, shard, group):
    """Chains of forms, ties, letters beyond ASCII, many shards and many broadcasts."""
    r = random.Random(3)
    base = ["".join(r.choice("abcdéñ") for _ in range(r.randint(6, 8))) for _ in range(120)]
    words = {w: r.choice([5, 30, 200, 4000]) for w in base}
    for w in base[:90]:
        words[r.choice(sorted(edits(w, "abé")))] = r.choice([5, 6, 30, 150])
    words = {w: n for w, n in words.items() if len(w) >= 6} | {"zzzzaaaa": 5000, "zzzzaaa": 500, "zzzyaaa": 50, "zzzyaa": 5, "zzzzaaab": 5000}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(x) for x in spelling.variants(df, shard=shard, group=group).collect()]
    assert len(got) == len(words)
    assert set(got) == grouped(words)
    assert any(x[1] and x[2] != x[1] for x in got)  # some chain is longer than one


def test_word_counts(spark, odd):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    rows = list(zip(docs.doc_id.tolist(), docs.text, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for held in (50, 400_000):
        assert {r.word: r.n for r in spelling.word_counts(df, one_in=7, held=held).collect()} == counted(rows, 7, 5)
    assert {r.word: r.n for r in spelling.word_counts(odd, min_count=1, one_in=2).collect()} == counted(ROWS, 2)


def test_variants_odd(spark, odd):
    words = counted(ROWS, spelling.DAMAGE, 2)
    assert {tuple(x) for x in spelling.variants(spelling.word_counts(odd, min_count=2)).collect()} == grouped(words)
    assert spelling.variants(spelling.word_counts(odd.where("doc_id = -1"))).collect() == []


# ---- 12

TEXTS = ["", "</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<", "<|turn|>x<|text|>", "[INST", "<<SYS>>\n<</SYS>>", "<\\/s>", "é😀\n", "<</s>"]


def test_template():
    """Every text and role comes back, also where texts end in parts of marks."""
    for role in ["user", "assistant", "system", "tool", "", "<|text|>", "a\\", "<"]:
        for a in TEXTS:
            for b in TEXTS:
                turns = [(role, a), ("assistant", b), (role, b), ("user", a), ("assistant", a)]
                whole = chat.START + "".join("".join(chat.turn(*t)) for t in turns)
                assert chat.turns_of(whole) == turns
                assert not any(c in chat.escape(a) for c in chat.CONTROLS)


def tree_rows(seed, trees=25):
    """Random trees with missing parents, circles and equal scores."""
    r, rows = random.Random(seed), []
    for t in range(trees):
        n = r.choice([1, 2, 5, 40])
        for k in range(n):
            parent = None if k == 0 else r.choice([r.randrange(k), k - 1, None if r.random() < 0.1 else k - 1, 999 if r.random() < 0.1 else k - 1])
            rows.append((t if t else None, k, parent, r.choice(["user", "assistant", "system", None, "tool"]), r.choice([*TEXTS, None]), r.choice([None, 0.0, 1.0, 2.5])))
        if r.random() < 0.3:
            rows += [(t if t else None, 100, 101, "user", "a", 9.0), (t if t else None, 101, 100, "user", "b", 9.0), (t if t else None, 102, 102, "user", "c", 9.0)]
    return rows


def best_paths(rows, top):
    trees, out = {}, []
    for t, k, p, role, text, s in rows:
        trees.setdefault(t, {})[k] = (p, role, text, s)
    for t, of in trees.items():
        inner = {p for k, (p, *_) in of.items()}
        found = []
        for leaf in of:
            if leaf in inner:
                continue
            path, k = [], leaf
            while k is not None and k in of and k not in path:
                path.append(k)
                k = of[k][0]
            if k is not None and k in of:
                continue
            found.append((-sum(of[k][3] or 0 for k in path), leaf, path[::-1]))
        for rank, (s, leaf, path) in enumerate(sorted(found)[:top], 1):
            out.append((t, leaf, rank, -s, tuple((of[k][1] or "", of[k][2] or "") for k in path)))
    return Counter(out)


@pytest.mark.parametrize("top", [1, 3])
def test_trees(spark, top):
    rows = tree_rows(top)
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumnRenamed("tree", "conv")
    got = chat.formatted(df.selectExpr("*", "node AS leaf", "node AS depth", "'x' AS loss"), top=top, tree="conv").collect()
    assert Counter((x.tree, x.leaf, x.branch_rank, x.branch_score, tuple(chat.turns_of(x.formatted))) for x in got) == best_paths(rows, top)
    for x in got:
        assert [chat.unescape(x.formatted[s.start : s.end]) for s in x.loss] == [t for r, t in chat.turns_of(x.formatted) if r == "assistant"]


def test_conversations_odd(spark):
    """Repeated rows are all turns; ties go by role and text; null text is empty; a long conversation."""
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, "assistant", None), (3, None, None, "x"), (None, 0, "user", "n")] + [(4, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(700)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, tree int")
    got = {r.tree: chat.turns_of(r.formatted) for r in chat.formatted(chat.replies(df)).collect()}
    assert got == {1: [("user", "a"), ("user", "a"), ("user", "b")], 2: [("assistant", "")], 3: [("", "x")], None: [("user", "n")], 4: [(r, t) for c, _, r, t in rows if c == 4]}
    assert chat.formatted(chat.replies(df.where("conv_id = -1"))).collect() == []


# ---- 13


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(docs, target, buckets=resampling.BUCKETS):
    of = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(of(f) for text in texts for f in features(text)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for key, text in docs:
        w, f = features(text)
        weight, score = sum(gain[of(x)] for x in f), None
        if key is not None:
            h = int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(f), weight, score, len(w) >= 20 and key is not None])
    order = sorted((i for i in range(len(out)) if out[i][4]), key=lambda i: (-out[i][3], out[i][0]))
    rank = {i: k for k, i in enumerate(order[: 5 * len(order) // 100], 1)}
    return Counter((*x[:4], rank.get(i)) for i, x in enumerate(out))


def got_rows(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("block", "piece"), [(6_000_000, 1_000_000), (3000, 50)])
def test_resampling(spark, monkeypatch, block, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    docs, target = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/benchmark.parquet")
    rows = list(zip(docs.doc_id.tolist(), docs.text, strict=True))
    frame = lambda texts: spark.createDataFrame(texts, "doc_id long, text string")
    got = resampling.resample(frame(rows), frame(list(enumerate(target.text))), block=block)
    assert got_rows(got) == resampled(rows, target.text)


def test_dictionary(spark):
    """A string that many blocks have is one string of the dictionary, in whatever table."""
    docs = spark.createDataFrame([(i, "aa bb aa bb cc") for i in range(50)], "doc_id long, text string").repartition(4)
    counts = {r.bucket: (r.s, r.t) for r in resampling.bucket_counts(docs, docs.limit(3), block=40).collect()}
    want = Counter()
    for f in features("aa bb aa bb cc")[1]:
        want[zlib.crc32(f.encode()) % resampling.BUCKETS] += 1
    assert counts == {b: (50 * n, 3 * n) for b, n in want.items()}


def test_checksums():
    """Checksums of joined words from those of the words."""
    import numpy as np

    shift = resampling.Shift()
    for a, b in [(b"a", b""), (b"", b"xyz"), ("é€".encode(), b"q" * 300), (b"a" * 70_000, b"b" * 70_001)]:
        rows = shift.rows(np.array([len(b) + 1]))
        made = shift(np.array([zlib.crc32(a)], np.uint32), rows)[0] ^ zlib.crc32(b" " + b)
        assert made == zlib.crc32(a + b" " + b)


def test_resampling_odd(spark, odd):
    assert got_rows(resampling.resample(odd, odd.limit(2))) == resampled(ROWS, [t for _, t in ROWS[:2]])
    none = odd.where("doc_id = -1")
    assert got_rows(resampling.resample(odd, none)) == resampled(ROWS, [])
    assert resampling.resample(none, odd).collect() == []
