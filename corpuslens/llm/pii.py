"""Operator 8: personal data by patterns and a semi-Markov conditional random field.

Base spans come from fixed patterns with checks, one left-to-right pass per kind. A semi-Markov field then looks at windows
of tokens around digits, at signs and spelled-out addresses: candidate segments of at most LONGEST tokens are scored by
features of the whole span (digit groups, separators, checks, neighbours), and dynamic programming over bounded segments
chooses boundaries and kinds jointly. Its spans that touch no base span are added; base spans always stay.

The field is trained here: base spans of a bounded sample of documents (SAMPLE, smallest hashes of their ids) are its
positive segments, also rewritten into forms that the patterns miss (spelled-out or spaced addresses, numbers without
prefix, defanged dots), and everything else in the windows is negative, harmless numbers in their places among it. One
task fits it, as the sample is bounded; the driver gets the weights alone.

Defined results: null texts are empty and have no spans; a sample without spans gives a field that adds nothing; equal texts
have equal spans; an empty table gives an empty result; null ids pass through; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import smallest, table

KINDS = ["email", "ip", "card", "phone"]
#: Documents whose base spans train the field, tokens in a segment, tokens kept on either side of a trigger, and first tokens scored at a time.
SAMPLE, LONGEST, MARGIN, STEP = 3_000, 16, 6, 256

Span = tuple[int, int, int]  # kind, start, end (exclusive), in code points

# ---------------------------------------------------------------- base patterns

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts where a run of digits does: from within a run, the same text would follow.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern, found from its at sign, so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        got = _DOMAIN.match(text, at + 1) if start < at else None
        if got:
            yield start, got.end()
            end = got.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ---------------------------------------------------------------- the field

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
_TRIGGER = re.compile(r"[0-9]|@|[\[(]\s?(?:at|dot)\s?[\])]")
_SPELLED = re.compile(r"\bat [\w-]+ dot [^\W\d_]")
_CUES = ["address", "call", "card", "contact", "email", "fax", "host", "ip", "mail", "mobile", "phone", "reach", "server", "tel"]
_SEPARATORS = ".-/ ()[]+@:,_"
# Common last parts of domain names.
_TOP_LEVEL = frozenset(["com", "org", "net", "edu", "gov", "int", "info", "io", "biz", "eu", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "us", "ca", "jp", "cn", "in", "br", "ru"])
#: Buckets of hashed shapes: lengths of digit groups and the signs between them.
SHAPES = 128
_GROUPS = re.compile(r"[0-9]+")
_DOT_NEXT = re.compile(r"\s?[\[(]?\s?(?:\.|dot\b)\s?[\])]?\s?[^\W_]")
_DOT_BEFORE = re.compile(r"(?:[._%+-]|\bdot\b\s?[\])]?\s?)$")
_NAMES = (
    ["bias", "adjacent_left", "adjacent_right", "letters_only", "digits_only", "at_word", "dot_word", "dot_at_end", "starts_plus", "starts_bracket", "ends_bracket", "octets", "luhn", "domain", "brackets_even", "local_before_at", "newline", "joined_left", "joined_right", "space_in_local", "space_in_domain", "dot_follows", "dot_precedes", "ends_dot", "top_level", "luhn_free"]
    + [f"digits_{k}" for k in range(21)] + [f"groups_{k}" for k in range(7)] + [f"sep_{c}" for c in _SEPARATORS] + [f"cue_{c}" for c in _CUES] + [f"tokens_{k}" for k in range(LONGEST + 1)]
    + [f"shape_{k}" for k in range(SHAPES)]
)
_AT = {n: i for i, n in enumerate(_NAMES)}


class Window:
    """Tokens of a stretch of text, and its candidate segments with their features."""

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        self.words = [text[a:b] for a, b in self.tokens]
        self.lower = [w.lower() for w in self.words]

    @functools.cached_property
    def _all(self) -> tuple[list[tuple[int, int]], list[list[int]]]:
        return self.candidates(0, len(self.tokens))

    @property
    def segments(self) -> list[tuple[int, int]]:
        return self._all[0]

    @property
    def features(self) -> list[list[int]]:
        return self._all[1]

    def candidates(self, first: int, last: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
        """Segments that begin in tokens first to last (exclusive), wherever they end, and their features."""
        words, lower, n = self.words, self.lower, len(self.words)
        segments, features = [], []
        for i in range(first, last):
            if not (words[i][0].isalnum() or words[i] in "+(["):
                continue
            digits, at, dot = 0, False, False
            for j in range(i, min(n, i + LONGEST)):
                w = words[j]
                digits += len(w) if w[0].isdigit() else 0
                at |= w == "@" or lower[j] == "at"
                dot |= j > i and (w == "." or lower[j] == "dot")
                if j > i and self.tokens[j][0] - self.tokens[j - 1][1] > 2:
                    break
                if (w[0].isalnum() or w in ")]") and (digits >= 4 or at and dot and j - i >= 3):
                    segments.append((i, j + 1))
                    features.append(self._features(words, lower, i, j + 1))
        return segments, features

    def _features(self, words: list[str], lower: list[str], i: int, j: int) -> list[int]:
        a, b = self.tokens[i][0], self.tokens[j - 1][1]
        span, text = self.text[a:b], self.text
        digits = _digits(span)
        groups = [w for w in words[i:j] if w[0].isdigit()]
        on = ["bias", f"digits_{min(20, len(digits))}", f"groups_{min(6, len(groups))}", f"tokens_{j - i}"]
        on += [f"sep_{c}" for c in set(span) & set(_SEPARATORS)]
        outside = lambda c: c.isalnum() or c in "@_"
        inner = lower[i:j]
        at = "@" in inner or "at" in inner
        checks = {
            "adjacent_left": a > 0 and outside(text[a - 1]), "adjacent_right": b < len(text) and outside(text[b]),
            "letters_only": not digits, "digits_only": span == digits, "at_word": "at" in inner, "dot_word": "dot" in inner,
            "dot_at_end": span[-1] == ".", "starts_plus": span[0] == "+", "starts_bracket": span[0] in "([", "ends_bracket": span[-1] in ")]",
            "octets": len(groups) == 4 and j - i >= 7 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and not any(w[0].isalpha() for w in words[i:j]),
            "luhn": 13 <= len(digits) <= 19 and luhn(digits) and not any(w[0].isalpha() for w in words[i:j]),
            "domain": at and words[j - 1].isalpha() and 2 <= len(words[j - 1]) <= 6,
            "brackets_even": span.count("(") == span.count(")") and span.count("[") == span.count("]"),
            "local_before_at": at and words[i][0].isalnum() and inner[0] != "at", "newline": "\n" in span,
            # a sign ties the span to more letters or digits
            "joined_left": a > 1 and text[a - 1] in "-.:/" and text[a - 2].isalnum(), "joined_right": b + 1 < len(text) and text[b] in "-.:/" and text[b + 1].isalnum(),
        }
        on += [k for k, v in checks.items() if v]
        if checks["luhn"] and not any(checks[k] for k in ("adjacent_left", "adjacent_right", "joined_left", "joined_right")):
            on.append("luhn_free")
        if at:
            sign = next(k for k in range(i, j) if words[k] == "@" or lower[k] == "at")
            gap = lambda lo, hi: any(self.tokens[k][0] > self.tokens[k - 1][1] and words[k - 1][-1].isalnum() and words[k][0].isalnum() and "dot" not in lower[k - 1 : k + 1] for k in range(lo, hi))
            on += ["space_in_local"] * gap(i + 1, sign) + ["space_in_domain"] * gap(sign + 2, j) + ["ends_dot"] * (inner[-1] in ("dot", "at")) + ["top_level"] * (inner[-1] in _TOP_LEVEL)
            if _DOT_NEXT.match(text, b, b + 12):
                on.append("dot_follows")
            if _DOT_BEFORE.search(text[max(0, a - 8) : a]):
                on.append("dot_precedes")
        elif not any(w[0].isalpha() for w in words[i:j]):
            on.append(f"shape_{zlib.crc32(_GROUPS.sub(lambda m: str(min(20, len(m[0]))), span).encode()) % SHAPES}")
        on += [f"cue_{w}" for w in lower[max(0, i - 3) : i] if f"cue_{w}" in _AT]
        return [_AT[k] for k in on]


class Sparse:
    """Rows of 0 and 1 by the columns that are 1; every row has one."""

    def __init__(self, features: list[list[int]]):
        self.columns = np.array([c for f in features for c in f], np.int32)
        self.sizes = np.array([len(f) for f in features], np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """(rows, kinds)"""
        return np.add.reduceat(weights.T[self.columns], self.starts) if len(self.columns) else np.zeros((0, len(weights)))

    def add_to(self, gradient: np.ndarray, error: np.ndarray) -> None:
        np.add.at(gradient.T, self.columns, np.repeat(error, self.sizes, axis=0))


def decode(window: Window, weights: np.ndarray, step: int = STEP) -> list[Span]:
    """The best segmentation: tokens outside segments score 0. Segments are scored for `step` first tokens at a time, and each
    waits at its end until the best score there is settled, so the result is the whole window's at any length."""
    n = len(window.tokens)
    best, back = [0.0] * (n + 1), [(-1, -1)] * (n + 1)
    waiting: dict[int, list[tuple[float, int, int]]] = {}

    def settle(j: int) -> None:
        if j:
            best[j] = best[j - 1]
        for value, i, kind in waiting.pop(j, ()):
            if value > best[j]:
                best[j], back[j] = value, (i, kind)

    for first in range(0, n, step):
        last = min(n, first + step)
        segments, features = window.candidates(first, last)
        scores = Sparse(features).scores(weights)
        kinds, tops, k = scores.argmax(1).tolist(), scores.max(1).tolist(), 0
        for i in range(first, last):
            settle(i)
            while k < len(segments) and segments[k][0] == i:
                waiting.setdefault(segments[k][1], []).append((best[i] + tops[k], i, kinds[k]))
                k += 1
    settle(n)
    out, j = [], n
    while j:
        i, kind = back[j]
        if i < 0:
            j -= 1
        else:
            out.append((kind, window.tokens[i][0], window.tokens[j - 1][1]))
            j = i
    return out[::-1]


class Example:
    """A window with its true kind by segment (-1: none), ready for forward and backward sums."""

    def __init__(self, window: Window, gold: dict[tuple[int, int], int]):
        self.x, self.n = Sparse(window.features), len(window.tokens)
        self.kind = np.array([gold.get(s, -1) for s in window.segments])
        self.starts, self.ends = np.array([s[0] for s in window.segments]), np.array([s[1] for s in window.segments])
        self.into = [np.flatnonzero(self.ends == j) for j in range(self.n + 1)]
        self.out = [np.flatnonzero(self.starts == i) for i in range(self.n + 1)]

    def add_gradient(self, weights: np.ndarray, gradient: np.ndarray) -> None:
        """Adds the gradient of the log likelihood."""
        scores = self.x.scores(weights)
        total = np.logaddexp.reduce(scores, axis=1)
        ahead, behind = np.zeros(self.n + 1), np.zeros(self.n + 1)
        for j in range(1, self.n + 1):
            k = self.into[j]
            ahead[j] = np.logaddexp(ahead[j - 1], np.logaddexp.reduce(ahead[self.starts[k]] + total[k])) if len(k) else ahead[j - 1]
        for i in range(self.n - 1, -1, -1):
            k = self.out[i]
            behind[i] = np.logaddexp(behind[i + 1], np.logaddexp.reduce(behind[self.ends[k]] + total[k])) if len(k) else behind[i + 1]
        error = -np.exp(ahead[self.starts][:, None] + scores + behind[self.ends][:, None] - ahead[self.n])
        true = np.flatnonzero(self.kind >= 0)
        error[true, self.kind[true]] += 1
        self.x.add_to(gradient, error)


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around triggers, merged where they meet; MARGIN tokens are taken as 12 characters each."""
    found = [(m.start(), m.end()) for m in _TRIGGER.finditer(text)] if _TRIGGER.search(text) else []
    if " dot " in text:
        found = sorted(found + [(m.start(), m.end()) for m in _SPELLED.finditer(text)])
    lo = hi = None
    for a, b in found:
        a, b = max(0, a - MARGIN * 12), min(len(text), b + MARGIN * 12)
        if lo is not None and a <= hi:
            hi = max(hi, b)
        else:
            if lo is not None:
                yield lo, hi
            lo, hi = a, b
    if lo is not None:
        yield lo, hi


def _rewritten(kind: int, span: str, rng: random.Random) -> str:
    """Another form of the same entity."""
    if kind == 0:
        local, _, domain = span.partition("@")
        return rng.choice([f"{local} at {domain.replace('.', ' dot ')}", f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local}(at){domain}", f"{local} @ {domain}", f"{local}[at]{domain.replace('.', '[dot]')}"])
    if kind == 1:
        return rng.choice([span.replace(".", "[.]"), span.replace(".", "(.)"), span.replace(".", " . ")])
    digits = _digits(span)
    if kind == 2:
        parts = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return rng.choice([".", "/", "_", ""]).join(parts)
    tail = digits[-10:]
    return rng.choice([f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}", f"1-{tail[:3]}-{tail[3:6]}-{tail[6:]}"])


def _harmless(rng: random.Random) -> str:
    """Text with digits or address words that is no one's data."""
    r = lambda n: str(rng.randrange(10 ** (n - 1), 10**n))
    return rng.choice([
        f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}", f"{rng.randrange(1, 29)}.{rng.randrange(1, 13)}.{rng.randrange(1900, 2100)}",
        f"{rng.randrange(1, 13)}/{rng.randrange(1, 29)}/{rng.randrange(1900, 2100)}", r(rng.randrange(4, 13)), f"{r(3)},{r(3)},{r(3)}", f"{r(4)}.{r(2)}", f"{r(3)}-{r(2)}", f"v{r(1)}.{r(1)}.{r(2)}.{r(4)}",
        f"{rng.randrange(0, 24):02}:{rng.randrange(0, 60):02}:{rng.randrange(0, 60):02}", f"page {r(4)} at line {r(4)}", "look at that dot there", f"{r(4)} to {r(4)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), r(16)[:-1] + "x",
        f"ISBN {rng.choice(['978', '979'])}-{r(1)}-{r(2)}-{r(6)}-{r(1)}", f"{r(1)}-{r(3)}-{r(5)}-{rng.choice('0123456789X')}", ":".join(f"{rng.randrange(65536):x}" for _ in range(8)), f"2001:db8::{r(4)}:{r(4)}",
        f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}T{rng.randrange(24):02}:{rng.randrange(60):02}:{rng.randrange(60):02}", f"{r(8)}-{r(4)}-{r(4)}-{r(4)}-{r(12)}", f"no. {r(2)}-{r(4)}-{r(3)}", f"({r(4)}) {r(2)}, {r(3)}-{r(3)}",
    ])


def _changed(text: str, spans: list[Span], rng: random.Random, harmless: bool) -> tuple[str, list[Span]]:
    """The text with its spans rewritten, or with harmless text in their places."""
    out, at, size, moved = [], 0, 0, []
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        span = text[a:b]
        if kind == 0 and rng.random() < 0.5:  # also local parts without digits
            span = re.sub("[0-9]+", "", span.partition("@")[0]).strip("._-+%") + "x@" + re.sub("[0-9]+", "", span.partition("@")[2])
        new = _harmless(rng) if harmless else _rewritten(kind, span, rng)
        start = size + a - at
        out += [text[at:a], new]
        size, at = start + len(new), b
        if not harmless:
            moved.append((kind, start, size))
    return "".join([*out, text[at:]]), moved


def train(texts: list[str], most: int = 250, rounds: int = 12, rate: float = 0.4, decay: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights by kind and feature: AdaGrad on the likelihood of windows around at most `most` base spans of each kind,
    each as it is, rewritten, and replaced by harmless text."""
    rng, examples, seen = random.Random(seed), [], [0] * len(KINDS)
    marked_texts = [(text, spans) for text in texts if (spans := base_spans(text))]
    copies = max(1, min(6, 600 // max(1, len(marked_texts))))  # few texts are rewritten more often
    for text, spans in marked_texts:
        if all(seen[k] >= most for k, _, _ in spans):
            continue
        for kind, _, _ in spans:
            seen[kind] += 1
        rewritten = [_changed(text, spans, rng, False) for _ in range(copies * (3 if any(k == 0 for k, _, _ in spans) else 1))]
        for body, marked in [(text, spans), *rewritten, *(_changed(text, spans, rng, True) for _ in range(copies))]:
            for lo, hi in _windows(body):
                window = Window(body, lo, hi)
                if len(window.tokens) > 120 or not window.segments:
                    continue
                begin, end = {a: i for i, (a, _) in enumerate(window.tokens)}, {b: i + 1 for i, (_, b) in enumerate(window.tokens)}
                gold = {(begin[a], end[b]): kind for kind, a, b in marked if a in begin and b in end}
                # a plain card number that the pattern lost to a neighbour says nothing
                if any(_AT["luhn_free"] in f and _AT["digits_only"] in f and s not in gold for s, f in zip(window.segments, window.features, strict=True)):
                    continue
                examples.append(Example(window, gold))
    weights = np.zeros((len(KINDS), len(_NAMES)))
    weights[:, _AT["bias"]] = -2.0
    if not any((e.kind >= 0).any() for e in examples):
        return weights - 1e6 * (np.arange(len(_NAMES)) == _AT["bias"])
    squares = np.full_like(weights, 1e-3)
    for _ in range(rounds):
        rng.shuffle(examples)
        for lo in range(0, len(examples), 20):
            g = np.zeros_like(weights)
            for example in examples[lo : lo + 20]:
                example.add_gradient(weights, g)
            g = g / 20 - decay * weights
            squares += g * g
            weights += rate * g / np.sqrt(squares)
    return weights


def spans_of(text: str, weights: np.ndarray | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by kind and start."""
    base = base_spans(text)
    if weights is None:
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    added = [s for lo, hi in _windows(text) for s in decode(Window(text, lo, hi), weights) if not any(a < s[2] and s[1] < b for a, b in taken)]
    return base, sorted({*base, *added})


# ---------------------------------------------------------------- the operator


def _around(text: str, most: int, margin: int = 150) -> list[str]:
    """Whole-word surroundings of the first `most` base spans of a text."""
    out = []
    for _, a, b in sorted(base_spans(text), key=lambda s: s[1])[:most]:
        lo, hi = text.find(" ", max(0, a - margin)) + 1, text.rfind(" ", 0, b + margin)
        out.append(text[lo if 0 < lo <= a else max(0, a - margin) : hi if hi >= b else b + margin])
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, spans: int = 4) -> np.ndarray:
    """Weights from at most `spans` base spans of each of `sample` documents with a digit; only their surroundings are gathered."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9]") & F.col("id").isNotNull())
    chosen = smallest(docs.select("id"), "id", sample).distinct()  # bounded by its parameter

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x for t in batch.column("text").to_pylist() for x in _around(t, spans)], pa.string())], names=["around"])

    def fit(rows: pa.Table) -> pa.Table:
        return pa.table([range(len(KINDS)), train(sorted(rows.column("around").to_pylist())).tolist()], names=["kind", "weights"])

    found = docs.join(F.broadcast(chosen), "id", "left_semi").select("text").mapInArrow(around, "around string")
    rows = found.groupBy().applyInArrow(fit, "kind long, weights array<double>").orderBy("kind").collect()
    return np.array([r.weights for r in rows]) if rows else train([])


def _mapped(docs: DataFrame, weights: np.ndarray | None, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), *make([(t or "", *spans_of(t or "", shared.value)) for t in some.column(1).to_pylist()])], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""

    def make(rows: list[tuple[str, list[Span], list[Span]]]) -> list[pa.Array]:
        counts = [pa.array([sum(k == kind for k, _, _ in base) for _, base, _ in rows], pa.int64()) for kind in range(len(KINDS))]
        return [*counts, pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for _, base, _ in rows]), pa.array([_joined(spans) for _, _, spans in rows]), pa.array([len(spans) - len(base) for _, base, spans in rows], pa.int64())]

    return _mapped(docs, weights, id_col, text_col, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; n_chars, if there, follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def hide(text: str | None) -> str | None:
        if text is None:
            return None
        out, end = [], 0
        for kind, a, b in sorted(spans_of(text, shared.value)[1], key=lambda s: (s[1], -s[2])):
            if a >= end:
                out += [text[end:a], f"[{KINDS[kind].upper()}]"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                columns = list(some.columns)
                columns[at] = pa.array([hide(t) for t in some.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=some.schema.names)

    out = docs.withColumn(text_col, F.col(text_col).cast("string"))
    out = out.mapInArrow(run, out.schema)
    if "n_chars" in docs.columns and text_col != "n_chars":
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, learn(docs))
