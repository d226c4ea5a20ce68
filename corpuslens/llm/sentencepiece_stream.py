"""Operator 9: SentencePiece ids by a streaming Viterbi search, and their text again.

The given model is of the BPE kind: its pieces carry merge ranks, not log probabilities, so a search for the highest sum
of scores would not give its ids. The search here keeps the Viterbi form, with merge compatibility as its rule: at each
position exactly one piece can end the encoding of the prefix, namely the one that the piece before it may precede (merging
the two pieces' text gives just the two pieces). Each position keeps a backpointer; no piece is longer than `longest`
characters, so only the last `longest` positions survive, and ids are committed as soon as the surviving paths meet in one
boundary. Memory is bounded by the window, not by the text. Words are remembered, since no piece crosses a word's start.

Defined results: null and empty texts have no ids; characters without a piece become their bytes' ids; equal rows give equal
rows; an empty table gives an empty result; null ids of rows pass through; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table

SPACE = "▁"
#: Words remembered, and pairs of pieces judged, by a worker.
CACHE = 800_000
#: Characters between attempts to commit.
STRIDE = 32
#: No piece, before a piece; and what parts two ids in one key.
NONE, SHIFT = -1, 1 << 24

_STATE: dict = {}


class Model:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids))
        self.text = [b""] * n
        for piece, i in self.ids.items():
            self.text[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.byte.items():
            self.text[i] = bytes([value])
        #: No piece holds a space after another character: a search may start anew at each word.
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.by_lines = not any("\n" in p for p in self.ids)
        #: Pieces by their characters, one after another; "" holds the id of a piece that ends.
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.piece = {i: p for p, i in self.ids.items()}
        #: Two characters that stand side by side in some piece; between any others all paths meet.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def merged(self, text: str) -> list[str]:
        """Best-ranked adjacent merges first, the leftmost of equals: the definition, for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -1e30), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def follows(self, before: int, piece: int) -> bool:
        """Whether an encoding may have the two pieces side by side; before may be NONE (the start, or a byte)."""
        second = self.piece[piece]
        if before == NONE:
            return self.merged(second) == [second]
        return self.merged(self.piece[before] + second) == [self.piece[before], second]

    def _extend(self, window: str, last: list[int], back: list[int], to: int) -> None:
        """Backpointers of the window's positions up to `to`: pieces that end there, longest first, after what ends at their start."""
        done, pairs, root = len(last) - 1, self.pairs, self.trie
        ending: list[list[tuple[int, int]]] = [[] for _ in range(done, to + 1)]
        for start in range(max(0, done + 1 - self.longest), to):
            node = root
            for at in range(start, to):
                if (node := node.get(window[at])) is None:
                    break
                if at >= done and "" in node:
                    ending[at + 1 - done].append((start, node[""]))
        for found in ending[1:]:
            for start, piece in found:
                key = last[start] * SHIFT + piece
                if (fits := pairs.get(key)) is None:
                    if len(pairs) > CACHE:
                        pairs.clear()
                    fits = pairs[key] = self.follows(last[start], piece)
                if fits:
                    last.append(piece)
                    back.append(start)
                    break
            else:
                back.append(len(last) - 1)
                last.append(NONE)

    def stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """Ids, as they become certain."""
        window = ""  # text since the last committed boundary
        last: list[int] = [NONE]  # of each position: the piece that ends there
        back: list[int] = [0]  # and where it starts
        for chunk in chunks:
            window += chunk
            while len(last) <= len(window):
                self._extend(window, last, back, min(len(window), len(last) - 1 + STRIDE))
                at = len(last) - 1
                alive = set(range(max(0, at - self.longest + 1), at + 1))
                while len(alive) > 1:
                    alive.remove(top := max(alive))
                    alive.add(back[top])
                if meet := alive.pop():
                    yield from self._path(window, last, back, meet)
                    window, last, back = window[meet:], last[meet:], [max(0, b - meet) for b in back[meet:]]
        yield from self._path(window, last, back, len(window))

    def _path(self, window: str, last: list[int], back: list[int], at: int) -> list[int]:
        """The ids of the path to a position; a character without a piece gives its bytes' ids."""
        out = []
        while at:
            if last[at] == NONE:
                out += [self.byte.get(b, self.unknown) for b in reversed(window[at - 1].encode())]
            else:
                out.append(last[at])
            at = back[at]
        out.reverse()
        return out

    def _ids(self, text: str) -> bytes:
        if len(text) > STRIDE:
            return array("i", self.stream((text,))).tobytes()
        last, back = [NONE], [0]
        self._extend(text, last, back, len(text))
        return array("i", self._path(text, last, back, len(text))).tobytes()

    def _remembered(self, words: list[str], spaced: int) -> list[bytes]:
        known, out = self.words[spaced], []
        for w in words:
            if (ids := known.get(w)) is None:
                if len(known) > CACHE:
                    known.clear()
                if len(w) > 1 and not w[-1].isalnum() and w[-2:] not in self.inside:  # all paths meet before the mark
                    ids = self._remembered([w[:-1]], spaced)[0] + self._remembered([w[-1]], 0)[0]
                else:
                    ids = self._ids(SPACE + w if spaced else w)
                known[w] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> bytes:
        """Ids as native 32-bit numbers."""
        if not text:
            return b""
        if not (self.by_words and self.by_lines):
            return self._ids(SPACE + text.replace(" ", SPACE))
        newline = array("i", [self.byte.get(10, self.unknown)]).tobytes()
        lines = []
        for k, line in enumerate(text.split("\n")):
            if "  " in line or SPACE in line or " " in (line[:1], line[-1:]):
                lines.append(self._ids((SPACE if not k else "") + line.replace(" ", SPACE)))
                continue
            first, *others = line.split(" ")
            lines.append(b"".join(self._remembered([first], not k) + self._remembered(others, 1)) if line or not k else b"")
        return newline.join(lines)

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.text.__getitem__, array("i", ids)))
        return raw.decode(errors="replace").removeprefix(" ")


def model(path: str) -> Model:
    if path not in _STATE:
        _STATE[path] = Model(path)
    return _STATE[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded: the text that the ids give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                ids = [m.encode(t or "") for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([array("i", x) for x in ids], pa.list_(pa.int32())), pa.array([m.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), n_byte_ids, round_trip: decoding gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        raw = np.zeros(len(m.text), bool)
        raw[list(m.byte.values())] = True
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                texts = [t or "" for t in some.column(1).to_pylist()]
                ids = [m.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([int(raw[np.frombuffer(x, np.int32)].sum()) for x in ids], pa.int64()), pa.array([m.decode(x) == t for x, t in zip(ids, texts, strict=True)])], names=["doc_id", "n_ids", "ids_crc32", "n_byte_ids", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_byte_ids long, round_trip boolean")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))
