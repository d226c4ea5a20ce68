"""Operator 10: removing repeated and nearly repeated lines, with DataFrame functions only.

Lines of at least MIN_CHARS characters (without the white space around them) are equal within EDITS edits if they agree in
one of EDITS + 1 segments (pigeonhole). Every distinct line is indexed by its segments, with its length and the segment's
number, and probes the indexes of lines up to EDITS characters shorter with the substrings at the only offsets that can
match. All these keys are dealt once, by key; keys where a line meets an indexed one are found there by their least and
greatest line, and only their lines go on. The lines of a key that many share are told apart by further segments of what is left
of them without the shared one, so families of lines that are alike in all but a field do not meet in pairs. Candidates whose counts of letters differ too much go (a necessary
condition); the other pairs are verified by edit distance in a band of 2 * EDITS + 1 bits that moves down the diagonal.
Linked lines form classes; of each class the first line in order of (doc_id, text's digest, line number) stays and all others
go.

Defined results: null and blank texts have no lines to remove; documents with null id stay as they are and are no one's
first occurrence; rows that share an id and differ in text are judged apart, rows alike in both are alike in their result; ties
cannot occur, as occurrences are ordered; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ._io import SPACES, discard, row_tag, stored, table

EDITS = 2
MIN_CHARS = 24
#: Letters and digits whose numbers are compared before two lines are.
LETTERS, DIGITS = "eainotrshlducmgw", "0123456789"
#: Rows of a key whose lines are compared with each other; those of larger keys are told apart by the rest of the line first.
FEW = 200


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """First character (from 1) and size of segment i (from 0); the last ones are longer."""
    size = lambda k: F.floor((length + k) / (edits + 1)).cast("int")
    start = F.lit(1)
    for k in range(i):
        start = start + size(k)
    return start, size(i)


def _key(length: Column, i: int, text: Column, group: Column | None = None) -> Column:
    return F.xxhash64(length, F.lit(i), text) if group is None else F.xxhash64(group, length, F.lit(i), text)


def ways(edits: int) -> list[tuple[int, int, int]]:
    """(less, segment, shift): the keys of a line. The first edits + 1 are those under which it is indexed; the others find lines that
    are `less` characters shorter and hold the segment `shift` characters earlier. A segment in its own place is both."""
    out = [(0, i, 0) for i in range(edits + 1)]
    for less in range(edits + 1):
        for i in range(edits + 1):
            after = edits - i
            out += [(less, i, shift) for shift in range(max(-i, less - after), min(i, less + after) + 1) if less or shift]
    return out


def _place(length: Column, way: tuple[int, int, int], edits: int) -> tuple[Column, Column]:
    less, i, shift = way
    start, size = _segment(length - less, i, edits)
    return start + shift, size


def line_keys(line: Column, length: Column, edits: int) -> Column:
    """The keys of a line, in the order of ways()."""
    return F.array(*(_key(length - w[0], w[1], F.substring(line, *_place(length, w, edits))) for w in ways(edits)))


def without(line: Column, length: Column, way: tuple[int, int, int], edits: int) -> Column:
    """The line without the segment that the key is made of."""
    start, size = _place(length, way, edits)
    return F.concat(F.substring(line, F.lit(1), start - 1), F.substring(line, start + size, length))


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the texts' edit distance is at most edits: bit-parallel columns of a band along the diagonal.

    Bit k of the band at column j stands for row j - edits + k of the longer text. The running score follows the band's
    last row; when that row lies beneath the longer text it moves up along the last row instead.
    """
    longer, shorter = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    width = 2 * edits + 1
    full = (1 << width) - 1
    whole = F.struct(F.split(longer, "").alias("rows"), F.split(shorter, "").alias("columns"))

    def core(x: Column) -> Column:
        """Without the common start and end, which no edit needs."""
        n = F.size(x["columns"])
        same = lambda p, q: F.zip_with(F.slice(p, 1, n), q, lambda c, d: c == d)
        start = F.coalesce(F.nullif(F.array_position(same(x["rows"], x["columns"]), False), F.lit(0)) - 1, n).cast("int")
        end = F.coalesce(F.nullif(F.array_position(same(F.reverse(x["rows"]), F.reverse(x["columns"])), False), F.lit(0)) - 1, n).cast("int")
        end = F.least(end, n - start)
        return F.struct(F.slice(x["rows"], start + 1, F.size(x["rows"]) - start - end).alias("rows"), F.slice(x["columns"], start + 1, n - start - end).alias("columns"))


    def distance(x: Column) -> Column:
        m = F.size(x["rows"])

        def step(state: Column, j: Column) -> Column:  # j from 0
            match = F.lit(0)
            for k in range(width):
                match = match + F.when(F.get(x["rows"], j - edits + k) == F.get(x["columns"], j), 1 << k).otherwise(0)
            on = F.struct(match.alias("match"), *(state[c].alias(c) for c in ("up", "down", "low", "score")))

            def rest(s: Column) -> Column:
                diagonal = ((s["match"].bitwiseAND(s["up"]) + s["up"]).bitwiseXOR(s["up"])).bitwiseOR(s["match"]).bitwiseOR(s["down"]).bitwiseAND(F.lit(full))
                right_up = s["down"].bitwiseOR(diagonal.bitwiseOR(s["up"]).bitwiseXOR(F.lit(full)))
                right_down = diagonal.bitwiseAND(s["up"])
                moved = F.shiftright(diagonal, 1)
                inside = j + edits < m  # the band's last row is a row of the longer text
                score = s["score"] + F.when(inside, 1 - F.shiftright(diagonal, width - 1)).otherwise(_bit(right_up, s["low"] + 1, width) - _bit(right_down, s["low"] + 1, width))
                return F.struct(
                    right_down.bitwiseOR(moved.bitwiseOR(right_up).bitwiseXOR(F.lit(full))).bitwiseAND(F.lit(full)).alias("up"),
                    moved.bitwiseAND(right_up).alias("down"),
                    F.when(inside, s["low"]).otherwise(s["low"] + 1).alias("low"),
                    score.alias("score"),
                )

            # neighbouring rows differ by at most one, so all of the band are over the limit here
            return F.when(state["score"] > 3 * edits, state).otherwise(F.element_at(F.transform(F.array(on), rest), 1))

        start = F.struct(F.lit(full - ((1 << edits) - 1)).alias("up"), F.lit(0).alias("down"), F.lit(0).alias("low"), F.lit(edits).alias("score"))
        many = F.size(x["columns"])
        return F.when(many == 0, m).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), start, step, lambda s: s["score"]))

    near = F.length(longer) - F.length(shorter) <= edits
    return near & (F.element_at(F.transform(F.transform(F.array(whole), core), distance), 1) <= edits)


def _bit(value: Column, below: Column, width: int) -> Column:
    """The bit of value `below` places under the band's last row; 0 beyond the band."""
    out = F.lit(0)
    for k in range(1, width):
        out = F.when(below == k, F.shiftright(value, width - 1 - k).bitwiseAND(F.lit(1))).otherwise(out)
    return out


def character_counts(line: Column) -> Column:
    """The numbers of LETTERS and of DIGITS, each modulo 16, in two whole numbers."""
    count = lambda c: (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(15)).cast("long")

    def packed(characters: str) -> Column:
        out = F.lit(0).cast("long")
        for k, c in enumerate(characters):
            out = out.bitwiseOR(F.shiftleft(count(c), 4 * k))
        return out

    return F.array(packed(LETTERS), F.when(line.rlike("[0-9]"), packed(DIGITS)).otherwise(F.lit(0).cast("long")))


def counts_apart(a: Column, b: Column) -> Column:
    """Sum of the differences of two character_counts(), at most their true sum. An edit changes two counts by one at most."""
    total = F.lit(0).cast("long")
    for at, characters in enumerate((LETTERS, DIGITS)):
        for k in range(len(characters)):
            field = lambda x: F.shiftright(F.get(x, F.lit(at)), 4 * k).bitwiseAND(F.lit(15).cast("long"))  # noqa: B023, E731
            gap = (field(a) - field(b)).bitwiseAND(F.lit(15).cast("long"))
            total = total + F.least(gap, 16 - gap)
    return total


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc_id, tag, line_no, line, h1, h2 for the lines that count; two 64-bit hashes name a line, id and tag its row."""
    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), row_tag(text).alias("tag"), F.split(text, "\n", -1).alias("raw"))  # the digest before the lines, once a text
    lines = rows.select("doc_id", "tag", F.posexplode_outer("raw").alias("line_no", "raw")).select("doc_id", "tag", "line_no", F.btrim("raw", F.lit(SPACES)).alias("line")).where(F.length("line") >= min_chars)
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(2), "line")})


def candidates(texts: DataFrame, edits: int) -> DataFrame:
    """key, h1, own for the lines under each key where a line meets another that is indexed there. texts: distinct h1, line."""
    line, length = F.col("line"), F.length("line")
    rows = texts.select("h1", F.posexplode(line_keys(line, length, edits)).alias("pos", "key")).select("key", "h1", F.col("pos").cast("byte").alias("pos")).repartition("key")
    return _met(rows, F.col("pos") <= edits).distinct()


def _met(rows: DataFrame, own: Column) -> DataFrame:
    """The rows (dealt by key) of the keys where a line meets another that is indexed there, with the number of the key's rows."""
    met = rows.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most"), F.max(own).alias("indexed"), F.count(F.lit(1)).alias("many"))
    met = met.where("indexed and least <> most").select("key", "many")
    # an inner join, as a semi-join would move below the exchange, which both sides are to share
    return rows.join(met.hint("shuffle_hash"), "key")


def apart(members: DataFrame, texts: DataFrame, edits: int, few: int = FEW) -> list[DataFrame]:
    """key, h1, own, whole: members of keys with at most `few` rows. The lines of larger keys are told apart by the rest of them.

    Lines that share a segment and are within edits of each other are so in what is left without it, which has segments again:
    so a key that many lines share is dealt anew by its lines' shorter rests, until keys are small or rests are of less than
    edits + 1 characters. Lines indexed under such a last key differ in those characters alone: they all link with its first
    (whole is false: no other pair of them is needed). A row goes on with the shorter lines of its own key's length only.
    """
    line, length, all_ways = F.col("line"), F.length("line"), ways(edits)
    found = [members.where(F.col("many") <= few).select("key", "h1", (F.col("pos") <= edits).alias("own"), F.lit(True).alias("whole"))]
    rest, lead = F.lit(None).cast("string"), F.lit(0)
    for pos, way in enumerate(all_ways):
        rest, lead = F.when(F.col("pos") == pos, without(line, length, way, edits)).otherwise(rest), F.when(F.col("pos") == pos, way[0]).otherwise(lead)
    hot = members.where(F.col("many") > few).join(texts.select("h1", "line"), "h1").select("key", "h1", rest.alias("line"), lead.cast("byte").alias("lead"))
    hot = stored(hot, "rests")
    while not hot.isEmpty():
        some = []
        for less in range(edits + 1):
            mine = [w for w in all_ways if w[0] == less]
            made = F.array(*(F.struct(_key(length - less, w[1], F.substring(line, *_place(length, w, edits)), F.col("key")).alias("key"), F.lit(w in all_ways[: edits + 1]).alias("own"), without(line, length, w, edits).alias("line")) for w in mine))
            some.append(F.when(F.col("lead") == less, made))
        level = stored(_met(hot.select("h1", "lead", F.inline(F.coalesce(*some))).repartition("key"), F.col("own")), "rests")
        large = F.col("many") > few
        last = F.length("line") - F.col("lead") <= edits
        found.append(level.where(~large | last).select("key", "h1", "own", (~large).alias("whole")))
        discard(hot)
        hot = stored(level.where(large & ~last).select("key", "h1", "line", "lead").distinct(), "rests")
    discard(hot)
    return found


def near_lines(texts: DataFrame, edits: int, few: int = FEW) -> DataFrame:
    """h1, h2, component for the distinct lines (h1, h2, line) that are within edits of another one."""
    keys = stored(candidates(texts, edits), "keys")
    members = keys.select("key", "h1", F.lit(None).cast("boolean").alias("own"), F.lit(None).cast("boolean").alias("whole")).where("false")
    for part in apart(keys, texts, edits, few):
        members = members.union(part)
    members = stored(members, "members")
    discard(keys)
    some = texts.join(members.select("h1").distinct().hint("shuffle_hash"), "h1", "left_semi").withColumns({"node": F.monotonically_increasing_id(), "letters": character_counts(F.col("line"))})
    some = stored(some, "some")
    named = members.join(some.select("h1", "node", "letters"), "h1")
    side = lambda role: named.select("key", *(F.col(c).alias(f"{role}_{c}") for c in ("node", "letters", "own", "whole")))
    heads = named.where("own and not whole").groupBy("key").agg(F.min("node").alias("head"))
    stars = named.where("own and not whole").join(heads, "key").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    maybe = side("a").where("a_own").join(side("b"), "key").where(F.col("a_whole") | ~F.col("b_own")).where(F.when(F.col("b_own"), F.col("a_node") < F.col("b_node")).otherwise(F.col("a_node") != F.col("b_node")))
    maybe = maybe.where(counts_apart(F.col("a_letters"), F.col("b_letters")) <= 2 * edits)
    maybe = stored(maybe.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).union(stars).distinct(), "pairs")
    text = lambda role: some.select(F.col("node").alias(role), F.col("line").alias(f"{role}_line"))
    pairs = maybe.join(text("a"), "a").join(text("b"), "b").where(within_edits(F.col("a_line"), F.col("b_line"), edits))
    links = stored(pairs.select("a", "b"), "links")
    found = stored(some.select("h1", "h2", "node").join(components(links), "node").select("h1", "h2", "component"), "near")
    discard(members, some, maybe, links)
    return found


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, tag, line_no, first for every line of a class with another line; first: whether it is the class's first."""
    lines = occurrences(docs, id_col, text_col, min_chars)
    at = stored(lines.select("doc_id", "tag", "line_no", "h1", "h2"), "lines")
    texts = stored(lines.select("h1", "h2", "line").distinct(), "texts")
    near = near_lines(texts, edits)
    discard(texts)
    repeated = at.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("h1", "h2")
    classes = repeated.join(near, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("component", "h1").alias("c1"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(F.lit(0)).alias("c2"))
    placed = stored(at.join(classes.hint("shuffle_hash"), ["h1", "h2"]).select("doc_id", "tag", "line_no", "c1", "c2"), "placed")
    place = F.struct("doc_id", "tag", "line_no")
    heads = placed.groupBy("c1", "c2").agg(F.min(place).alias("head"))
    out = stored(placed.join(heads, ["c1", "c2"]).select("doc_id", "tag", "line_no", (place == F.col("head")).alias("first")), "classes")
    discard(at, placed, near)
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with its columns under `doc`, cleaned (the text without its repeated lines), n_lines, n_removed."""
    found = line_classes(docs, id_col, text_col, edits, min_chars)
    gone = found.where("not first").groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_set("line_no").alias("_gone"))
    text = F.col("doc")[text_col].cast("string")
    df = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("_id"), row_tag(F.col(text_col).cast("string")).alias("_tag"))
    df = df.join(gone.hint("shuffle_hash"), ["_id", "_tag"], "left")
    some = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    cleaned = F.when(F.col("_gone").isNull(), text).otherwise(some)
    count = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0))
    return df.select("doc", cleaned.alias("cleaned"), count.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_removed", F.coalesce(F.length("cleaned"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.coalesce("cleaned", F.lit(""))).alias("kept_md5"))


def op10_sql() -> str:
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH RECURSIVE docs AS (SELECT *, row_number() OVER () AS row_id, left(md5(text), 15) AS tag FROM documents),
lines AS (
  SELECT row_id, doc_id, tag, j - 1 AS line_no, ls[j] AS raw, trim(ls[j], {spaces}) AS line
  FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS ls FROM docs), unnest(range(1, len(ls) + 1)) AS u(j)),
placed AS (SELECT *, dense_rank() OVER (ORDER BY doc_id, tag, line_no) AS pos FROM lines),
once AS (
  SELECT line, min(pos) AS pos, length(line) AS n FROM placed WHERE length(line) >= {MIN_CHARS} AND doc_id IS NOT NULL GROUP BY line),
near AS (
  SELECT a.pos AS a, b.pos AS b FROM once a JOIN once b ON a.line <> b.line AND b.n BETWEEN a.n AND a.n + {EDITS}
  WHERE (left(a.line, 8) = left(b.line, 8) OR right(a.line, 8) = right(b.line, 8) OR contains(b.line, substr(a.line, 9, a.n - 16)))
    AND levenshtein(a.line, b.line) <= {EDITS}),
edges AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT pos AS node, pos AS head FROM once UNION SELECT e.b, r.head FROM reach r JOIN edges e ON e.a = r.node),
heads AS (SELECT node, min(head) AS head FROM reach GROUP BY node),
judged AS (
  SELECT l.row_id, l.doc_id, l.line_no, l.raw, l.line, coalesce(l.doc_id IS NOT NULL AND h.head <> l.pos, false) AS gone
  FROM placed l LEFT JOIN once o ON o.line = l.line LEFT JOIN heads h ON h.node = o.pos),
kept AS (
  SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS cleaned FROM judged GROUP BY row_id, doc_id)
SELECT doc_id, n_lines, n_removed, length(cleaned)::BIGINT AS kept_chars, md5(cleaned) AS kept_md5 FROM kept"""
