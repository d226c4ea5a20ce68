"""Author networks, citation graphs and connected components, as joins and aggregates on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import steady
from .storage import discard, kept


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node within reach) for each node of an edge a, b between two nodes.

    Randomised contraction: in each round every node moves to the first of itself and its neighbours in a new random order,
    and edges become the edges of what is left. Edges shrink by a constant factor a round, so all rounds together cost a
    few times the first, whatever the shapes are; a star of any size goes in one. Edges and moves of a round are written to the
    shared folder, so a lost executor costs one round.
    """
    link = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = kept(edges.where(F.col("a") != F.col("b")).select(link.alias("l")).select("l.*").distinct(), "edges")
    moves: list[DataFrame] = []
    while not live.isEmpty():
        order = lambda c, seed=len(moves): F.xxhash64(F.lit(seed), c)
        both = live.union(live.select("b", "a"))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", order("b")).alias("first"))
        moves.append(kept(first.select("node", F.when(order("first") < order("node"), F.col("first")).otherwise(F.col("node")).alias("to")), "moves"))
        to = lambda c: moves[-1].select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        moved = live.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        old, live = live, kept(moved.where(F.col("a") != F.col("b")).select(link.alias("l")).select("l.*").distinct(), "edges")
        discard(old)
    if not moves:
        found = kept(live.select(F.col("a").alias("node"), F.col("a").alias("component")), "components")
        discard(live)
        return found
    ends = moves[-1]
    for move in moves[-2::-1]:
        further = ends.select(F.col("node").alias("to"), F.col("to").alias("end"))
        ends = move.join(further, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    ends = kept(ends, "ends")
    least = ends.groupBy("to").agg(F.min("node").alias("component"))
    found = kept(ends.join(least, "to").select("node", "component"), "components")
    discard(live, ends, *moves)
    return found


def author_list(author_ids: Column, first_author: Column) -> Column:
    """The `;` list without blanks, else the first author alone."""
    listed = F.filter(F.transform(F.split(F.coalesce(author_ids, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    alone = F.when(F.coalesce(first_author, F.lit("")) != "", F.array(first_author)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(listed) > 0, listed).otherwise(alone)


def author_pairs(papers: DataFrame, paper: str = "paper", author: str = "author", block: int = 256) -> DataFrame:
    """paper, a, b with a < b: distinct co-authors of each paper.

    A list of up to `block` authors is paired within its own row. A longer one is cut into blocks in order, and each pair of
    blocks becomes a row dealt to the tasks anew, so no row holds more than two blocks and no task all pairs of a paper."""
    one = papers.where(F.col(author).isNotNull()).groupBy(F.col(paper).alias("paper")).agg(F.sort_array(F.collect_set(author)).alias("of"))
    short = one.where(F.size("of") <= block).select("paper", F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("of").alias("x"), F.col("of").alias("y"))
    cut = lambda k: F.slice("of", F.col(k) * block + 1, F.lit(block))
    last = F.floor((F.size("of") - 1) / block).cast("int")
    long = one.where(F.size("of") > block).withColumn("i", F.explode(F.sequence(F.lit(0), last))).withColumn("j", F.explode(F.sequence("i", last)))
    long = long.select("paper", "i", "j", cut("i").alias("x"), cut("j").alias("y")).repartition("paper", "i", "j")
    firsts = short.unionByName(long).select("paper", "i", "j", "y", F.posexplode("x").alias("at", "a"))
    rest = F.when(F.col("i") == F.col("j"), F.slice("y", F.col("at") + 2, F.size("y"))).otherwise(F.col("y"))
    return firsts.select("paper", "a", F.explode(rest).alias("b"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Joint papers of each pair."""
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def network_features(papers: DataFrame, paper: str = "paper", author: str = "author") -> DataFrame:
    """A row for each paper with an author."""
    rows = papers.where(F.col(author).isNotNull()).select(F.col(paper).alias("paper"), F.col(author).alias("author")).distinct()
    pairs = author_pairs(papers, paper, author)
    counts = pair_counts(pairs)
    by_author = rows.groupBy("author").agg(F.count(F.lit(1)).alias("papers"))
    degree = counts.select(F.col("a").alias("author")).union(counts.select(F.col("b").alias("author"))).groupBy("author").agg(F.count(F.lit(1)).alias("degree"))
    sizes = rows.groupBy("paper").agg(F.count(F.lit(1)).alias("m"))
    of_authors = rows.join(by_author, "author").join(degree, "author", "left").join(sizes, "paper").groupBy("paper").agg(
        F.first("m").alias("m"),
        F.avg((F.col("papers") > 1).cast("double")).alias("reuse"),
        F.max("papers").alias("most"),
        F.avg(F.coalesce(F.try_divide(F.col("m") - 1, F.col("degree")), F.lit(0.0))).alias("shared"),
    )
    of_pairs = pairs.join(counts, ["a", "b"]).groupBy("paper").agg(F.avg((F.col("n") > 1).cast("double")).alias("density"), F.avg(F.least(F.col("n") / 3, F.lit(1.0))).alias("clique"))
    out, several = of_authors.join(of_pairs, "paper", "left"), F.col("m") > 1
    return out.select(
        "paper", steady(F.col("reuse")).alias("author_reuse_rate"), F.col("most").alias("max_author_papers"),
        steady(F.when(several, F.col("density")).otherwise(0.0)).alias("coauthor_density"), steady(F.when(several, F.col("shared")).otherwise(0.0)).alias("shared_coauthor_ratio"),
        steady(F.when(several, F.col("clique")).otherwise(0.0)).alias("clique_score"), steady(F.when(several, 1 - F.col("density")).otherwise(1.0)).alias("pair_novelty"),
    )


def author_pools(papers: DataFrame, paper: str = "paper", author: str = "author", shared: int = 3, least: int = 3) -> DataFrame:
    """Components of authors with at least `shared` joint papers."""
    strong = kept(pair_counts(author_pairs(papers, paper, author)).where(F.col("n") >= shared), "strong")
    found = components(strong)
    members = found.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least)
    ties = strong.join(found.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("ties"))
    rows = papers.where(F.col(author).isNotNull()).select(F.col(paper).alias("paper"), F.col(author).alias("node"))
    joint = rows.join(found, "node").select("component", "paper").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("papers"))
    out = members.join(ties, "component").join(joint, "component")
    return out.select(F.col("component").alias("pool"), "members", "papers", steady(F.col("ties") / (F.col("members") * (F.col("members") - 1) / 2)).alias("density")).orderBy(F.desc("papers"), "pool")


def citation_ring(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node, ring_score: mutual references over distinct references within the nodes. A self-citation is mutual."""
    known = nodes.select("node").distinct()
    inside = edges.select("src", "dst").distinct().join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").join(known.withColumnRenamed("node", "src"), "src", "left_semi")
    back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("mutual"))
    per = inside.join(back, ["src", "dst"], "left").groupBy(F.col("src").alias("node")).agg(steady(F.count("mutual") / F.count(F.lit(1))).alias("ring_score"))
    return known.join(per, "node", "left").select("node", F.coalesce("ring_score", F.lit(0.0)).alias("ring_score"))


def concentration(refs: DataFrame, key: str, journal: str) -> DataFrame:
    """Herfindahl index, distinct journals and highest share; blanks do not count."""
    counts = refs.where(F.trim(F.col(journal)) != "").groupBy(key, journal).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    return counts.withColumn("share", share).groupBy(key).agg(steady(F.sum(F.col("share") * F.col("share"))).alias("hhi"), F.count(F.lit(1)).alias("journals"), steady(F.max("share")).alias("max_share"))


def recency(refs: DataFrame, key: str, year: str, cited_year: str, window: int = 2) -> DataFrame:
    """Median age and share of ages up to the window; later, missing and zero years do not count."""
    rows = refs.where((F.col(cited_year) > 0) & (F.col(cited_year) <= F.col(year))).withColumn("age", F.col(year) - F.col(cited_year))
    return rows.groupBy(key).agg(steady(F.avg((F.col("age") <= window).cast("double"))).alias("recency"), steady(F.percentile("age", 0.5)).alias("median_age"))


def self_citation(refs: DataFrame, key: str, authors: str, cited_authors: str) -> DataFrame:
    """Share of references that have an author in common with the paper."""
    return refs.groupBy(key).agg(steady(F.avg(F.coalesce(F.arrays_overlap(authors, cited_authors), F.lit(False)).cast("double"))).alias("self_citation_rate"))


def paper_citations(refs: DataFrame, key: str, year: str, cited_year: str, journal: str, authors: str, cited_authors: str) -> DataFrame:
    """References, recency, median_age, hhi, journals, max_share, self_citation_rate of each paper; zeros where a part is missing."""
    out = refs.groupBy(key).agg(F.count(F.lit(1)).alias("references"))
    for part in (recency(refs, key, year, cited_year), concentration(refs, key, journal), self_citation(refs, key, authors, cited_authors)):
        out = out.join(part, key, "left")
    return out.na.fill(0)
