"""Search results in the order in which they arrived, with caps for each query and for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import WORK
from .storage import discard, kept

#: A response's place in the landed folder: <query>/<page>.json with a list of works under `results`.
_PLACE = r"/(\d+)/(\d+)\.json$"


def responses(spark: SparkSession, path: str) -> DataFrame:
    """query, page, place, work: landed responses, one file a page. A file that does not parse ends its query's pages there."""
    pages = spark.read.text(f"{path}/*/*.json", wholetext=True).withColumn("_file", F.input_file_name())
    number = lambda k: F.regexp_extract("_file", _PLACE, k).cast("int")
    pages = pages.select(number(1).alias("query"), number(2).alias("page"), F.from_json("value", f"results array<struct<{_fields()}>>").alias("_r"))
    bad = pages.where("_r.results is null").groupBy("query").agg(F.min("page").alias("_bad"))
    pages = pages.join(F.broadcast(bad), "query", "left").where(F.col("_bad").isNull() | (F.col("page") < F.col("_bad")))  # a row for each query
    return pages.select("query", "page", F.posexplode("_r.results").alias("place", "work"))


def _fields() -> str:
    """The fields of a work as those of a struct."""
    depth, out, start = 0, [], 0
    for k, c in enumerate(WORK + ","):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(WORK[start:k].strip().replace(" ", ":", 1))
            start = k + 1
    return ",".join(out)


def arrived(hits: DataFrame, key: str, keep: Column, most: int) -> DataFrame:
    """Of hits (query, page, place, key) in the order of arrival the first `most` to be kept; `keep` says which may be.

    Of equal keys the first hit alone counts, kept or not: one without an abstract blocks later copies. Places are counted by page,
    pages by their totals, so no task sees more than a page or the list of pages."""
    order = F.struct("query", "page", "place")
    first = hits.join(hits.groupBy(key).agg(F.min(order).alias("_first")), key).where(order == F.col("_first")).drop("_first").where(keep)
    return _upto(first, most)


def _upto(rows: DataFrame, most: int) -> DataFrame:
    pages = rows.groupBy("query", "page").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("query", "page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(pages.select("query", "page", before.alias("_before")).where(F.col("_before") < most), ["query", "page"])
    rank = F.row_number().over(Window.partitionBy("query", "page").orderBy("place")) + F.col("_before")
    return rows.withColumn("arrival", rank.cast("long")).where(F.col("arrival") <= most).drop("_before")


def searched(hits: DataFrame, key: str, keep: Column, per_query: int, queries: list[int]) -> DataFrame:
    """Of each of the queries, in this order, the first `per_query` new hits to be kept.

    A query ends at its cap, and what it did not look at any more is new to later queries; so they are taken one after another,
    each against the keys that earlier ones looked at."""
    seen, parts = None, []
    for k, query in enumerate(queries):
        mine = hits.where(F.col("query") == query)
        if seen is not None:
            mine = mine.join(seen, key, "left_anti")
        place = F.struct("page", "place")
        new = kept(mine.join(mine.groupBy(key).agg(F.min(place).alias("_first")), key).where(place == F.col("_first")).drop("_first"), "new")
        taken = kept(_upto(new.where(keep), per_query).withColumn("query_no", F.lit(k)), "taken")
        end = taken.where(F.col("arrival") == per_query).agg(F.max(place).alias("_end"))  # one row; null if the query did not reach its cap
        looked = kept(new.crossJoin(F.broadcast(end)).where(F.col("_end").isNull() | (place <= F.col("_end"))).select(key), "seen")
        discard(new)
        parts.append(taken)
        seen = looked if seen is None else seen.union(looked)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
