"""A training-data pipeline over `documents`: STAGES in order, each written as Parquet and read again as the next one's docs.

Rejected or repeated documents go; texts lose failing and repeated lines and personal data; the last stage packs what is
left into sequences of at most 2048 tokens. SQL cannot express the personal data stage's trained field, nor the packing
plan, so ORACLE_SQL is None and tests compare the stages with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import line_dedup, minhash_dedup, packing, pii, quality_rules
from corpuslens.llm._io import SPACES, stored, table


def clean_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: failing lines go, rejected documents go."""
    return quality_rules.clean(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines go, and documents that had words and have none left."""
    out = line_dedup.without_repeats(docs)
    blank = F.btrim(F.coalesce("cleaned", F.lit("")), F.lit(SPACES)) == ""
    out = out.where(~(blank & (F.col("n_removed") > 0)))
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("cleaned")}
    return out.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five words and a similarity of 0.8: the first document of each group stays.

    Rows are named by id and text, so a unique text stays where another row has its id, and of rows alike in both one stays,
    texts without words included; rows with null id stay."""
    found = minhash_dedup.near_duplicates(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"))
    named_apart = found.agg(F.bool_and("first").alias("_first"), F.count(F.lit(1)).alias("_n")).where("not _first or _n > 1")
    named = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_tag"))
    rows = named.join(named_apart.hint("shuffle_hash"), ["_id", "_tag"], "left")
    once = rows.where("_first").groupBy("_id", "_tag").agg(F.first("doc").alias("doc"))
    return rows.where("_first is null").select("doc.*").unionByName(once.select("doc.*"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span becomes its kind in brackets."""
    return pii.redacted(docs, pii.learn(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: a row for each piece."""
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", clean_quality),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
