"""The corpus pipeline: rules, near duplicates, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes below the
shared folder and rereads as the next stage's docs. All but the last return the columns of the
documents table; the last describes each document of the token files, read back from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.llm.common import Scratch, read, text_of
from tabloom.llm.decontam import decontaminate
from tabloom.llm.jaccard import jaccard_rows, row_key
from tabloom.llm.mixing import mix, taken_rows
from tabloom.llm.rules import drop_rejected
from tabloom.llm.tokens import tokenized


#: Documents are near duplicates if the Jaccard similarity of their sets of five words in a row is 0.8 or more.
NEAR_WORDS = 5
NEAR_PERCENT = 80


#: Row keys up to which they are broadcast, 8 bytes each; beyond, rows are shuffled by their keys.
FEW_KEYS = 1_000_000


def small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS else keys


def wordless(text: Column) -> Column:
    return ~text_of(text).rlike(r"[^\x20\x09-\x0D]")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a base rule or a certified cutoff go."""
    return drop_rejected(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the smallest doc_id stays, of several the one with the smallest row key.

    Rows are told apart by id and text, so of an id with several texts each text is judged by itself; rows that
    repeat wholly are one. Rows without shingles and rows without an id cannot stand for a group or be named by one and stay.
    """
    scratch = Scratch(spark)
    found = scratch.keep(jaccard_rows(docs, NEAR_WORDS, NEAR_PERCENT), "near-duplicate-rows")
    judged = found.where("doc_id IS NOT NULL AND n_shingles > 0")
    gone = judged.where("row_key <> keeper").select(F.col("row_key").alias("_key")).distinct()
    again = judged.where("row_key = keeper").groupBy(F.col("row_key").alias("_key")).count().where("count > 1").select("_key")
    rows = docs.select(F.struct("*").alias("_row"), row_key().alias("_key"), (F.col("doc_id").isNull() | wordless(F.col("text"))).alias("_free"))
    left = rows.join(small(gone), (rows["_key"] == gone["_key"]) & ~rows["_free"], "left_anti")
    repeated = left.join(small(again), "_key", "left_semi").where(~F.col("_free")).dropDuplicates(["_key"])
    single = left.join(small(again), (left["_key"] == again["_key"]) & ~left["_free"], "left_anti")
    return single.select("_row.*").unionByName(repeated.select("_row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in benchmark windows go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and pass of the mix; see mixing.taken_rows."""
    documents, _ = mix(docs)
    return taken_rows(docs, documents)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read back from the token shards."""
    import public_tokenizers

    return tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]

#: Certified cutoffs, hashed schedules and token ids are beyond SQL; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for name, stage in STAGES:
        kept = scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.drop(docs)
        docs = kept
    return docs
