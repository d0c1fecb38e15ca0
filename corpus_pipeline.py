"""Documents to a training corpus: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns documents again, the last one with its shard and slot beside them. A
stage's result is written as Parquet to the shared folder and read back as the next one's docs, so an executor lost in a
later stage costs no earlier one. Every stage works on all rows that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import free_name, numbered, saved, table
from tessitura.llm.decontaminate import decontaminate
from tessitura.llm.language import fit, identify
from tessitura.llm.mixing import mix
from tessitura.llm.neardup import near_duplicates
from tessitura.llm.sharding import shard_rows


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; null texts, those without letters and those whose margin is narrow go.

    Equal texts are judged alike. Where no row has a language to learn from, nothing can be told.
    """
    rejected = free_name(docs, "rejected")
    return identify(docs, fit(docs)).where(~F.col(rejected)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each class of equal and near-equal texts: one row of equal rows.

    Null ids come last, and rows of one id are told apart by their place. A null text is a class of its own.
    """
    rid = free_name(docs, "_rid")
    rows = numbered(docs, rid)
    first = near_duplicates(rows, rid=rid).where("first").select(F.col("_rid").alias(rid))
    return rows.join(first, rid, "left_semi").select(*docs.columns)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none, an empty benchmark leaves all rows."""
    items = free_name(docs, "items")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return found.where(F.size(items) == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, 0 to 3 times; a null source is a source of its own.

    Texts without words add nothing to a source's words; they are taken like its other documents.
    """
    return mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot: a uniform shuffle into 40 shards of equal row counts, whatever the rows hold."""
    return shard_rows(docs)


STAGES = [("language", known_language), ("near_duplicates", one_of_each), ("decontamination", clean_of_benchmarks), ("mixing", mixed), ("sharding", sharded)]

#: SQL can't express the classifier or the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
