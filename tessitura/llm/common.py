"""Shared plumbing of the training-data operators: row numbers, tables written to the shared folder, shapes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, saved, shared_dir

__all__ = ["beside", "discard", "free_name", "numbered", "packed", "partitions_for", "saved", "shared_dir", "table", "unit"]

#: Logical operators under which a row number taken from a scan is the same in every execution.
_REPLAYABLE = re.compile(r"^[\s:+\-]*(Project|Filter|Relation|LocalRelation|LogicalRDD|Union|SubqueryAlias|Range|View)\b")


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores before it until no column of df has that name (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def packed(docs: DataFrame, keep: tuple[str, ...], text: str, **more: str) -> DataFrame:
    """(_row, _text, and columns under new names): the kept columns as one struct, so that no name of theirs can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(n) for n, c in more.items()])


def beside(found: DataFrame, *names: str) -> DataFrame:
    """found (_row, names and more) as _row's columns and then names, each with underscores before it while _row has such a column."""
    row = found.select("_row.*")
    return found.select("_row.*", *[F.col(n).alias(free_name(row, n)) for n in names])


def numbered(docs: DataFrame, rid: str = "_rid") -> DataFrame:
    """docs with a unique long column rid.

    The number comes from the row's place in its scan, so rows are told apart even if ids are null or repeat, and no
    shuffle is needed. Where docs is more than a scan with projections and filters, its rows may come in another order
    when a lost task is run again; it is then written to the shared folder first.
    """
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    if not all(_REPLAYABLE.match(line) for line in plan.splitlines() if line.strip()):
        docs = saved(docs)
    return docs.withColumn(rid, F.monotonically_increasing_id())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(*cols: Column | str, seed: int) -> Column:
    """A seeded hash of the columns as a double in [0, 1): the same for the same values in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
