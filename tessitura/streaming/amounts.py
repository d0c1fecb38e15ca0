"""Structured-Streaming forms of the additive corpus summaries (an extension: the batch operators define the results)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def speaker_amounts(utts: DataFrame, spk: str = "spk", duration: str = "duration") -> DataFrame:
    """Running (spk, amount, n_utts); write it in complete or update mode."""
    return utts.groupBy(spk).agg(F.sum(duration).alias("amount"), F.count(F.lit(1)).alias("n_utts"))


def windowed_amounts(utts: DataFrame, ts: str = "ts", width: str = "1 hour", lateness: str = "2 hours", spk: str = "spk", duration: str = "duration") -> DataFrame:
    """(start, spk, amount) by tumbling window; rows later than `lateness` behind the newest are left out."""
    timed = utts.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return timed.groupBy(F.window(ts, width).alias("w"), spk).agg(F.sum(duration).alias("amount")).select(F.col("w.start").alias("start"), spk, "amount")
