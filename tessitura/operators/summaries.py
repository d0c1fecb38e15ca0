"""Summaries of results by condition: means, means of means, bootstrap deviations, joins and unions of result tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..session import ship


def mean_by(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means of the listed columns; rows with a null key are dropped, as data frames of the original analyses do."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(present).groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def by_condition(df: DataFrame, condition: list[str], values: list[str], resampled: bool = False, base: tuple[str, ...] = ("model_type", "contrast_type"), resample: tuple[str, ...] = ("batch_id", "batch_size", "boot_id")) -> DataFrame:
    """Means by model, contrast type and condition, and of each resample if there are any."""
    return mean_by(df, [*base, *condition, *(resample if resampled else ())], values)


def consonants_and_vowels(means: DataFrame, condition: list[str], values: list[str], contrast_type: str = "contrast_type", kinds: tuple[str, ...] = ("C", "V"), base: tuple[str, ...] = ("model_type",)) -> DataFrame:
    """The unweighted mean of the means of both contrast types."""
    return mean_by(means.where(F.col(contrast_type).isin(*kinds)), [*base, *condition], values)


def with_std(estimates: DataFrame, resampled: DataFrame, keys: list[str], value: str, ddof: int = 1) -> DataFrame:
    """estimates with std: the deviation of value over the resamples of the same keys; null for one resample (ddof 1)."""
    spread = F.stddev_samp if ddof else F.stddev_pop
    return estimates.join(resampled.groupBy(*keys).agg(spread(value).alias("std")), keys, "left")


def bootstrap(rows: DataFrame, n: int, key: Column, weight: Callable[[Column, Column], Column] | None = None, seed: int = 0) -> DataFrame:
    """rows with boot_id 0 to n - 1 and how often (times) the resample has the row; rows it lacks are left out.

    By default the times are Poisson(1) draws from a hash of seed, boot_id and key, so that each task draws its own
    rows' without knowing the others and a rerun draws the same. Aggregate with the times as weights.
    """
    boots = rows.sparkSession.range(n).withColumnRenamed("id", "boot_id")
    out = rows.crossJoin(F.broadcast(boots)) if n <= 10_000 else rows.withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if weight is None:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "boot_id", key), 11) / F.lit(float(1 << 53))
        steps, p, total = F.lit(0), 0.36787944117144233, 0.0
        for k in range(12):  # the distribution function of Poisson(1); more than 12 has a chance of 1e-11
            total += p
            steps = steps + (u >= total).cast("int")
            p /= k + 1
        return out.withColumn("times", steps).where("times > 0")
    return out.withColumn("times", weight(F.col("boot_id"), key)).where("times > 0")


#: Numbers of times that a task draws at once.
DRAWS = 1 << 20


def poisson_times(boots: np.ndarray, key: np.ndarray, seed: int = 0) -> np.ndarray:
    """Poisson(1) draws, a row for each key and a column for each resample, from a hash of seed, resample and key."""
    x = key.astype(np.uint64)[:, None] ^ (boots.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)]), u, "right")


def bootstrap_sums(rows: DataFrame, n: int, keys: list[str], value: str, key: Column, weight: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, seed: int = 0) -> DataFrame:
    """(keys, boot_id, times, total): of each resample 0 to n - 1, how many rows it draws and the sum of their values.

    A task draws how often each resample has each of its rows and adds up, so it sends a row for each of its keys and
    resamples and no row meets a resample. By default the times are :func:`poisson_times` of a hash of `key` (a whole number
    or any other value), so they don't depend on the partitioning; weight(resamples as a row, keys as a column) gives others.
    Null values are left out, and so are resamples without a row.
    """
    ship(rows.sparkSession)
    ident = key.cast("long") if weight else F.xxhash64(F.lit(seed), key)
    narrow = rows.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_g"), F.to_json(F.struct(*keys)).alias("_name"), F.col(value).cast("double").alias("_v"), ident.alias("_k"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boots = np.arange(n)
        for batch in batches:
            names = batch.column("_name").dictionary_encode()
            group, size = np.asarray(names.indices), len(names.dictionary)
            v, k = np.asarray(batch.column("_v")), np.asarray(batch.column("_k"))
            times, total = np.zeros((size, n), np.int64), np.zeros((size, n))
            order = np.argsort(group, kind="stable")
            step = max(1, DRAWS // n)
            for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                for at in (own[i : i + step] for i in range(0, len(own), step)):
                    drawn = weight(boots[None, :], k[at][:, None]) if weight else poisson_times(boots, k[at], seed)
                    times[group[at[0]]] += drawn.sum(0)
                    total[group[at[0]]] += v[at] @ drawn
            first = np.unique(group, return_index=True)[1]
            arrays = [pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * n, pa.int32()), pa.array(a.ravel())) for a in (times, total)]
            yield pa.RecordBatch.from_arrays([batch.column("_g").take(pa.array(first)), *arrays], ["_g", "times", "total"])

    kinds = StructType([narrow.schema["_g"], StructField("times", ArrayType(LongType())), StructField("total", ArrayType(DoubleType()))])
    each = narrow.mapInArrow(add, kinds).select("_g.*", F.posexplode(F.arrays_zip("times", "total")).alias("boot_id", "s"))
    return each.groupBy(*keys, F.col("boot_id").cast("long").alias("boot_id")).agg(F.sum("s.times").alias("times"), F.sum("s.total").alias("total")).where("times > 0")


def weighted_mean(value: str, weight: str = "times") -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def even_words(counts: DataFrame, keys: list[str], value: str = "nunique") -> DataFrame:
    """The mean over a word's two central phones."""
    return mean_by(counts, keys, [value])


def over_speakers(df: DataFrame, keys: list[str], value: str, by_spk: str = "by_spk", spk: str = "spk") -> DataFrame:
    """Rows by speaker averaged over speakers, the others untouched; without the speaker."""
    single = df.where(~F.col(by_spk)).select(*keys, by_spk, value)
    return df.where(F.col(by_spk)).groupBy(*keys, by_spk).agg(F.avg(value).alias(value)).unionByName(single)


def over_seeds(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(value), F.stddev_samp(value).alias("std"))


def two_level_mean(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """(mean, std): over outer of the means over inner of the means of each (outer, inner)."""
    each = df.groupBy(outer, inner).agg(F.avg(value).alias("v")).groupBy(outer).agg(F.avg("v").alias("v"))
    return each.agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def distinct_averages(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What averaging by keys that hold the value itself gives: its distinct rows. :func:`mean_by` gives the true mean."""
    return df.select(*keys, value).distinct()


def sign_fractions(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Fractions of values that are at least 0, over, under and equal to 0."""
    part = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*(keys or [])).agg(part(v >= 0).alias("not_negative"), part(v > 0).alias("positive"), part(v < 0).alias("negative"), part(v == 0).alias("zero"))


def distinct_count(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.countDistinct(value).alias("n"))


def component_counts(models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_components) from a row for each component."""
    return models.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_components"))


def units_with_durations(durations: DataFrame, ids: DataFrame, on: tuple[str, ...] = ("model", "unit", "train")) -> DataFrame:
    """Full outer join: units without a duration and durations without a unit stay."""
    return durations.join(ids, list(on), "full_outer")


def merge_all(frames: list[DataFrame], on: list[str], suffixes: list[str]) -> DataFrame:
    """Inner join of several tables on the same keys; their other columns get each table's suffix."""
    named = [f.withColumnsRenamed({c: c + s for c in f.columns if c not in on}) for f, s in zip(frames, suffixes, strict=True)]
    return reduce(lambda a, b: a.join(b, on), named)


def by_level(df: DataFrame, keys: list[str], level: str, levels: list[str], value: str) -> DataFrame:
    """One column of means for each level: what joining the table with itself level by level gives, in one aggregation.

    Keys without all the levels are left out, as an inner join would.
    """
    wide = df.groupBy(*keys).pivot(level, levels).agg(F.avg(value))
    return wide.dropna(subset=levels)


def lookup(rows: DataFrame, table: DataFrame, key: str, drop: tuple[str, ...] = ("size",)) -> DataFrame:
    """rows with the columns of table (unique by key) but those to drop; a key that table lacks is an error."""
    found = rows.join(table.drop(*drop).withColumn("_found", F.lit(True)), key, "left")
    ok = F.when(F.col("_found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("unknown id: "), F.col(key).cast("string"))).cast(rows.schema[key].dataType))
    return found.withColumn(key, ok).drop("_found")


def stacked(frames: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def bounds_as_rows(df: DataFrame, ids: list[str], bounds: list[str], kind: str = "count_type", value: str = "nunique") -> DataFrame:
    """The bound columns as rows (ids, kind, value)."""
    return df.unpivot(ids, bounds, kind, value)


def split_by(df: DataFrame, flag: str) -> dict[bool, DataFrame]:
    return {True: df.where(F.col(flag)), False: df.where(~F.col(flag))}


def grid(*axes: DataFrame) -> DataFrame:
    """Every combination of the axes' distinct rows; an axis has few (a parameter's values), but its table need not."""
    return reduce(lambda a, b: a.crossJoin(b), [a.distinct() for a in axes])
