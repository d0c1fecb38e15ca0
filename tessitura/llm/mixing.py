"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets: the words of all documents are shared out by weight; a source stops at ``epochs`` times its own words, and what
it can't take is reshared by weight among the rest until no source is above its cap. Sources sorted by cap over weight
fill up in that order, so the resharing ends where the common level stops short of the next source's cap.

Sampling: a source whose target is r times its words takes floor(r) whole copies of each document, and one copy more of
the documents first in a seeded hash order until the fraction's words are reached (to the nearest document). The cut in
that order is found from sums by hash range and then by hash inside one range for each source, so no source, however
large, is sorted or gathered in one task; a row then decides alone, from its hash and its source's cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import free_name, numbered, saved, table, unit

WEIGHTS = (5, 2, 1)
EPOCHS = 3
RANGES = 4096
#: A source's figures are repeated so often for joins, so that a source with a third of all rows is in as many tasks.
SALTS = 64


def n_words(text: Column | str) -> Column:
    """Runs of characters other than space and the five control characters 0x09 to 0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight, target double) from (source, source_size), one row each, null source allowed.

    Weights repeat over the sources by code point, null last. The window has no partition: its rows are sources.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(epochs)
    fill = W.orderBy(F.col("_level"), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    reached = (
        weighed.withColumn("_cap", cap)
        .withColumn("_level", F.col("_cap") / F.col("weight"))
        .withColumn("_common", level)
        # The first source that the common level doesn't fill, and all after it, share that level.
        .withColumn("_stop", F.min(F.when(F.col("_common") <= F.col("_level"), F.struct("_level", "_common"))).over(W.partitionBy())["_common"])
    )
    return reached.select("source", "source_size", "weight", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_stop") * F.col("weight"), F.col("_cap").cast("double"))).alias("target"))


def _by_source(rows: DataFrame, figures: DataFrame, salt: Column) -> DataFrame:
    """rows joined with figures, which has one row for each source (under the name _s): dealt by source and salt."""
    many = figures.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_salted") == F.col("_salt"))
    return rows.withColumn("_salted", F.pmod(salt, F.lit(SALTS)).cast("int")).join(many, same).drop("_salt", "_salted")


def plan(keys: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """(source, source_size, target, copies, cut, share) from keys (source, size, u); one row for each source.

    A row takes ``copies`` whole copies, one more if u < cut, and at u = cut with probability share (rows that are
    equal in all that u is made of; else share is 0 or 1).
    """
    ranged = keys.withColumn("_range", F.floor(F.col("u") * RANGES).cast("int"))
    by_range = ranged.groupBy("source", "_range").agg(F.sum("size").alias("words"))
    by_source = targets(by_range.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = by_source.withColumn("copies", F.floor(rate + 1e-12).cast("int")).withColumn("want", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")))
    run = W.partitionBy("source").orderBy("_range")
    held = by_range.withColumn("_sum", F.sum("words").over(run)).withColumn("_before", F.col("_sum") - F.col("words"))
    same = F.col("g.source").eqNullSafe(F.col("h.source"))
    edge = (
        goals.alias("g").join(held.alias("h"), same & (F.col("h._sum") > F.col("g.want")) & (F.col("h._before") <= F.col("g.want")))
        .select(F.col("g.source").alias("source"), F.col("h._range").alias("_range"), (F.col("g.want") - F.col("h._before")).alias("left"))
    )
    # Rows in the range that holds the cut: a RANGES-th of the source.
    inside = _by_source(ranged, edge.select(F.col("source").alias("_s"), F.col("_range").alias("_edge"), "left"), F.col("_range")).where("_range = _edge").select("source", "u", "size", "left")
    steps = inside.groupBy("source", "u", "left").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    run = W.partitionBy("source").orderBy("u")
    steps = steps.withColumn("_sum", F.sum("words").over(run)).withColumn("_before", F.col("_sum") - F.col("words")).where((F.col("_sum") > F.col("left")) & (F.col("_before") <= F.col("left")))
    part = F.round((F.col("left") - F.col("_before")) / F.col("words") * F.col("rows")) / F.col("rows")
    cuts = steps.select("source", F.col("u").alias("cut"), part.alias("share"))
    return goals.alias("g").join(cuts.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").select("g.source", "source_size", "target", "copies", F.coalesce("cut", F.when(F.col("want") > 0.5, 2.0).otherwise(-1.0)).alias("cut"), F.coalesce("share", F.lit(0.0)).alias("share"))


def _key(seed: int) -> Column:
    return unit(F.col("doc_id"), F.col("text"), seed=seed)


def _keys(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", n_words("text").alias("size"), _key(seed).alias("u"), F.col("_rid"))


def _copies(rows: DataFrame, by_source: DataFrame, seed: int) -> DataFrame:
    """rows (source, u, _rid and more) with their source's figures and `copies`, the copies that the mix takes."""
    figures = by_source.select(F.col("source").alias("_s"), "source_size", "target", F.col("copies").alias("_whole"), "cut", "share")
    more = (F.col("u") < F.col("cut")) | ((F.col("u") == F.col("cut")) & (unit(F.col("_rid"), seed=seed + 1) < F.col("share")))
    return _by_source(rows, figures, F.xxhash64("_rid")).withColumn("copies", F.col("_whole") + more.cast("int")).drop("_s", "_whole", "cut", "share")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 29) -> DataFrame:
    """(doc_id, size, source_size, target, copies) for each row of docs.

    Null and empty texts have size 0 and take part with 0 words; a null source is a source of its own; equal rows are
    taken alike but at a source's cut, where a seeded share of them is. No rows give no rows.
    """
    keys = saved(_keys(numbered(docs.select("doc_id", "text", "source")), seed))
    return _copies(keys, plan(keys, weights, epochs), seed).select("doc_id", "size", "source_size", F.col("target"), "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 29) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, whole, with the columns of docs."""
    rid = free_name(docs, "_rid")
    docs = numbered(docs, rid)
    names = ["doc_id", "text", "source"]
    keys = saved(docs.select(*names, F.col(rid).alias("_rid")).select("source", n_words("text").alias("size"), _key(seed).alias("u"), "_rid"))
    whole = docs.select(F.struct(*[c for c in docs.columns if c != rid]).alias("_row"), "source", _key(seed).alias("u"), F.col(rid).alias("_rid"))
    taken = _copies(whole, plan(keys, weights, epochs), seed).where("copies > 0")
    return taken.select("_row", F.explode(F.expr("sequence(1, copies)")).alias("_copy")).select("_row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """One row for each document, by :func:`mix_plan` with its defaults. Reruns agree while the table's files stay as they are."""
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
