"""Corpus operators: speaker amounts, matching, trimming, balanced splits, duration slices, semi and anti filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import saved
from ..sources.readers import Corpus, checked
from . import scans
from .matching import match_speakers


def speaker_amount(utts: DataFrame, spk: str = "spk", duration: str = "duration") -> DataFrame:
    """(spk, amount): seconds of each speaker."""
    return utts.groupBy(spk).agg(F.sum(duration).alias("amount"))


def speaker_stats(utts: DataFrame, spk: str = "spk", duration: str = "duration") -> DataFrame:
    return utts.groupBy(spk).agg(F.sum(duration).alias("amount"), F.count(F.lit(1)).alias("n_utts"), F.min(duration).alias("shortest"))


def least_amount(utts: DataFrame, spk: str = "spk", duration: str = "duration") -> DataFrame:
    """(least): the amount of the speaker with the least."""
    return speaker_amount(utts, spk, duration).agg(F.min("amount").alias("least"))


def recording_amount(utts: DataFrame) -> DataFrame:
    return utts.groupBy("spk", "rec").agg(F.sum("duration").alias("amount"))


def amounts_by_group(amounts: DataFrame, group: str = "gender") -> DataFrame:
    """(group, n, amount) totals."""
    return amounts.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


def ranked_by_gender(amounts: DataFrame, genders: DataFrame, spk: str = "spk", gender: str = "gender") -> DataFrame:
    """amounts with gender and rank: 1 is the longest of its gender, ties by speaker. A speaker without gender is an error."""
    joined = amounts.join(genders.select(spk, gender), spk, "left")
    joined = checked(joined, F.col(gender).isNotNull(), "a speaker has no gender")
    return scans.ranked(joined, [gender], ["-amount", spk]).withColumn("rank", F.col("rank").cast("int"))


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of the two has; side is left or right."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def aligned(utts: DataFrame, alignment: DataFrame, key: str = "utt") -> tuple[DataFrame, DataFrame]:
    """(utterances that the alignment has, those it lacks)."""
    known = alignment.select(key).distinct()
    return utts.join(known, key, "left_semi"), utts.join(known, key, "left_anti")


def unknown(alignment: DataFrame, utts: DataFrame, key: str = "utt") -> DataFrame:
    """Keys of the alignment that the corpus lacks: a caller that finds any has mixed up its files."""
    return alignment.select(key).distinct().join(utts, key, "left_anti")


def aligned_subcorpus(corpus: Corpus, alignment: DataFrame, name: str) -> Corpus:
    """The corpus cut to the utterances of an alignment; an alignment of unknown utterances is an error."""
    stray = unknown(alignment, corpus.segments).limit(1).collect()
    if stray:
        raise ValueError(f"the alignment has an utterance that the corpus lacks: {stray[0].utt}")
    return corpus.subcorpus(alignment.select("utt").distinct(), name)


def speakers_subcorpus(corpus: Corpus, speakers: DataFrame, name: str) -> Corpus:
    return corpus.subcorpus(corpus.utt2spk.join(speakers.select("spk"), "spk", "left_semi"), name)


def without_phones(lexicon: DataFrame, phones: list[str], phone: str = "phone", word: str = "word") -> DataFrame:
    """The lexicon without words that any of the phones stands in."""
    return lexicon.join(lexicon.where(F.col(phone).isin(phones)).select(word).distinct(), word, "left_anti")


def merged_recordings(utts: DataFrame) -> DataFrame:
    """Each speaker's recordings as one, end to end in order of name: rec becomes the speaker, times move."""
    lengths = utts.groupBy("spk", "rec").agg(F.max("stop").alias("length"))
    before = F.coalesce(F.sum("length").over(W.partitionBy("spk").orderBy("rec").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    placed = lengths.withColumn("offset", before).drop("length")
    return utts.join(placed, ["spk", "rec"]).select("utt", "spk", F.col("spk").alias("rec"), (F.col("start") + F.col("offset")).alias("start"), (F.col("stop") + F.col("offset")).alias("stop"))


def histogram(amounts: DataFrame, groups: list[str], value: str, bins: int = 5) -> DataFrame:
    """(groups, bin, low, high, n): equal-width bins from each group's least to its greatest value, empty ones too.

    The greatest value is in the last bin; a group of one value has all in the first, with bins around it of width 1.
    """
    ends = amounts.groupBy(*groups).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    ends = ends.select(*groups, F.when(F.col("_lo") < F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") - 0.5).alias("_lo"), F.when(F.col("_lo") < F.col("_hi"), F.col("_hi")).otherwise(F.col("_hi") + 0.5).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    counted = amounts.join(ends, groups).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width)).cast("int")).groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select(*groups, "_lo", width.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counted, [*groups, "bin"], "left").select(*groups, "bin", (F.col("_lo") + F.col("_w") * F.col("bin")).alias("low"), (F.col("_lo") + F.col("_w") * (F.col("bin") + 1)).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# Slices of each speaker's speech --------------------------------------------------------------------------------------


#: What rounding adds to a sum of a speaker's durations, as a share of it, at most.
EDGE = 1e-11


def running(utts: DataFrame, spk: str, order: list[str], duration: str = "duration") -> DataFrame:
    """utts with cum, the running sum of each speaker's durations, this row included, and prev, the sum before it."""
    return scans.running(utts, [spk], order, duration)


def subset_slices(utts: DataFrame, n: int, spk: str = "spk", utt: str = "utt", order: tuple[str, ...] = ("start", "utt"), start: str = "start", stop: str = "stop", duration: str = "duration") -> DataFrame:
    """(spk, utt, subset_id, start, stop): n slices of equal duration of each speaker's utterances end to end.

    Slice j is [j, j + 1) n-ths of the speaker's total. An utterance over a slice's edge is cut there, so it is in two.
    An utterance is compared with the slices that it meets only: its first and last slice follow from its sums. Sums of
    doubles are off by their rounding, so ends within EDGE of an edge, as a share of the total, are on it.
    """
    rows = running(utts, spk, list(order), duration)
    rows = rows.join(rows.groupBy(spk).agg(F.max("cum").alias("total")), spk)
    # A slice's edges are floats: one more on each side is tried, and the exact test below decides.
    at = lambda c: F.floor(F.col(c) / F.col("total") * n)
    near = F.sequence(F.greatest(F.lit(0), at("prev") - 1).cast("int"), F.least(F.lit(n - 1), at("cum") + 1).cast("int"))
    cut = rows.where("total > 0").withColumn("j", F.explode(near)).withColumn("low", F.col("j") * F.col("total") / n).withColumn("high", (F.col("j") + 1) * F.col("total") / n)
    edge = F.col("total") * EDGE
    cut = cut.where((F.col("cum") - F.col("low") > edge) & (F.col("high") - F.col("prev") > edge))
    front = F.col(stop) - (F.col("cum") - F.col("low"))
    back = F.col(stop) - (F.col("cum") - F.col("high"))
    # Sums only grow and a row's prev is the cum before it, so one row of a slice holds its low edge, the first, and one its
    # high edge, the last; only the last slice may end in rows of no duration behind it.
    first = F.col("prev") <= F.col("low")
    last = F.col("cum") >= F.col("high")
    return cut.select(spk, utt, F.col("j").alias("subset_id"), F.when(first, front).otherwise(F.col(start)).alias("start"), F.when(last, back).otherwise(F.col(stop)).alias("stop"))


# Matching and trimming ------------------------------------------------------------------------------------------------


def trim(utts: DataFrame, targets: DataFrame, spk: str = "spk", rec: str = "rec", utt: str = "utt", start: str = "start", duration: str = "duration") -> DataFrame:
    """utts without those removed to bring each speaker of targets (spk, target) down to its target.

    Utterances go from recordings' ends, the shortest recording first. The one that would pass the target goes only if
    that leaves the speaker nearer to it. Speakers without a target stay whole. Recordings are added up first, so a speaker's
    utterances never meet, and a long recording's are added up in ranges.
    """
    recs = utts.groupBy(spk, rec).agg(F.sum(duration).alias("_rec"))
    recs = scans.running(recs, [spk], ["_rec", rec], "_rec", "_done", "_ahead")
    recs = recs.join(recs.groupBy(spk).agg(F.max("_done").alias("_all")), spk).join(targets.select(spk, "target"), spk, "left").select(spk, rec, "_ahead", "_all", "target")
    run = scans.running(utts, [spk, rec], [f"-{start}", utt], duration, "_cum", "_prev").join(recs, [spk, rec])
    left, left_with = F.col("_all") - (F.col("_ahead") + F.col("_cum")), F.col("_all") - (F.col("_ahead") + F.col("_prev"))
    # Sums only grow, so rows before the first that does not pass all pass; that one is borderline.
    passes = left > F.col("target")
    nearest = F.abs(F.col("target") - left_with) > F.abs(F.col("target") - left)
    gone = F.coalesce(passes | ((left_with > F.col("target")) & nearest), F.lit(False))
    return run.where(~gone).drop("target", "_all", "_ahead", "_cum", "_prev")


def matching_corpora(big: DataFrame, small: DataFrame, matches: DataFrame, threshold: float = 0.05, trimming: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both corpora's utterances cut to the matched speakers; of a pair that differs too much the longer is trimmed."""
    rel = F.abs(2 * (F.col("big_amount") - F.col("small_amount")) / (F.col("big_amount") + F.col("small_amount")))
    out = []
    for utts, own in ((big, "big"), (small, "small")):
        kept = utts.join(matches.select(F.col(f"{own}_spk").alias("spk")), "spk", "left_semi")
        if trimming:
            goal = F.least("big_amount", "small_amount")
            over = matches.where((rel > threshold) & (F.col(f"{own}_amount") > goal)).select(F.col(f"{own}_spk").alias("spk"), goal.alias("target"))
            kept = trim(kept, over)
        out.append(kept)
    return out[0], out[1]


def balanced_split(speakers: DataFrame, gender: str = "gender", spk: str = "spk", amount: str = "amount", group_size: int = 3, train: int = 2, order: Column | None = None, seed: int = 0) -> DataFrame:
    """speakers with part (train or test): in each consecutive group by falling amount, `train` of group_size go to train.

    order: what picks them within a group, a seeded hash if None. Of the remaining speakers, fewer than a group, the
    least number whose share is not under train / group_size go to train.
    """
    order = F.xxhash64(F.lit(seed), spk) if order is None else order
    ranked = scans.ranked(speakers, [gender], [f"-{amount}", spk], "_rn").withColumn("_group", F.floor((F.col("_rn") - 1) / group_size))
    size = F.count(F.lit(1)).over(W.partitionBy(gender, "_group"))
    picked = F.row_number().over(W.partitionBy(gender, "_group").orderBy(order, spk)) <= F.ceil(size * train / F.lit(float(group_size)) - 1e-9)
    return ranked.withColumn("part", F.when(picked, "train").otherwise("test")).drop("_rn", "_group")


def twin_split(matches: DataFrame, **options) -> DataFrame:
    """matches (gender, big_spk, big_amount, small_spk, ...) with part: the same places of both corpora's lists."""
    return balanced_split(matches, spk="big_spk", amount="big_amount", **options)


def threshold_cells(items: DataFrame, cell: list[str], lower: int = 1, upper: int | None = None, order: Column | None = None, seed: int = 0) -> DataFrame:
    """items of cells with at least `lower` rows, `upper` of each at most: the first by order, a seeded random one if None.

    One pass over each cell: its size and its ranks are windows over the same partitioning.
    """
    ranked = items.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*cell)))
    ranked = ranked.where(F.col("_n") >= lower)
    if upper is not None:
        ranked = ranked.withColumn("_rank", F.row_number().over(W.partitionBy(*cell).orderBy(F.rand(seed) if order is None else order))).where(F.col("_rank") <= upper).drop("_rank")
    return ranked.drop("_n")


def lowest(rows: DataFrame, by: str | Column, n: int = 100_000) -> DataFrame:
    """The n rows with the lowest value: each task keeps n at most, no full sort."""
    return rows.orderBy(by).limit(n)


def most_common(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value)


def nearest(left: DataFrame, right: DataFrame, on: str, value: str, key: str) -> DataFrame:
    """For each (on, key, value) of left the key of right in the same `on` with the nearest value, ties by key.

    Both sides' different values are put in one order, in ranges; a value's nearest ones are the last of right before it and
    the first after it. Values without a difference (null, nan, infinite), and those that are so far from right's that
    several are equally far in doubles, meet all of right's values. A null difference is farther than any other, nan next.
    """
    v, nv, there = F.col(value), F.col("_v"), lambda c: F.abs(c) < float("inf")
    asked = left.select(on, F.col(value).cast("double").alias(value)).where(F.col(on).isNotNull()).distinct()
    right = right.where(F.col(on).isNotNull()).groupBy(on, F.col(value).cast("double").alias("_v")).agg(F.min(key).alias("_k"))
    asked, right = saved(asked), saved(right)
    # Each value of right with the one before and the one after it.
    known = scans.neighbours(right.where(there(nv)), [on], ["_v"], {"_before": "_v"}, {"_after": "_v"})
    low, high = F.struct("_v", "_k", F.col("_before").alias("_next")), F.struct((-nv).alias("_v"), "_k", F.col("_after").alias("_next"))
    rows = asked.where(there(v)).select(on, F.col(value).alias("_v"), F.lit(1).alias("_asks"), F.lit(None).cast(known.select(low.alias("_s")).schema["_s"].dataType).alias("_low"))
    rows = rows.withColumn("_high", F.col("_low"))
    both = saved(known.select(on, "_v", F.lit(0).alias("_asks"), low.alias("_low"), high.alias("_high")).unionByName(rows))
    up = scans.running_max(both, [on], ["_v", "_asks"], "_low", "_under", "_p").drop("_p", "_low")
    found = scans.running_max(saved(up), [on], ["-_v", "_asks"], "_high", "_over", "_p").where("_asks = 1")
    under, over = F.abs(nv - F.col("_under._v")), F.abs(nv + F.col("_over._v"))
    least = F.least(under, over)
    alike = (F.abs(nv - F.col("_under._next")) == least) | (F.abs(nv - F.col("_over._next")) == least)
    near = F.when(under < over, F.col("_under._k")).when(over < under, F.col("_over._k")).otherwise(F.least("_under._k", "_over._k"))
    best = F.when(there(least) & ~F.coalesce(alike, F.lit(False)), F.struct(F.lit(False).alias("none"), least.alias("far"), near.alias("near")))
    found = saved(found.select(on, nv.alias(value), best.alias("_best")))
    rest = found.where("_best is null").select(on, value).unionByName(asked.where(~F.coalesce(there(v), F.lit(False))))
    far = F.abs(v - nv)
    met = rest.join(right, on).groupBy(on, value).agg(F.min(F.struct(far.isNull().alias("none"), far.alias("far"), F.col("_k").alias("near"))).alias("_best"))
    each = found.where("_best is not null").unionByName(met).withColumnsRenamed({on: "_on", value: "_of"})
    same = (F.col(on) == F.col("_on")) & F.col(value).cast("double").eqNullSafe(F.col("_of"))
    return left.select(on, key, value).join(each, same).groupBy(on, key).agg(F.min("_best").getField("near").alias("near"))
