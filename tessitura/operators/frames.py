"""Frames and intervals: point-in-interval joins, rebasing, re-keying, chunking, shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import between
from ..session import saved
from ..sources.readers import checked
from . import scans


def frames_in_segments(frames: DataFrame, segments: DataFrame, rec: str = "rec", t: str = "t", start: str = "start", stop: str = "stop", inclusive: str = "both", width: float | None = None) -> DataFrame:
    """frames joined with the segments of the same recording that they lie in; both ends count by default.

    The segments' ends cut a recording into places: each end, and what is between two. A sweep along the recording hands
    each frame the segments of its place, so a frame never meets a segment that it is not in, however long the recording is
    and however the segments overlap, and a long recording is swept in ranges. width: to deal both sides into buckets of so
    many seconds instead, in one exchange, where a frame meets the segments of its bucket. Null recordings and times, and
    segments that end before they start, meet nothing.
    """
    if width is None:
        return _swept(frames, segments, rec, t, start, stop, inclusive)
    inside = between(F.col(t), F.col(start), F.col(stop), inclusive)
    at = lambda c: F.floor(F.col(c) / width)
    dealt = segments.where(F.col(start) <= F.col(stop)).withColumn("_bucket", F.explode(F.sequence(at(start), at(stop))))
    return frames.withColumn("_bucket", at(t)).join(dealt, [rec, "_bucket"]).where(inside).drop("_bucket")


def _swept(frames: DataFrame, segments: DataFrame, rec: str, t: str, start: str, stop: str, inclusive: str) -> DataFrame:
    own = [c for c in segments.columns if c != rec]
    segments = segments.where(F.col(rec).isNotNull() & (F.col(start) <= F.col(stop)))
    ends = segments.select(rec, F.col(start).alias("_t")).union(segments.select(rec, stop)).distinct()
    places = saved(scans.ranked(saved(ends), [rec], ["_t"], "_place"))
    at = lambda c, name: places.select(rec, F.col("_t").alias(c), F.col("_place").alias(name))
    # Place 2 k is the k-th end itself, place 2 k + 1 what is between it and the next.
    first = 2 * F.col("_lo") + (0 if inclusive in ("both", "left") else 1)
    last = 2 * F.col("_hi") - (0 if inclusive in ("both", "right") else 1)
    coded = segments.join(at(start, "_lo"), [rec, start]).join(at(stop, "_hi"), [rec, stop]).select(rec, F.struct(*own).alias("_s"), first.alias("_from"), last.alias("_upto"))
    held = coded.where("_from <= _upto").select(rec, "_s", F.explode(F.sequence("_from", "_upto")).alias("_code")).groupBy(rec, "_code").agg(F.collect_list("_s").alias("_in"))
    side = lambda odd, name: held.where(F.col("_code") % 2 == odd).select(rec, F.expr("_code div 2").alias("_place"), F.col("_in").alias(name))
    marks = places.join(side(0, "_on"), [rec, "_place"], "left").join(side(1, "_after"), [rec, "_place"], "left")
    marks = saved(marks.select(rec, "_t", F.struct("_t", "_on", "_after").alias("_m")))
    row = F.struct(*[c for c in frames.columns if c != rec])
    rows = frames.where(F.col(rec).isNotNull() & F.col(t).isNotNull()).select(rec, F.col(t).cast(marks.schema["_t"].dataType).alias("_t"), row.alias("_f"))
    both = marks.withColumn("_kind", F.lit(0)).unionByName(rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    parts, cut = scans.ranged(both, [rec], ["_t"])
    mark = F.last("_m", ignorenulls=True).over(W.partitionBy(rec, "_range").orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, 0))
    found = parts.withColumn("_mark", mark)
    if cut:
        before = F.last("_last", ignorenulls=True).over(W.partitionBy(rec).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
        ranges = parts.groupBy(rec, "_range").agg(F.max_by("_m", F.when(F.col("_m").isNotNull(), F.col("_t"))).alias("_last")).withColumn("_before", before).drop("_last")
        found = found.join(ranges, [rec, "_range"]).withColumn("_mark", F.coalesce("_mark", "_before"))
    here = F.when(F.col("_mark._t") == F.col("_t"), F.col("_mark._on")).otherwise(F.col("_mark._after"))
    return found.where("_kind = 1").select(rec, "_f", F.explode(here).alias("_s")).select(rec, "_f.*", "_s.*")


def utterance_frames(frames: DataFrame, segments: DataFrame, **options) -> DataFrame:
    """(item = utt, frame, t from the utterance's start, x): recordings' features cut into utterances."""
    cut = frames_in_segments(frames.withColumnRenamed("item", "rec"), segments.select("utt", "rec", "start", "stop"), **options)
    frame = F.row_number().over(W.partitionBy("utt").orderBy("t", "frame")) - 1
    return cut.select(F.col("utt").alias("item"), frame.alias("frame"), (F.col("t") - F.col("start")).alias("t"), "x")


def rebase(frames: DataFrame, segments: DataFrame, utt: str = "utt", t: str = "t", start: str = "start", stop: str = "stop") -> DataFrame:
    """frames with times from their utterance's start; a frame outside its utterance is an error."""
    joined = frames.join(segments.select(utt, start, stop), utt)
    joined = checked(joined, between(F.col(t), F.col(start), F.col(stop)), "a frame lies outside its utterance")
    return joined.withColumn(t, F.col(t) - F.col(start)).drop(start, stop)


def voiced_matrix(frames: DataFrame, segments: DataFrame, seed: int | None = 0) -> DataFrame:
    """(x) of the frames in speech, in random order unless seed is None."""
    rows = frames_in_segments(frames, segments).select("x")
    return rows if seed is None else shuffled(rows, seed)


def shuffled(rows: DataFrame, seed: int = 0) -> DataFrame:
    return rows.orderBy(F.rand(seed))


def numbered_rows(rows: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """rows with their number in the order, from 0: counted in ranges, so no task holds all rows."""
    one = scans.ranked(rows.withColumn("_all", F.lit(0)), ["_all"], order, name)
    return one.withColumn(name, F.col(name) - 1).drop("_all")


def chunked(rows: DataFrame, size: int, order: list[str]) -> DataFrame:
    """rows with chunk: consecutive runs of `size` rows in the order, numbered in ranges."""
    return numbered_rows(rows, order, "_rn").withColumn("chunk", F.floor(F.col("_rn") / size)).drop("_rn")


def one_speaker_each(utts: DataFrame) -> DataFrame:
    """(rec, single): is the recording one speaker's?"""
    return utts.groupBy("rec").agg((F.countDistinct("spk") == 1).alias("single"))


def all_prefixed(utts: DataFrame) -> DataFrame:
    """(prefixed): does every recording's name begin with its speaker's?"""
    return utts.agg(F.bool_and(F.startswith("rec", "spk")).alias("prefixed"))


def recordings_as_utterances(utts: DataFrame) -> DataFrame:
    """(utt, rec, spk): one utterance for each recording, named by it, with the speaker before it unless all have it.

    A recording of several speakers is an error.
    """
    one = checked(utts.groupBy("rec").agg(F.min("spk").alias("spk"), F.max("spk").alias("_last")), F.col("spk") == F.col("_last"), "a recording has several speakers").drop("_last")
    named = one.join(one.agg(F.bool_and(F.startswith("rec", "spk")).alias("_p")).hint("broadcast"))  # one row
    return named.select(F.when(F.col("_p"), F.col("rec")).otherwise(F.concat_ws("_", "spk", "rec")).alias("utt"), "rec", "spk")
