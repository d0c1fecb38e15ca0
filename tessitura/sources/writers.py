"""Sinks: corpus subsets, features, matrices, item files, recording files, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import Corpus


def save_corpus(corpus: Corpus, folder: str) -> None:
    """A Parquet table for each member; fails if there is one already."""
    for part in ("segments", "utt2spk", "text", "lexicon"):
        table = getattr(corpus, part)
        if table is not None:
            table.write.parquet(f"{folder}/{corpus.name}/{part}")


def save_subsets(subsets: DataFrame, folder: str) -> None:
    """Segment tables by (n_subsets, subset_id), one folder each."""
    subsets.write.partitionBy("n_subsets", "subset_id").parquet(folder)


def save_subset_files(subsets: DataFrame, folder: str, name: str = "segments") -> None:
    """Segment lines in folders `file=<name>__<n>subsets__subset<1 + id>.txt`, which the segment reader takes.

    subsets: (n_subsets, subset_id, utt, rec, start, stop), ids from 0. One job writes them all.
    """
    line = F.concat_ws(" ", "utt", F.concat("rec", F.lit(".wav")), F.col("start").cast("string"), F.col("stop").cast("string"))
    file = F.format_string(f"{name}__%dsubsets__subset%d.txt", F.col("n_subsets").cast("int"), (F.col("subset_id") + 1).cast("int"))
    subsets.select(line.alias("value"), file.alias("file")).write.partitionBy("file").text(folder)


def append_features(frames: DataFrame, path: str) -> None:
    frames.write.mode("append").parquet(path)


def save_matrix(rows: DataFrame, path: str, most_bytes: int = 1 << 30, width: int | None = None) -> None:
    """Rows of x in files of at most most_bytes (8 bytes a number). width: numbers of a row, the most that a row has if None."""
    width = width or rows.agg(F.max(F.size("x"))).first()[0] or 1
    rows.write.option("maxRecordsPerFile", max(1, most_bytes // (8 * width))).parquet(path)


def save_items(items: DataFrame, path: str) -> None:
    """An item file with its header, space separated."""
    items.write.option("header", True).option("sep", " ").csv(path)


def save_lines(rows: DataFrame, columns: list[str], path: str) -> None:
    """Text files of space-separated columns whose lines, in order of the files' names, are in byte order, as `LC_ALL=C sort` gives it."""
    rows.select(F.concat_ws(" ", *columns).alias("value")).orderBy("value").write.text(path)


def recording_tables(segments: DataFrame, utt2spk: DataFrame, wav_folder: str) -> dict[str, DataFrame]:
    """The lines (value) of the tables that feature extraction reads: wav.scp, segments and utt2spk."""
    wav = segments.select("rec").distinct().select(F.concat(F.col("rec"), F.lit(f" {wav_folder.rstrip('/')}/"), F.col("rec"), F.lit(".wav")).alias("value"))
    timed = {"start", "stop"} <= set(segments.columns)
    cut = segments.select(F.concat_ws(" ", "utt", "rec", *(["start", "stop"] if timed else [])).alias("value"))
    return {"wav.scp": wav, "segments": cut, "utt2spk": utt2spk.select(F.concat_ws(" ", "utt", "spk").alias("value"))}


def save_stats(stats: DataFrame, path: str) -> None:
    stats.write.option("header", True).csv(path)


def is_checkpoint(outer: int, last: int) -> bool:
    """Models are kept after outer steps that are powers of two, and after the last."""
    return outer == last or outer > 0 and outer & (outer - 1) == 0
