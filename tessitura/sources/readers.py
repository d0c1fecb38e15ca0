"""Readers for corpus text files, feature archives, models and result folders, each as a DataFrame.

All but :func:`read_unit_ids` and :func:`read_token_lists` are line-parallel scans with explicit schemas; those two need
line numbers, so each of their (small) files is one row that is split.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "utt string, rec string, start double, stop double"
UTT2SPK = "utt string, spk string"
SPK2GENDER = "spk string, gender string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """(tokens array<string>) of the non-empty lines."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("tokens"))


def checked(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, whose evaluation fails with message at the first row for which condition is not true."""
    name = df.columns[0]
    return df.withColumn(name, F.when(condition, F.col(f"`{name}`")).otherwise(F.raise_error(F.lit(message)).cast(df.schema[name].dataType)))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(utt, rec, start, stop) from `utt rec.wav start stop` lines; any other shape is an error."""
    t = checked(_tokens(spark, path), (F.size("tokens") == 4) & F.element_at("tokens", 2).endswith(".wav"), "a segment is utt, rec.wav, start and stop")
    at = lambda i: F.element_at("tokens", i)
    return t.select(at(1).alias("utt"), F.regexp_replace(at(2), r"\.wav$", "").alias("rec"), at(3).cast("double").alias("start"), at(4).cast("double").alias("stop"))


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """(utt, rec) from segment lines with or without times: recordings as utterances."""
    t = checked(_tokens(spark, path), F.size("tokens").isin(2, 4), "a line has two or four tokens")
    return t.select(F.element_at("tokens", 1).alias("utt"), F.regexp_replace(F.element_at("tokens", 2), r"\.[^.]*$", "").alias("rec"))


def read_utt2spk(spark: SparkSession, path: str) -> DataFrame:
    t = checked(_tokens(spark, path), F.size("tokens") == 2, "a line is utt and spk")
    return t.select(F.element_at("tokens", 1).alias("utt"), F.element_at("tokens", 2).alias("spk"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(utt, words array<string>) from `utt word word ...` lines; an utterance may have no words."""
    return _tokens(spark, path).select(F.element_at("tokens", 1).alias("utt"), F.slice("tokens", 2, F.size("tokens")).alias("words"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, phones array<string>) from `word phone phone ...` lines; a word may have several lines, none without phones."""
    t = checked(_tokens(spark, path), F.size("tokens") > 1, "a lexicon line is a word and its phones")
    return t.select(F.element_at("tokens", 1).alias("word"), F.slice("tokens", 2, F.size("tokens")).alias("phones"))


def read_gender(spark: SparkSession, path: str) -> DataFrame:
    """(spk, gender); a gender other than m and f is an error."""
    t = checked(_tokens(spark, path), (F.size("tokens") == 2) & F.element_at("tokens", 2).isin("m", "f"), "a line is spk and m or f")
    return t.select(F.element_at("tokens", 1).alias("spk"), F.element_at("tokens", 2).alias("gender"))


def read_utterance_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct first tokens."""
    return _tokens(spark, path).select(F.element_at("tokens", 1).alias("utt")).distinct()


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(utt, start, stop, post, phone, word): a phone for each line; word is null where there is none."""
    at = lambda i: F.try_element_at("tokens", F.lit(i))
    return _tokens(spark, path).select(at(1).alias("utt"), at(2).cast("double").alias("start"), at(3).cast("double").alias("stop"), at(4).cast("double").alias("post"), at(5).alias("phone"), at(6).alias("word"))


def read_archive(spark: SparkSession, path: str, first: float = 0.0125, step: float = 0.01) -> DataFrame:
    """(item, frame, t, x) from a text feature archive of `item  [` blocks that a `]` ends."""
    blocks = spark.read.option("lineSep", "]").text(path).where(F.trim(F.translate("value", "\n\r", "  ")) != "")
    head = F.trim(F.translate(F.split_part("value", F.lit("["), F.lit(1)), "\n\r", "  "))
    rows = F.filter(F.transform(F.split(F.split_part("value", F.lit("["), F.lit(2)), "\n"), lambda r: F.trim(r)), lambda r: r != "")
    frames = blocks.select(head.alias("item"), F.posexplode(rows).alias("frame", "row"))
    return frames.select("item", "frame", (F.lit(first) + F.lit(step) * F.col("frame")).alias("t"), F.transform(F.split("row", r"\s+"), lambda v: v.cast("double")).alias("x"))


def read_features(spark: SparkSession, path: str, item: str | None = None) -> DataFrame:
    """Long features (item, frame, t, x) from Parquet; item is pushed down to the scan."""
    frames = spark.read.parquet(path)
    return frames if item is None else frames.where(F.col("item") == item)


def to_long(wide: DataFrame) -> DataFrame:
    """(item, times, feats) as one row for each frame."""
    return wide.select("item", F.posexplode(F.arrays_zip("times", "feats")).alias("frame", "z")).select("item", "frame", F.col("z.times").alias("t"), F.col("z.feats").alias("x"))


def to_wide(frames: DataFrame) -> DataFrame:
    """(item, times, feats) with frames in order of time; a row holds one item's frames."""
    packed = F.sort_array(F.collect_list(F.struct("t", "frame", "x")))
    return frames.groupBy("item").agg(packed.alias("z")).select("item", F.col("z.t").alias("times"), F.col("z.x").alias("feats"))


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """(component, log_weight, mean, cov) of a Gaussian mixture.

    The file holds a row for each component, or one row with a list of them: both orientations give the same rows.
    """
    rows = spark.read.parquet(path)
    if "clusters" in rows.columns:
        rows = rows.select(F.posexplode("clusters").alias("component", "c")).select("component", "c.*")
    named = {"logpi": "log_weight", "mu": "mean", "Sigma": "cov", "weights": "log_weight"}
    return rows.withColumnsRenamed({a: b for a, b in named.items() if a in rows.columns})


def read_matrix_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One matrix from the parts that it was written in, stacked."""
    return spark.read.parquet(*paths)


def read_items(spark: SparkSession, path: str, features: bool = True) -> DataFrame:
    """An item table with its header; `-` and `#` in names become `_` and nothing.

    The columns before the second name with a `#` (file and times) say where an item's features are; features: keep them.
    """
    rows = spark.read.option("header", True).option("sep", " ").csv(path)
    marked = [i for i, c in enumerate(rows.columns) if c.startswith("#")]
    kept = rows.columns if features or len(marked) < 2 else rows.columns[marked[1] :]
    return rows.select(*[F.col(f"`{c}`").alias(c.replace("-", "_").replace("#", "")) for c in kept])


def read_indexed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header whose first column is a row index, which goes. schema: of the columns after it."""
    return spark.read.option("header", True).schema(f"_index string, {schema}").csv(path).drop("_index")


def file_name() -> Column:
    return F.col("_metadata.file_name")


def fetch_results(spark: SparkSession, path: str, schema: str, keep: Callable[[Column], Column] | None = None, metadata: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """All CSV results in a folder, with file name, filtered by it before anything is read, and metadata from it."""
    rows = spark.read.option("header", True).schema(schema).csv(path).withColumn("file", file_name())
    if keep:
        rows = rows.where(keep(F.col("file")))
    return rows.withColumns(metadata(F.col("file"))) if metadata else rows


def apply_analysis(results: DataFrame, analysis: Callable[[DataFrame], DataFrame], resamples: DataFrame | None = None, cache: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(analysis of the results, of the resamples with their boot_id), the latter from cache if it is there.

    A cache that a lost job left unfinished is made again: only a whole one has its mark.
    """
    found = results.transform(analysis)
    if resamples is None:
        return found, None
    if not cache:
        return found, resamples.transform(analysis)
    spark = results.sparkSession
    if not exists(spark, f"{cache}/_SUCCESS"):
        resamples.transform(analysis).write.mode("overwrite").parquet(cache)
    return found, spark.read.parquet(cache)


def read_unit_ids(spark: SparkSession, path: str) -> DataFrame:
    """(file, unit, phone, hmm_state, pdf_id): a line `phone state pdf` for each unit, or one line of phone names."""
    whole = spark.read.text(path, wholetext=True).select(file_name().alias("file"), F.split(F.regexp_replace("value", r"\s+$", ""), "\n").alias("lines"))
    single = whole.where(F.size("lines") == 1).select("file", F.posexplode(F.split(F.trim(F.col("lines")[0]), r"\s+")).alias("unit", "phone"))
    single = single.select("file", "unit", "phone", F.lit(None).cast("int").alias("hmm_state"), F.lit(None).cast("int").alias("pdf_id"))
    many = whole.where(F.size("lines") > 1).select("file", F.posexplode("lines").alias("unit", "line")).select("file", "unit", F.split(F.trim("line"), r"\s+").alias("t"))
    many = many.select("file", "unit", F.col("t")[0].alias("phone"), F.try_element_at("t", F.lit(2)).cast("int").alias("hmm_state"), F.try_element_at("t", F.lit(3)).cast("int").alias("pdf_id"))
    return single.unionByName(many)


def read_durations(spark: SparkSession, path: str) -> DataFrame:
    """(file, unit, durations array<double>, duration): a line of numbers for each unit; the mean is null if empty."""
    whole = spark.read.text(path, wholetext=True).select(file_name().alias("file"), F.split(F.regexp_replace("value", r"\n$", ""), "\n").alias("lines"))
    lines = whole.select("file", F.posexplode("lines").alias("unit", "line"))
    numbers = F.transform(F.filter(F.split(F.trim("line"), r"\s+"), lambda v: v != ""), lambda v: v.cast("double"))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a))
    return lines.withColumn("durations", numbers).select("file", "unit", "durations", mean(F.col("durations")).alias("duration"))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n) lines of each file."""
    return spark.read.text(path).groupBy(file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))


def read_token_lists(spark: SparkSession, path: str) -> DataFrame:
    """(file, n) tokens of each file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(file_name().alias("file"), F.size(F.filter(F.split("value", r"\s+"), lambda v: v != "")).alias("n"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, file, length) of the files of a folder whose names match the glob."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", False).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "length")


def templated(grid: DataFrame, template: str, *columns: str) -> DataFrame:
    """grid with path: the template (printf style) filled with each row's columns."""
    return grid.withColumn("path", F.format_string(template, *columns))


@dataclass(frozen=True)
class Corpus:
    """A named bundle of tables: segments, speakers, and where there are any text and lexicon."""

    name: str
    segments: DataFrame
    utt2spk: DataFrame
    text: DataFrame | None = None
    lexicon: DataFrame | None = None

    @staticmethod
    def load(spark: SparkSession, folder: str, name: str, validate: bool = True) -> Corpus:
        """The tables of a folder's segments.txt and utt2spk.txt, and of text.txt and lexicon.txt if they are there."""
        more = {part: read(spark, f"{folder}/{part}.txt") for part, read in (("text", read_text), ("lexicon", read_lexicon)) if exists(spark, f"{folder}/{part}.txt")}
        corpus = Corpus(name, read_segments(spark, f"{folder}/segments.txt"), read_utt2spk(spark, f"{folder}/utt2spk.txt"), **more)
        return corpus.validated() if validate else corpus

    def validated(self) -> Corpus:
        """The corpus itself; an error that names an utterance or word if its tables contradict each other."""
        rules = {f"{part}: an utterance has several rows": t.groupBy("utt").count().where("count > 1").select("utt") for part, t in (("segments", self.segments), ("utt2spk", self.utt2spk), ("text", self.text)) if t is not None}
        rules["segments: an utterance ends before it starts"] = self.segments.where("stop < start").select("utt")
        rules["segments: an utterance has no speaker"] = self.segments.join(self.utt2spk, "utt", "left_anti").select("utt")
        if self.text is not None:
            rules["text: an utterance has no segment"] = self.text.join(self.segments, "utt", "left_anti").select("utt")
            if self.lexicon is not None:
                rules["text: a word is not in the lexicon"] = self.text.select(F.explode("words").alias("word")).join(self.lexicon, "word", "left_anti")
        found = [bad.select(F.lit(rule).alias("rule"), F.col(bad.columns[0]).alias("key")).limit(1) for rule, bad in rules.items()]
        every = found[0]
        for one in found[1:]:
            every = every.unionByName(one)
        broken = every.collect()  # one row a rule at most
        if broken:
            raise ValueError("; ".join(f"{r.rule} ({r.key})" for r in broken))
        return self

    def durations(self) -> DataFrame:
        """(utt, spk, rec, start, stop, duration)."""
        return self.segments.withColumn("duration", F.col("stop") - F.col("start")).join(self.utt2spk, "utt")

    def subcorpus(self, utts: DataFrame, name: str) -> Corpus:
        """The utterances that utts (utt) lists, in all tables."""
        cut = lambda t: t.join(utts.select("utt"), "utt", "left_semi") if t is not None else None
        return replace(self, name=name, segments=cut(self.segments), utt2spk=cut(self.utt2spk), text=cut(self.text))
