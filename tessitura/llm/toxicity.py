"""Toxicity by character n-grams: a logistic regression whose features are scaled by naive Bayes log-count ratios.

A text's features are the hash buckets of its n-grams, each there or not. A bucket's scale is the log of how much more
often documents of label 1 have it than those of label 0. Buckets that the documents of both labels have equally often, up to
Z standard errors, carry no sign of the label and are left out; the others' weights are fitted by regularised logistic
regression.

The fit reads a sample of labelled documents of bounded size (SAMPLE of each label, with their whole texts); the sample's
weights restore the labels' true shares, so that scores are probabilities. Every text is then scored whole, by one table of
a weight for each bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import ship
from .common import discard, free_name, saved, table

#: Lengths of n-grams, and the logarithm of the number of buckets.
SIZES, BITS = (3, 4, 5), 20
#: Labelled documents of each label that are learned from, at most.
SAMPLE = 8192
#: Standard errors that the shares of documents with a bucket must differ by, and the most buckets that get a weight (under 2^15).
Z, FEATURES = 5.0, 1 << 13
#: Weight of the squared weights against the mean loss; rounds of the solver at most.
RIDGE, ROUNDS = 1e-4, 100
#: Code points that are hashed, and features of documents that are added up, at once.
STRIP, ENTRIES = 1 << 18, 1 << 20

_FACTOR = np.uint32(0x9E3779B1)
_SPREAD = np.uint32(0x85EBCA6B)


def buckets(texts: list[str | None], wanted: np.ndarray | None = None, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the distinct buckets of each text's n-grams, sorted, for runs of whole texts.

    Texts are lower-cased, spaces of all kinds are one character, and each text has a space before and after it. A null
    text is an empty one. wanted: which buckets are of interest, all if None.
    """
    first = 0
    while first < len(texts):
        parts, size, row = [], 0, first
        while row < len(texts) and (row == first or size < STRIP):
            parts.append(f" {(texts[row] or '').lower()} ")
            size += len(parts[-1])
            row += 1
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        codes = np.where(codes - np.uint32(9) < 5, np.uint32(32), codes)
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(first, row), lengths)
        h, found = np.zeros(len(codes), np.uint32), []
        for n in range(1, max(sizes) + 1):
            more = len(codes) - n + 1
            if more <= 0:
                break
            h = (h[:more] + codes[n - 1 :]) * _FACTOR
            if n in sizes:
                inside = np.ones(more, bool)
                for back in range(1, n):  # n-grams that would reach into the next text
                    at = ends - back
                    inside[at[(at >= 0) & (at < more)]] = False
                spread = (h ^ (h >> np.uint32(15))) * _SPREAD + np.uint32(n)
                spread ^= spread >> np.uint32(13)
                bucket = (spread * _FACTOR)[inside] >> np.uint32(32 - bits)
                if wanted is not None:
                    hit = wanted[bucket]
                    found.append(owner[:more][inside][hit] << bits | bucket[hit])
                else:
                    found.append(owner[:more][inside] << bits | bucket)
        pairs = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        if len(pairs):
            pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
        yield pairs >> bits, pairs & ((1 << bits) - 1)
        first = row


def log_count_ratio(one: np.ndarray, zero: np.ndarray, n_one: int, n_zero: int) -> np.ndarray:
    """Log of how much more often documents of label 1 have a feature, from the documents of each label that have it."""
    return np.log((one + 1.0) / (n_one + 2.0)) - np.log((zero + 1.0) / (n_zero + 2.0))


@dataclass
class Model:
    """bias and, for each bucket that has a weight, its number and its weight times its log-count ratio."""

    bias: float = -math.inf
    bucket: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 for each text."""
        weights = np.zeros(1 << BITS)
        weights[self.bucket] = self.weight
        total = np.full(len(texts), self.bias)
        for row, bucket in buckets(texts, weights != 0):
            total += np.bincount(row, weights[bucket], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def regression(start: np.ndarray, column: np.ndarray, scale: np.ndarray, label: np.ndarray, share: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the columns and the bias of a logistic regression on sparse rows, by limited-memory quasi-Newton steps.

    Row i has the columns column[start[i]:start[i + 1]], each with its scale as value. share: each row's part of the loss, in
    sum 1. The bias is not regularised.
    """
    columns, lengths = len(scale), np.diff(start)
    # Rows that are worked on at once, so that only the column numbers are held whole.
    edges = np.unique(np.concatenate([np.searchsorted(start, np.arange(0, int(start[-1]) + 1, ENTRIES)), [len(label)]]))
    blocks = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if edges[0] == 0 else [(0, len(label))]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        s, slope, own = np.full(len(label), w[-1]), np.zeros(columns + 1), w[:-1] * scale
        for a, b in blocks:
            s[a:b] += np.bincount(np.repeat(np.arange(b - a), lengths[a:b]), own[column[start[a] : start[b]]], b - a)
        miss = share * (1 / (1 + np.exp(-np.clip(s, -700, 700))) - label)
        for a, b in blocks:
            slope[:-1] += np.bincount(column[start[a] : start[b]], np.repeat(miss[a:b], lengths[a:b]), columns)
        slope[:-1] = slope[:-1] * scale + ridge * w[:-1]
        slope[-1] = miss.sum()
        return float((share * (np.logaddexp(0, s) - label * s)).sum() + ridge / 2 * (w[:-1] @ w[:-1])), slope

    mean = float(share @ label)
    w = np.append(np.zeros(columns), math.log(mean / (1 - mean)))
    (now, slope), steps = loss(w), []
    for _ in range(rounds):
        direction, used = -slope, []
        for s, y in reversed(steps):
            a = (s @ direction) / (s @ y)
            direction = direction - a * y
            used.append(a)
        if steps:
            direction = direction * ((steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]))
        for (s, y), a in zip(steps, reversed(used), strict=True):
            direction = direction + s * (a - (y @ direction) / (s @ y))
        length, down = 1.0 if steps else 1 / max(1.0, float(np.abs(slope).sum())), slope @ direction
        while True:
            new, new_slope = loss(w + length * direction)
            if new <= now + 1e-4 * length * down or length < 1e-12:
                break
            length /= 2
        s, y = length * direction, new_slope - slope
        w, gained, now, slope = w + s, now - new, new, new_slope
        if s @ y > 1e-14:
            steps = [*steps, (s, y)][-10:]
        if gained < 1e-9:
            break
    return w


def held_out(key: str) -> Column:
    """Is the row kept from learning? A null key is."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 13, key: str = "doc_id", label: str = "toxic", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """((_label, _text, _h) of the documents that are learned from, how many documents have each label).

    Of each label the `sample` ids with the least hashes are taken, so the chosen part of labels is small whatever its
    size, and no text is exchanged.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).distinct()
    counts = {r._label: r.n for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    h = F.xxhash64(F.lit(seed), "_key")
    chosen = None
    for value, n in sorted(counts.items()):
        near = known.where(F.col("_label") == value).withColumn("_h", h).where(F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53)) < min(1.0, 2.0 * sample / n))
        few = near.orderBy("_h", "_key").limit(sample)
        chosen = few if chosen is None else chosen.unionByName(few)
    if chosen is None:
        return docs.select(F.lit(0).alias("_label"), F.col(text).alias("_text"), F.lit(0).cast("long").alias("_h")).limit(0), counts
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")  # 2 x sample rows of 20 bytes
    # Their order, which decides how sums are rounded, is that of their content.
    return rows.select("_label", "_text", F.xxhash64("_key", "_label", "_text").alias("_h")), counts


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 13, key: str = "doc_id", label: str = "toxic", text: str = "text", z: float = Z, features: int = FEATURES) -> Model:
    """A model from the documents that labels (key, label 0 or 1) has, but those that are held out.

    Repeated rows of labels count once, an id with both labels with each; other labels and ids without a document don't
    count. Repeated documents count each. Without documents of both labels there is nothing to tell them by: all texts get
    the share of label 1 in the sample, 0 if there is none.
    """
    spark = docs.sparkSession
    ship(spark)
    few, known = sampled(docs, labels, sample, seed, key, label, text)
    few = saved(few)
    n = {r._label: r.n for r in few.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(n) < 2:
        discard(few)
        return Model(math.inf if n.get(1) else -math.inf)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            label_of = np.asarray(batch.column("_label"))
            for row, bucket in buckets(batch.column("_text").to_pylist()):
                for value in (0, 1):
                    held[value] += np.bincount(bucket[label_of[row] == value], minlength=1 << BITS)
        seen = np.flatnonzero(held.any(0))
        for i in range(0, len(seen), 1 << 16):
            part = seen[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[0, part]), pa.array(held[1, part])], ["bucket", "zero", "one"])

    counted = few.mapInArrow(count, "bucket long, zero long, one long").groupBy("bucket").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
    both = (F.col("one") + F.col("zero")) / float(n[1] + n[0])
    error = F.sqrt(both * (1 - both) * (1.0 / n[1] + 1.0 / n[0]))
    telling = counted.withColumn("z", F.abs(F.col("one") / float(n[1]) - F.col("zero") / float(n[0])) / F.greatest(error, F.lit(1e-9))).where(F.col("z") > z).orderBy(F.desc("z"), "bucket").limit(features)
    rows = sorted(telling.collect(), key=lambda r: r.bucket)  # FEATURES rows at most
    bucket = np.array([r.bucket for r in rows], np.int64)
    ratios = log_count_ratio(np.array([r.one for r in rows], float), np.array([r.zero for r in rows], float), n[1], n[0])
    number = np.full(1 << BITS, -1, np.int16)
    number[bucket] = np.arange(len(bucket))
    shared = spark.sparkContext.broadcast(number)

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(row, shared.value[bucket]) for row, bucket in buckets(batch.column("_text").to_pylist(), shared.value >= 0)]
            row, column = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("_label"), batch.column("_h"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(column, pa.int16()))], ["_label", "_h", "columns"])

    # The sample's rows with the numbers of their features: 2 x SAMPLE rows, a few hundred numbers each.
    found = few.mapInArrow(matrix, "_label int, _h long, columns array<smallint>").toArrow().combine_chunks()
    discard(few)
    found = found.take(np.argsort(np.asarray(found["_h"].combine_chunks()), kind="stable")).combine_chunks()
    columns, y = found["columns"].combine_chunks(), np.asarray(found["_label"].combine_chunks(), float)
    all_known = sum(known.values())
    share = np.where(y == 1, known[1] / all_known / n[1], known[0] / all_known / n[0])
    w = regression(np.asarray(columns.offsets, np.int64), np.asarray(columns.values), ratios, y, share)
    return Model(float(w[-1]), bucket, w[:-1] * ratios)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: likelier of label 1) and predicted (1 from threshold on).

    Only the text decides, so equal texts score alike. Empty and null texts get the score of no feature at all. Texts of any
    length are scored whole. No rows give no rows; a name that docs has gets an underscore before it.
    """
    ship(docs.sparkSession)
    names = [free_name(docs, n) for n in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 16 bytes x FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column(text).to_pylist()))], [*batch.schema.names, names[0]])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(names[0], DoubleType())])).withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """One row for each document, by :func:`fit` on the labelled ones that are not held out and :func:`score` on all."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
