"""Language ID by compression: the language whose dictionary encodes the text in the fewest bytes.

Fitting takes a bounded sample of labelled documents: for each language the ones first in a seeded hash order of their
ids and texts, SAMPLE_DOCS of them at most, each giving a short excerpt of about its share, from a hashed place in the
whole text, to DICTIONARIES raw-content zstandard dictionaries of DICTIONARY_BYTES each. Beyond FULL_LANGUAGES languages
both bounds fall in proportion, so that all languages are learned and what reaches the driver stays bounded. Texts are lower-cased and runs of other characters than letters become a space. A text is encoded in blocks of
BLOCK_BYTES, each on its own, so that a long text can't live off its own repetitions and every block asks the
dictionary again; a language's cost is the sum over the blocks. The smallest cost wins and the score is the margin to the
next language. Every text, of whatever length, is put to all the dictionaries of each language, and the cost is their
mean, since one counts whole bytes only. Texts under LEAST_BYTES, which zstandard would store as they are, are repeated
to that length. Whole texts are encoded, never prefixes.

Narrow margins are rejected. How narrow depends on the text's length and is calibrated on labelled documents that may be
learned from but are in no dictionary: of beginnings of them of each length of LENGTHS that are told rightly, half of the
QUANTILE of the margins (a quantile of few is too high for others) and WIDE at most. With one learned language, its rival is encoding without a dictionary.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from ..session import ship
from .common import free_name, table

#: Bounds of the fitted sample: documents of a language, and bytes and number of its dictionaries.
SAMPLE_DOCS, DICTIONARY_BYTES, DICTIONARIES = 600, 64 << 10, 4
#: Languages up to which these hold, and beyond which lang is taken for something else and refused.
FULL_LANGUAGES, MOST_LANGUAGES = 256, 8192
#: Bytes of a document in the dictionaries: its share of them, and no more than the second where documents are few.
LEAST_EXCERPT, MOST_EXCERPT = DICTIONARY_BYTES * DICTIONARIES // SAMPLE_DOCS, DICTIONARY_BYTES // 16
BLOCK_BYTES, LEAST_BYTES = 2048, 48
#: Short matches count in short blocks; the tables hold every place of a dictionary.
ENCODER = {"min_match": 3, "strategy": zstandard.STRATEGY_GREEDY, "window_log": 17, "hash_log": 16, "chain_log": 16}
#: Of every CALIBRATE_EVERY sampled documents one calibrates, CALIBRATION_DOCS of all languages at most (but one of each).
CALIBRATE_EVERY, CALIBRATION_DOCS = 5, 1024
#: Lengths in bytes at which margins are calibrated, the share of right predictions that sets them, and a margin that is never narrow.
LENGTHS, QUANTILE, WIDE = (1, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096), 0.01, 0.05
#: Least margins by length if there is nothing to calibrate them with.
LEAST_MARGINS = (0.0, 0.0, 0.0, *[0.02] * 8)
_NOT_LETTERS = regex.compile(r"[^\p{L}]+")
UNDETERMINED = "und"


def held_out(doc_id: Column | str) -> Column:
    """Documents that are never learned from: crc32 of the id as text is 0 modulo 5, or there is no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


class Fitted(dict):
    """Dictionaries by language, and the margins by length of text (LENGTHS) up to which predictions are rejected."""

    margins: tuple[float, ...] = LEAST_MARGINS


def fit(docs: DataFrame, seed: int = 41) -> Fitted:
    """Dictionaries by language from (doc_id, text, lang).

    Only the sampled documents' excerpts come to the driver: SAMPLE_DOCS documents a language, and a quarter as many for
    the margins. Rows that are equal in id, text and language count once. More than MOST_LANGUAGES languages are a
    ValueError. No learnable rows give no languages.
    """
    learnable = docs.where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    counts = {r.lang: r.n for r in learnable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return Fitted()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    part = min(1.0, FULL_LANGUAGES / len(counts))
    size, learned = int(DICTIONARY_BYTES * part), max(DICTIONARIES, int(SAMPLE_DOCS * part))
    wanted = learned * CALIBRATE_EVERY // (CALIBRATE_EVERY - 1)
    each = max(1, CALIBRATION_DOCS // len(counts))
    # Of a language with many documents, those with the least hashes suffice: about twice as many as are wanted.
    by_lang = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * wanted / n))])
    h, spare = F.xxhash64(F.lit(seed), "doc_id", "text"), F.greatest(F.length("text") - 2 * MOST_EXCERPT, F.lit(0)) + 1
    few = learnable.where(F.col("text").isNotNull()).withColumn("h", h).where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.try_element_at(by_lang, F.col("lang")))
    # What isn't letters shrinks, so more is fetched than an excerpt has.
    few = few.select("lang", "h", F.substring("text", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), spare).cast("int") + 1, F.lit(2 * MOST_EXCERPT)).alias("text"))
    few = few.groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = few.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("n") <= wanted).withColumn("aside", F.col("n") % CALIBRATE_EVERY == 0)
    ranked = ranked.withColumn("all", F.count(F.lit(1)).over(W.partitionBy("lang"))).where(~F.col("aside") | (F.col("n") <= each * CALIBRATE_EVERY))
    share = F.greatest(F.lit(LEAST_EXCERPT), F.least(F.lit(MOST_EXCERPT), F.lit(size * DICTIONARIES * 2) / F.col("all")))
    rows = ranked.select("lang", "n", "aside", F.when(F.col("aside"), F.col("text")).otherwise(F.substring(F.col("text"), F.lit(1), (2 * share).cast("int"))).alias("text")).collect()
    bodies: dict[str, list[bytes]] = {}
    tests: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.n)):
        if r.aside:
            tests.setdefault(r.lang, []).append(r.text)
        else:
            bodies.setdefault(r.lang, []).append(normalised(r.text))
    out = Fitted()
    for lang, parts in sorted(bodies.items()):
        own = min(MOST_EXCERPT, max(LEAST_EXCERPT, size * DICTIONARIES // len(parts)))
        parts = [p[:own] for p in parts]
        # Dealt to the dictionaries in turn, so that each has a sample of its own.
        made = [b" ".join(parts[i::DICTIONARIES])[:size] for i in range(DICTIONARIES)]
        out[lang] = [m for m in made if len(m) >= 8] or [b" ".join(parts).ljust(8)]
    out.margins = calibrated(out, [(lang, t) for lang, texts in sorted(tests.items()) for t in texts])
    return out


def calibrated(dictionaries: dict[str, list[bytes]], labelled: list[tuple[str, str]]) -> tuple[float, ...]:
    """Least margins by LENGTHS: half the QUANTILE of those of right predictions, WIDE at most; a length that no document has, as the one before."""
    classifier, data, out = Classifier(dictionaries), [(lang, normalised(t)) for lang, t in labelled], []
    for k, n in enumerate(LENGTHS):
        told = [(lang, classifier.told(d[:n])) for lang, d in data if len(d) >= n and any(map(str.isalpha, d[:n].decode("utf-8", "ignore")))]
        right = [score for lang, (best, score) in told if best == lang]
        out.append(min(WIDE, float(np.quantile(right, QUANTILE, method="lower")) / 2) if right else out[-1] if data and out else LEAST_MARGINS[k])
    return tuple(out)


def normalised(text: str) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


class Classifier:
    def __init__(self, dictionaries: dict[str, list[bytes]]) -> None:
        self.langs = sorted(dictionaries)
        self.margins = getattr(dictionaries, "margins", LEAST_MARGINS)
        settings = zstandard.ZstdCompressionParameters.from_level(1, write_content_size=False, write_checksum=False, write_dict_id=False, **ENCODER)
        self.plain = [zstandard.ZstdCompressor(compression_params=settings)]
        self.coders = []
        for lang in self.langs:
            own = []
            for d in dictionaries[lang]:
                made = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made.precompute_compress(compression_params=settings)
                own.append(zstandard.ZstdCompressor(dict_data=made, compression_params=settings))
            self.coders.append(own)

    def costs(self, data: bytes, plain: bool = False) -> list[float]:
        """Bytes by language, as the mean over its dictionaries, and then without one if asked for."""
        data = data * -(-LEAST_BYTES // max(1, len(data)))
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)] or [b""]
        return [sum(len(c.compress(b)) for b in blocks for c in own) / len(own) for own in (*self.coders, *[self.plain] * plain)]

    def told(self, data: bytes) -> tuple[str, float]:
        """(language, margin to the next one's cost), of a single language to the cost without a dictionary."""
        costs = self.costs(data, len(self.langs) == 1)
        order = sorted(range(len(self.langs)), key=lambda i: (costs[i], self.langs[i]))
        best, second = costs[order[0]], costs[order[1] if len(order) > 1 else 1]
        return self.langs[order[0]], max(0.0, min(1.0, (second - best) / second))

    def least(self, size: int) -> float:
        """The margin up to which texts of that many bytes are rejected: that of the next length below, LENGTHS[0] at least."""
        return self.margins[max(0, bisect.bisect_right(LENGTHS, size) - 1)]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected?). No text, no letter in it or nothing learned: undetermined, 0, rejected."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        data = normalised(text)
        lang, score = self.told(data)
        return lang, score, score <= self.least(len(data))


def identify(docs: DataFrame, dictionaries: dict[str, list[bytes]], text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected (an underscore before a name that docs has).

    Predictions see the text only. Null texts and texts without a letter are `und`, score 0, rejected; ties go to the
    first language by code point. Ties and margins not over the calibrated one are rejected.
    """
    ship(docs.sparkSession)
    names = [free_name(docs, n) for n in ("lang_pred", "score", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # 64 MB at most: FULL_LANGUAGES x DICTIONARIES x DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            found = [classifier.classify(t) for t in batch.column(text).to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    kinds = (StringType(), DoubleType(), BooleanType())
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(n, k) for n, k in zip(names, kinds, strict=True)]]))


def op4_language(spark, sf_dir: str) -> DataFrame:
    """One row for each document, by :func:`fit` on the learnable ones and :func:`identify` on all; a null doc_id is held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
