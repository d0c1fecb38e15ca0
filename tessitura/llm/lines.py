"""Line dedup: lines within one edit of an earlier line are removed, found by a deletion-neighbourhood join.

Two lines are within an edit bound of 1 exactly if a line with one character deleted equals the other (an insertion), or
both with the character at the same place deleted are equal (a substitution). So each line emits its variants as hashed
keys: each deletion with its place, each deletion without it, and the whole line. Equal keys are joined, not compared
pairwise: lines that share a deletion and its place are all one edit apart, and lines whose deletion is a given line are
all one edit from it, so links to the key's first line, or to that given line, keep every class whole.

A line has as many variants as characters, so they are emitted only where they can meet another line's, by two exact
filters on the same principle: of two lines within one edit, one half is the same in both (level 1, over all lines), and
all but one eighth is the same (level 2, over the distinct lines that level 1 leaves). Variants then are those of the
eighths that differ. Lines under FILTERED characters have few variants and skip the filters: all of theirs are emitted,
once for each distinct line, and so are the deletions of lines of FILTERED characters, whose partner may be shorter. Keys
of a level are counted with a partial aggregation, so a line that a third of all documents
hold, or a half that many lines share, costs no task more than its share.

Links are verified by edit distance on the lines, classes are connected components, and each class keeps its earliest
line by row number and line number. Blank lines always stay. Lines under `shortest` characters have exact copies only:
the registered query sets it to 0, so that every other line is linked; the function's own default is SHORTEST.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import ship
from .common import beside, numbered, packed, saved, table
from .links import components
from .textkit import cut_hash, mix, prefix_hash, slices, span_hash, utf8

#: Lines from this length on go through the filters; parts of the second filter.
FILTERED, EIGHTHS = 20, 8

#: Lengths of the halves' keys: steps of about an eighth, so that few lengths lie at a step and need two.
LADDER = np.array(sorted({int(8 * 1.125**i) for i in range(140)}), np.int64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Lines:
    """The lines of some rows of text: row, number in the row, byte and character places, hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        breaks = np.flatnonzero(raw == 10)
        self.start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        self.end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
        count = 1 + np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1])
        self.row = np.repeat(np.arange(len(offsets) - 1), count)
        self.number = np.arange(len(self.row)) - np.repeat(np.cumsum(count) - count, count)
        self.prefix = prefix_hash(raw)
        heads = (raw & 0xC0) != 0x80
        self.chars = np.concatenate([[0], np.cumsum(heads)])  # characters before each byte
        self.byte = np.append(np.flatnonzero(heads), len(raw))  # first byte of each character
        self.length = self.chars[self.end] - self.chars[self.start]
        ink = np.concatenate([[0], np.cumsum(~_BLANK[raw])])
        self.blank = ink[self.end] == ink[self.start]
        self.hash = span_hash(self.prefix, self.start, self.end)
        self.raw = raw

    def names(self) -> pa.Array:
        """What tells lines apart: 16 bytes, the hash and another one (xxh3) of each line."""
        whole = memoryview(np.ascontiguousarray(self.raw))
        other = [xxhash.xxh3_64_intdigest(whole[a:b], 5) for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]
        pairs = np.column_stack([self.hash, np.array(other, np.uint64)])
        return pa.Array.from_buffers(pa.binary(16), len(pairs), [None, pa.py_buffer(np.ascontiguousarray(pairs))]).cast(pa.binary())

    def span(self, line: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the characters a to b (counted in the line) of each line."""
        base = self.chars[self.start[line]]
        return span_hash(self.prefix, self.byte[base + a], self.byte[base + b])

    def without(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of each line without its character at `at`; the same as the hash of that text as a whole line."""
        i = self.chars[self.start[line]] + at
        s, e, a, b = self.start[line], self.end[line], self.byte[i], self.byte[i + 1]
        return cut_hash(self.prefix, s, a, b, e)


def half_keys(lines: Lines, shortest: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): level 1, both halves of each line for each length that a partner's shorter line may have."""
    who, keys = [], []
    long = np.flatnonzero(lines.length >= max(shortest, FILTERED))
    size = [LADDER[np.searchsorted(LADDER, (lines.length[long] - less) // 2, "right") - 1] for less in (0, 1)]
    for k, (h, some) in enumerate(((size[0], np.arange(len(long))), (size[1], np.flatnonzero(size[0] != size[1])))):
        line, h = long[some], h[some] if k else h
        n = lines.length[line]
        tag = (h * 2).astype(np.uint64)
        for side, (a, b) in enumerate(((np.zeros_like(h), h), (n - h, n))):
            who.append(line)
            keys.append(mix(lines.span(line, a, b) + (tag + np.uint64(side)) * np.uint64(0x9FB21C651E98DF25)))
    return np.concatenate(who), np.concatenate(keys)


def eighth_keys(lines: Lines) -> tuple[np.ndarray, ...]:
    """(line, shorter length, eighth, key): level 2, the line without one eighth, as the shorter or the longer of two."""
    every = np.arange(len(lines.row))
    out: list[tuple] = []
    for less in (0, 1):
        s = lines.length - less
        for j in range(EIGHTHS):
            a, b = j * s // EIGHTHS, (j + 1) * s // EIGHTHS
            n = lines.length
            key = mix(lines.span(every, np.zeros_like(a), a) + np.uint64(3) * lines.span(every, n - (s - b), n) + (s * EIGHTHS + j).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            out.append((every, s, np.full(len(every), j), key))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def variants(lines: Lines, line: np.ndarray, short: np.ndarray, eighth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, whole, placed): the deletions of each (line, shorter length, eighth) in that eighth, with their places or without, and the line itself."""
    n = lines.length[line]
    a, b = eighth * short // EIGHTHS, n - (short - (eighth + 1) * short // EIGHTHS)
    many = b - a
    own = np.repeat(np.arange(len(line)), many)
    at = a[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    deleted = lines.without(line[own], at)
    equal = n[own] == short[own]  # partners of the same length are substitutions: the place counts
    key = np.where(equal, mix(deleted + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)), deleted)
    whole = np.unique(line[n == short])
    return np.concatenate([line[own], whole]), np.concatenate([key, lines.hash[whole]]), np.repeat([False, True], [len(own), len(whole)]), np.concatenate([equal, np.zeros(len(whole), bool)])


def within_one(a: str, b: str) -> bool:
    """Is the edit distance (insertion, deletion, substitution of a character) of a and b at most 1?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _all_lines(rows: DataFrame, shortest: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, rid = batch.column("text"), np.asarray(batch.column("_rid"))
            there = np.flatnonzero(~np.asarray(column.is_null()))
            column, rid = column.take(pa.array(there)), rid[there]
            for i, _, part, at in slices(*utf8(column)):
                lines = Lines(part, at)
                who, key = half_keys(lines, shortest)
                order = np.argsort(who, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(lines.row)))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[order].view(np.int64)))
                use = pa.array(~lines.blank)
                direct = pa.array((lines.length >= shortest) & (lines.length <= FILTERED) & (shortest < FILTERED))
                yield pa.RecordBatch.from_arrays([pa.array(rid[i + lines.row]), pa.array(lines.number), lines.names(), direct, keys], ["_rid", "line", "lh", "direct", "keys"]).filter(use)

    return rows.mapInArrow(run, "_rid long, line long, lh binary, direct boolean, keys array<long>")


def _shared(keyed: DataFrame) -> DataFrame:
    """Keys of keyed (key, lh and more) under which there are different lines."""
    return keyed.groupBy("key").agg((F.min("lh") < F.max("lh")).alias("several")).where("several").select("key")


def _picked(rows: DataFrame) -> DataFrame:
    """(lh, text) of the lines numbered in `wanted` (array<struct<line, lh>>) of rows (_rid, text, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lh, text = [], []
            for whole, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                own = whole.split("\n")
                lh += [w["lh"] for w in wanted]
                text += [own[w["line"]] for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(lh, pa.binary()), pa.array(text, pa.string())], ["lh", "text"])

    return rows.select("text", "wanted").mapInArrow(run, "lh binary, text string")


def _each(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(lines, batch's lh, batch) over rows (lh, text, ...), one line a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part, at in slices(*utf8(batch.column("text"))):
                yield work(Lines(part, at), batch.column("lh").slice(i, j - i), batch.slice(i, j - i))

    return rows.mapInArrow(run, schema)


def _eighths(lines: Lines, lh: pa.Array, _: pa.RecordBatch) -> pa.RecordBatch:
    line, short, eighth, key = eighth_keys(lines)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), lh.take(pa.array(line)), pa.array(short), pa.array(eighth)], ["key", "lh", "short", "eighth"])


def _variants(lines: Lines, lh: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch:
    pairs = batch.column("parts").to_pylist()
    line = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    short, eighth = (np.array([x[k] for p in pairs for x in p], np.int64) for k in ("short", "eighth"))
    who, key, whole, placed = variants(lines, line, short, eighth)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), lh.take(pa.array(who)), pa.array(whole), pa.array(placed)], ["key", "lh", "whole", "placed"])


def _unfiltered(text: DataFrame) -> DataFrame:
    """(lh, short, eighth): every part of lines of text (lh, text) under FILTERED characters, and of those of FILTERED as the longer of two."""
    n = F.length("text").cast("long")
    shorts = text.where(n <= FILTERED).select("lh", F.explode(F.when(n < FILTERED, F.array(n, n - 1)).otherwise(F.array(n - 1))).alias("short"))
    return shorts.select("lh", "short", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(EIGHTHS - 1).cast("long"))).alias("eighth"))


def near_lines(lines: DataFrame, texts: DataFrame, shortest: int) -> tuple[DataFrame, DataFrame]:
    """(a, b), links of different lines' hashes to heads that keep every class whole, and (lh, links), the number of all
    different lines one edit apart; lines as of :func:`_all_lines`, texts (_rid, text).
    """
    halves = lines.select("lh", F.explode("keys").alias("key"))
    near = halves.join(_shared(halves), "key", "left_semi").select("lh")
    near = near.union(lines.where("direct").select("lh")).distinct()
    at = lines.join(near, "lh", "left_semi").groupBy("lh").agg(F.min(F.struct("_rid", "line")).alias("at"))
    wanted = at.groupBy(F.col("at._rid").alias("_rid")).agg(F.collect_list(F.struct(F.col("at.line").alias("line"), "lh")).alias("wanted"))
    text = saved(_picked(texts.join(wanted, "_rid")))
    parts = saved(_each(text.where(F.length("text") >= FILTERED), _eighths, "key long, lh binary, short long, eighth long"))
    parts = parts.join(_shared(parts), "key", "left_semi").select("lh", "short", "eighth")
    if shortest < FILTERED:
        parts = parts.union(_unfiltered(text))
    parts = parts.groupBy("lh").agg(F.collect_set(F.struct("short", "eighth")).alias("parts"))
    keys = saved(_each(text.join(parts, "lh"), _variants, "key long, lh binary, whole boolean, placed boolean").distinct())
    # Under a key with a whole line, all others are one edit from it; under one with a place, all are one edit apart.
    heads = keys.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("whole"), F.col("lh"))), F.min("lh")).alias("head"), F.count(F.lit(1)).alias("n"), F.max("whole").alias("given"))
    # Written first, so that the join has two plain exchanges, which can be split where a key is hot.
    heads = saved(heads.where("n > 1"))
    under = keys.join(heads, "key").where("placed or given")
    # Two lines share one such key only, so each key's members can be counted without listing pairs.
    degrees = under.groupBy("lh").agg(F.sum(F.when(F.col("placed") | F.col("whole"), F.col("n") - 1).otherwise(1)).alias("links"))
    pairs = under.where("lh <> head").select(F.col("lh").alias("a"), F.col("head").alias("b")).distinct()
    both = pairs.join(text.select(F.col("lh").alias("a"), F.col("text").alias("ta")), "a").join(text.select(F.col("lh").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within_one(x, y) for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(verify, "a binary, b binary"), degrees


def dedup_lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shortest: int = 0, order: str | None = None) -> DataFrame:
    """keep, n_lines, n_removed, n_links, kept (the text without the removed lines) for each row of docs.

    Lines are what newlines separate; a null text has none and stays null, an empty one has one blank line. Of lines
    that are equal or linked by edits, also through others, the earliest stays: that of the row with the least `order`
    (a column of docs, nulls last), then the row first in the scan, then the first in its row. n_links: for each of the
    row's lines the number of different lines of docs one edit from it, summed, counted by 62-bit keys; lines are told
    apart by 126 bits. Removing a line removes its newline. Every non-blank line is compared; with `shortest`, lines of
    fewer characters are linked with equal ones only. The four names get an underscore before them where keep has them.
    """
    ship(docs.sparkSession)
    texts = numbered(packed(docs, keep, text, **({"_order": order} if order else {})))
    rows = texts.select("_rid", F.col("_text").alias("text"))
    lines = saved(_all_lines(rows, shortest))
    links, degree = near_lines(lines, rows.where("text is not null"), shortest)
    labels = components(saved(links))
    place = F.struct("no", "_order", "_rid", "line") if order else F.struct("_rid", "line")
    placed = lines.select("_rid", "line", "lh")
    if order:
        placed = placed.join(texts.select("_rid", F.col("_order").isNull().alias("no"), "_order"), "_rid")
    first = placed.groupBy("lh").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n"))
    first = first.join(labels.withColumnRenamed("node", "lh"), "lh", "left").join(degree, "lh", "left").where("n > 1 or label is not null")
    first = saved(first.withColumn("label", F.coalesce("label", "lh")))
    heads = first.groupBy("label").agg(F.min("at").alias("head"))
    known = saved(first.join(heads, "label").select("lh", F.col("head._rid").alias("h"), F.col("head.line").alias("l"), F.coalesce("links", F.lit(0)).alias("links")))
    found = lines.select("_rid", "line", "lh").join(known, "lh").withColumn("gone", (F.col("_rid") != F.col("h")) | (F.col("line") != F.col("l")))
    found = found.where("gone or links > 0").groupBy("_rid").agg(F.collect_list(F.when(F.col("gone"), F.col("line"))).alias("gone"), F.sum("links").alias("n_links"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_removed, kept = [], [], []
            for whole, gone in zip(batch.column("_text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                own = [] if whole is None else whole.split("\n")
                out = set(gone or ())
                n_lines.append(len(own))
                n_removed.append(len(out))
                kept.append(whole if not out else "\n".join(x for i, x in enumerate(own) if i not in out))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), batch.column("n_links"), pa.array(kept, pa.string())], ["_row", "n_lines", "n_removed", "n_links", "kept"])

    full = texts.join(found, "_rid", "left").select("_row", "_text", "gone", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    kinds = [StructField(n, LongType()) for n in ("n_lines", "n_removed", "n_links")]
    return beside(full.mapInArrow(run, StructType([full.schema["_row"], *kinds, StructField("kept", StringType())])), "n_lines", "n_removed", "n_links", "kept")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each document, by :func:`dedup_lines` over lines of every length; the least doc_id is earliest."""
    found = dedup_lines(table(spark, sf_dir, "documents"), order="doc_id")
    return found.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB: every deletion of every distinct line, equal ones joined, classes as the closure of the links. doc_id is unique.
OP9_SQL = r"""
WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM s)),
e AS (SELECT doc_id, i, x FROM p WHERE NOT regexp_full_match(x, '[	- ]*')),
t AS (SELECT x, min(doc_id * 1000000 + i) AS at FROM e GROUP BY x),
v AS (SELECT x, k, substr(x, 1, k - 1) || substr(x, k + 1) AS y FROM (SELECT x, unnest(range(1, length(x) + 1)) AS k FROM t)),
o AS (SELECT DISTINCT v.x AS a, t.x AS b FROM v JOIN t ON t.x = v.y UNION SELECT DISTINCT f.x AS a, g.x AS b FROM v f JOIN v g ON f.y = g.y AND f.k = g.k WHERE f.x <> g.x),
l AS (SELECT a, b FROM o UNION SELECT b, a FROM o),
c AS (SELECT DISTINCT a AS x, a AS r FROM l UNION SELECT c.x, l.b FROM c JOIN l ON l.a = c.r),
h AS (SELECT t.x, coalesce(min(u.at), any_value(t.at)) AS head, any_value(coalesce(d.n, 0)) AS links FROM t LEFT JOIN c ON c.x = t.x LEFT JOIN t u ON u.x = c.r LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) d ON d.a = t.x GROUP BY t.x),
m AS (SELECT p.doc_id, p.i, p.x, h.head IS NOT NULL AND h.head <> p.doc_id * 1000000 + p.i AS gone, coalesce(h.links, 0) AS links FROM p LEFT JOIN h ON h.x = p.x),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, sum(links) AS n_links, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, sha256(kept) AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)
"""
