"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows.

A window (10 consecutive words of an item, or all of a shorter one) occurs in a document only if all its word shingles
do. With containment 1 the necessary prefix of a window, its shingles in order of rarity, is a single shingle: the one
that the fewest documents hold, counted over the whole corpus. So

1. the benchmark's windows and shingles are made, and one scan of the documents counts its shingles by document;
2. each window is indexed by its rarest shingle and that shingle's place in it; windows with a shingle that no document
   holds can't occur and go;
3. a second scan looks up the documents' shingles. A match fixes where the window would start, so the length and
   positional bounds are tests of that place against the document's ends, then the words are compared, hash and bytes.

Only the benchmark's index is sent to the executors, BLOCK windows at a time: a larger benchmark is split into blocks
by window, each block is looked up in a scan of its own, and a document's hits are united afterwards. The documents
are not exchanged, and a passage that a third of them share costs each of them its own lookups only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import free_name, numbered, table
from .textkit import WORD_BYTES, shingle_hash, slices, utf8, words

WINDOW, SHINGLE = 10, 5
#: Windows of the benchmark that are held on an executor at once: about 40 MB.
BLOCK = 1 << 17
#: Slots of the table that most shingles are turned away by.
SLOTS = 1 << 20


@dataclass
class Windows:
    """Windows of one block: their items, words' hashes (padded with 0) and text, words joined by spaces."""

    item: list[str]
    size: np.ndarray
    word: np.ndarray
    text: list[bytes]


def item_windows(pairs: Iterator[tuple[str, str]], window: int = WINDOW) -> Iterator[tuple[str, bytes]]:
    """(item, window's text) of each distinct window of each item."""
    for item, text in pairs:
        raw = np.frombuffer(text.encode(), np.uint8)
        _, _, start, end = words(raw, np.array([0, len(raw)]))
        low = WORD_BYTES[raw].tobytes()
        found = [low[a:b] for a, b in zip(start, end, strict=True)]
        size = min(window, len(found))
        for k in range(len(found) - size + 1) if size else ():
            yield item, b" ".join(found[k : k + size])


def block_of(rows: list[tuple[str, bytes]], window: int = WINDOW) -> Windows:
    joined = [t for _, t in rows]
    raw = np.frombuffer(b"".join(joined), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in joined])]).astype(np.int64)
    row, word, _, _ = words(raw, offsets)
    size = np.bincount(row, minlength=len(rows))
    table_ = np.zeros((len(rows), window), np.uint64)
    table_[row, np.arange(len(row)) - np.searchsorted(row, np.arange(len(rows)))[row]] = word
    return Windows([i for i, _ in rows], size, table_, joined)


def window_shingles(w: Windows, shingle: int = SHINGLE) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, window, place, hash) for each shingle size k that is needed: `shingle`, or a shorter window's own size."""
    out = []
    for k in range(1, shingle + 1):
        who = np.flatnonzero(w.size >= shingle) if k == shingle else np.flatnonzero(w.size == k)
        if not len(who):
            continue
        windows, places, hashes = [], [], []
        for at in range(w.word.shape[1] - k + 1):
            there = who[w.size[who] >= at + k]
            if len(there):
                windows.append(there)
                places.append(np.full(len(there), at))
                # Column by column, shingle_hash sees each window's k words as one run.
                hashes.append(shingle_hash(w.word[there, at : at + k].ravel(), k)[::k])
        out.append((k, np.concatenate(windows), np.concatenate(places), np.concatenate(hashes)))
    return out


class Lookup:
    """Sorted keys behind a table of their low bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.slots = np.zeros(SLOTS, bool)
        self.slots[self.keys & np.uint64(SLOTS - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in hashes, places in keys) of the hashes that are keys."""
        maybe = np.flatnonzero(self.slots[hashes & np.uint64(SLOTS - 1)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        same = self.keys[at] == hashes[maybe]
        return maybe[same], at[same]


def count_shingles(docs: DataFrame, keys: dict[int, np.ndarray], text: str) -> dict[int, dict[int, int]]:
    """How many documents hold each of the benchmark's shingles; at most one row for each comes back from a task."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = {k: Lookup(v) for k, v in shared.value.items()}
        totals = {k: np.zeros(len(v.keys), np.int64) for k, v in lookups.items()}
        for batch in batches:
            for _, _, part, at in slices(*utf8(batch.column(0))):
                row, word, _, _ = words(part, at)
                for k, lookup in lookups.items():
                    found = shingle_hash(word, k)
                    if not len(found):
                        continue
                    place, key = lookup.find(found)
                    place_ok = row[place] == row[place + k - 1]
                    once = np.unique(np.stack([row[place[place_ok]], key[place_ok]], 1), axis=0)
                    totals[k] += np.bincount(once[:, 1], minlength=len(lookup.keys))
        for k, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array(lookups[k].keys[seen].view(np.int64)), pa.array(total[seen])], ["k", "h", "n"])

    counted = docs.select(text).mapInArrow(run, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
    out: dict[int, dict[int, int]] = {}
    for r in counted.collect():  # no more rows than the block has shingles
        out.setdefault(r.k, {})[r.h & (1 << 64) - 1] = r.n
    return out


@dataclass
class Index:
    """Windows by their rarest shingle, for one shingle size: for key i the entries ends[i] to ends[i + 1]."""

    lookup: Lookup
    ends: np.ndarray
    window: np.ndarray
    place: np.ndarray


def prefix_index(w: Windows, counts: dict[int, dict[int, int]], shingle: int = SHINGLE) -> dict[int, Index]:
    out = {}
    for k, window, place, hashes in window_shingles(w, shingle):
        held = counts.get(k, {})
        n = np.array([held.get(int(h), 0) for h in hashes], np.int64)
        order = np.lexsort((place, hashes, n, window))
        first = order[np.concatenate([[True], np.diff(window[order]) > 0])]
        first = first[n[first] > 0]
        if len(first):
            first = first[np.argsort(hashes[first], kind="stable")]
            lookup = Lookup(hashes[first])
            out[k] = Index(lookup, np.searchsorted(hashes[first], np.append(lookup.keys, np.uint64(0xFFFFFFFFFFFFFFFF))), window[first], place[first])
            out[k].ends[-1] = len(first)
    return out


def hits(raw: np.ndarray, offsets: np.ndarray, w: Windows, index: dict[int, Index]) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """(words of each row, (row, first word, word after the last, window) of each occurrence; words count from the row's first)."""
    row, word, start, end = words(raw, offsets)
    n = np.bincount(row, minlength=len(offsets) - 1)
    begin = np.concatenate([[0], np.cumsum(n)])
    low, out = None, []
    for k, own in index.items():
        found = shingle_hash(word, k)
        if not len(found):
            continue
        place, key = own.lookup.find(found)
        many = own.ends[key + 1] - own.ends[key]
        entry = np.repeat(own.ends[key], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        window, at = own.window[entry], np.repeat(place, many) - own.place[entry]
        in_row = row[np.repeat(place, many)]
        inside = (at >= begin[in_row]) & (at + w.size[window] <= begin[in_row + 1])  # length and positional bounds
        window, at, in_row = window[inside], at[inside], in_row[inside]
        same = np.ones(len(window), bool)
        for j in range(w.word.shape[1]):
            there = np.flatnonzero(same & (w.size[window] > j))
            same[there] = word[at[there] + j] == w.word[window[there], j]
        for x, a, r in zip(window[same], at[same], in_row[same], strict=True):
            low = WORD_BYTES[raw].tobytes() if low is None else low
            if b" ".join(low[start[i] : end[i]] for i in range(a, a + w.size[x])) == w.text[x]:
                out.append((int(r), int(a - begin[r]), int(a - begin[r] + w.size[x]), int(x)))
    return n, out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>"


def _kept(rows: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {rows.schema[n].dataType.simpleString()}, " for n in names)


def _scan(rows: DataFrame, names: list[str], w: Windows, index: dict[int, Index]) -> DataFrame:
    """rows (names, _text) as (names, n_words, starts, ends, items): hit runs of words, and items with windows in them."""
    shared = rows.sparkSession.sparkContext.broadcast((w, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_w, own_index = shared.value
        for batch in batches:
            counts, spans, items = [], [], []
            for i, j, part, at in slices(*utf8(batch.column("_text"))):
                n, found = hits(part, at, own_w, own_index)
                mine: dict[int, tuple[list, set]] = {}
                for r, a, b, x in found:
                    s, ids = mine.setdefault(r, ([], set()))
                    s.append((a, b))
                    ids.add(own_w.item[x])
                counts.append(n)
                spans += [united(mine[r][0]) if r in mine else [] for r in range(j - i)]
                items += [sorted(mine[r][1]) if r in mine else [] for r in range(j - i)]
            counts_all = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(counts_all, pa.int64()), pa.array([[a for a, _ in s] for s in spans], kind), pa.array([[b for _, b in s] for s in spans], kind), pa.array(items, pa.list_(pa.string()))],
                [*names, "n_words", "starts", "ends", "items"],
            )

    return rows.mapInArrow(run, _kept(rows, names) + _FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The columns of keep with n_words, starts, ends and items, for each row of docs (an underscore before names that keep has).

    starts and ends: maximal runs of hit words, counted from 0. items: the distinct ids, as text and sorted, of the
    items with a window in the document. Null texts have no words; items without words have no window; a null id is
    the empty text; items that share an id count once. An empty benchmark hits nothing.
    """
    ship(docs.sparkSession)
    names = ["_rid", "_row"]
    kept = docs.select(*keep)
    rows = numbered(docs.select(F.struct(*keep).alias("_row"), F.col(text).alias("_text")))
    told = ["_row.*", *[F.col(c).alias(free_name(kept, c)) for c in ("n_words", "starts", "ends", "items")]]
    pairs = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(item_windows(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), window))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], ["i", "w"])

    made = pairs.mapInArrow(make, "i string, w binary").distinct()
    blocks = max(1, -(-made.count() // block))
    parts = []
    for b in range(blocks):
        # By hash, a block may have a few more windows than its share; it stays near the bound.
        own = made if blocks == 1 else made.where(F.pmod(F.xxhash64("i", "w"), F.lit(blocks)) == b)
        w = block_of(sorted((r.i, bytes(r.w)) for r in own.collect()), window)
        keys = {k: np.unique(h) for k, _, _, h in window_shingles(w, shingle)}
        counts = count_shingles(rows.withColumnRenamed("_text", "text").select("text"), keys, "text") if keys else {}
        parts.append(_scan(rows, names, w, prefix_index(w, counts, shingle)))
    if blocks == 1:
        return parts[0].select(*told)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.groupBy("_rid").agg(F.first("_row").alias("_row"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            spans = [united(list(zip(a, b, strict=True))) for a, b in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], batch.column("n_words"), pa.array([[a for a, _ in s] for s in spans], kind), pa.array([[b for _, b in s] for s in spans], kind), batch.column("items")], [*names, "n_words", "starts", "ends", "items"])

    return every.select(*names, "n_words", "starts", "ends", "items").mapInArrow(unite, _kept(rows, names) + _FOUND).select(*told)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row for each document, by :func:`decontaminate` with its defaults; a document without hits has the empty list's digest."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


#: DuckDB: every window of every item against every run of as many words of every document.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
il AS (SELECT item_id, w, least(10, len(w)) AS l FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, l, array_to_string(w[s + 1 : s + l], ' ') AS g FROM (SELECT item_id, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM il)),
dl AS (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l),
hit AS (SELECT dl.doc_id, dl.s, dl.l, iw.item_id FROM dl JOIN iw ON iw.l = dl.l AND iw.g = array_to_string(dl.w[dl.s + 1 : dl.s + dl.l], ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
