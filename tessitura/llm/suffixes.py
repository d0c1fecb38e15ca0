"""Exact substring dedup: bytes covered by a 200-byte string that also starts elsewhere in the corpus are cut out.

Sorting every suffix of a corpus would exchange each byte hundreds of times over. Instead:

1. Anchors. Of the GRAM-byte strings in a window of LENGTH bytes the one with the least hash (leftmost, if equal) is the
   window's anchor: equal windows have equal anchors at equal places. The windows of one anchor are consecutive, so a
   document becomes about one record for each 76 bytes: the anchor's hash, and a hash of the segment that its windows
   span.
2. Anchors that occur once hold no repeated window and go.
3. The others' distinct segments are fetched from the texts, one occurrence of each, and a second one of a segment that
   occurs more than once. They are dealt out by anchor, and their suffixes are sorted by deep-shallow sorting: multikey
   quicksort to SHALLOW bytes (64-bit characters, all groups of a task at once), then a blind trie for each group of
   suffixes that still agree. Two suffixes that agree for LENGTH bytes are repeats; the length of their common prefix
   gives the run of windows that repeat with them, which are then left out of later tries (one of each such pair stays
   to stand for both). So all that is removed has been compared byte by byte, but for the third and later occurrences of
   one segment, which 124 bits of hash tell to be the same.
4. An anchor with more than HOT different segments would make one task's group too large. Its segments are cut finer,
   into single windows that are dealt out by their own content, and sorted like the others: one occurrence of each
   distinct window that repeats, and a second one.

Each document's runs are united and cut out. Strings are judged on the input; nothing crosses documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..session import ship
from .common import beside, numbered, packed, partitions_for, saved, table
from .textkit import gram_hash, mix, prefix_hash, slices, span_hash, utf8

LENGTH, GRAM, SHALLOW, HOT = 200, 48, 32, 20_000
_PLACE = 21
_CHUNK = 1 << 20
_FIRST, _COUNT = (1 << 40) - 1, (1 << 12) - 1


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first window's start in the row, windows, anchor's distance from it, anchor's hash, segment's hash)."""
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefix = prefix_hash(raw)
    at = np.arange(n - gram + 1)
    hashes = gram_hash(prefix, gram)
    # The hash's high bits, then the place: of equal ones the leftmost is least.
    keyed = (hashes >> np.uint64(_PLACE) << np.uint64(_PLACE)) | at.astype(np.uint64)
    w = length - gram + 1
    padded = np.full(-(-len(keyed) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keyed)] = keyed
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts])
    anchor = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    valid = np.zeros(starts, bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= length:
            valid[a : b - length + 1] = True
    change = np.ones(starts, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & change)
    stop = np.ones(starts, bool)
    stop[:-1] = (anchor[1:] != anchor[:-1]) | ~valid[1:]
    last = np.flatnonzero(valid & stop)
    row = np.searchsorted(offsets, first, "right") - 1
    many, ahead_by = last - first + 1, anchor[first] - first
    segment = span_hash(prefix, first, last + length) ^ mix((many * 4096 + ahead_by).astype(np.uint64))
    return row, first - offsets[row], many, ahead_by, span_hash(prefix, anchor[first], anchor[first] + gram), segment


def _anchored(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(_rid, loc, kh, sh) of each anchor of rows (_rid, text); loc packs start, windows and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = np.asarray(batch.column("_rid"))
            for i, j, part, at in slices(*utf8(batch.column("text")), _CHUNK):
                # A longer text goes chunk by chunk; a chunk's windows start in it and reach into the next.
                jobs = [(0, part, at)] if len(part) <= _CHUNK else [(c, part[c : c + _CHUNK + length - 1], None) for c in range(0, max(1, len(part) - length + 1), _CHUNK)]
                for base, piece, piece_at in jobs:
                    row, start, many, ahead, kh, sh = anchors(piece, np.array([0, len(piece)]) if piece_at is None else piece_at, length, gram)
                    if len(row):
                        loc = (start + base) | many << 40 | ahead << 52
                        yield pa.RecordBatch.from_arrays([pa.array(rid[i:j][row]), pa.array(loc), pa.array(kh.view(np.int64)), pa.array(sh.view(np.int64))], ["_rid", "loc", "kh", "sh"])

    return rows.mapInArrow(run, "_rid long, loc long, kh long, sh long")


# Deep-shallow sorting ------------------------------------------------------------------------------------------------


class BlindTrie:
    """A Patricia trie over suffixes that stores branching bytes only; one comparison with the text an insertion."""

    __slots__ = ("depth", "root", "text")

    def __init__(self, text: bytes, depth: int) -> None:
        self.text, self.depth, self.root = text, depth, None

    def insert(self, start: int) -> tuple[int, int]:
        """(common prefix with the suffix that shares the longest one, that suffix); depth if they agree all through.

        A suffix that agrees is not inserted again. Nodes are [depth, {byte: node or start}].
        """
        text, depth = self.text, self.depth
        if self.root is None:
            self.root = start
            return 0, -1
        node = self.root
        while not isinstance(node, int):  # the blind descent
            node = node[1].get(text[start + node[0]]) if text[start + node[0]] in node[1] else next(iter(node[1].values()))
        leaf = node
        common = common_prefix(text, start, leaf, depth)
        if common >= depth:
            return depth, leaf
        parent, byte, node = None, 0, self.root
        while not isinstance(node, int) and node[0] < common:
            parent, byte = node, text[start + node[0]]
            node = node[1][byte]
        if not isinstance(node, int) and node[0] == common:
            node[1][text[start + common]] = start
        else:
            split = [common, {text[leaf + common]: node, text[start + common]: start}]
            if parent is None:
                self.root = split
            else:
                parent[1][byte] = split
        return common, leaf

    def order(self) -> list[int]:
        """The inserted suffixes in lexicographic order."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def common_prefix(text: bytes, i: int, j: int, most: int) -> int:
    a, b = text[i : i + most], text[j : j + most]
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def shallow(words: np.ndarray, group: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, group) of the suffixes that share their first depth bytes with another of their group, in sorted order.

    Multikey quicksort with 8-byte characters: each pass orders every group by its next character and splits it by
    value; groups of one are done.
    """
    live = np.arange(len(start))
    for d in range(-8, depth, 8):
        if d >= 0:
            key = words[start[live] + d]
            order = np.lexsort((key, group))
            live, group, key = live[order], group[order], key[order]
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]) if len(live) else np.zeros(0, bool)
        else:
            order = np.argsort(group, kind="stable")
            live, group = live[order], group[order]
            new = np.concatenate([[True], group[1:] != group[:-1]]) if len(live) else np.zeros(0, bool)
        group = np.cumsum(new)
        size = np.bincount(group)
        keep = size[group] > 1
        live, group = live[keep], group[keep]
    return live, group


def repeats(texts: list[bytes], windows: np.ndarray, ahead: np.ndarray, anchor: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each segment the runs (first byte, byte after) of its windows that occur in another segment of its anchor.

    Segment i has windows[i] windows, its text spans them, and its anchor is ahead[i] bytes after its start. Equal
    windows have their anchors at equal places, so suffixes are compared only within (anchor, distance).
    """
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts])
    text = b"".join(texts) + bytes(8)
    base = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(text, np.uint8)
    words = np.zeros(len(raw) - 7, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | raw[k : len(raw) - 7 + k]
    segment = np.repeat(np.arange(len(texts)), windows)
    step = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = base[segment] + step
    distance = ahead[segment] - step
    _, dense = np.unique(anchor, return_inverse=True)
    # Groups ascend by anchor, then by falling distance, which is from left to right.
    live, group = shallow(words, dense[segment] * 4096 + (4095 - distance), start, min(SHALLOW, length // 8 * 8))
    # After a split, a group's number still ascends with (anchor, place); walk the groups in that order.
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    edges = np.append(begin, len(group)).tolist()
    starts, owners, stop = start[live].tolist(), segment[live].tolist(), base[1:].tolist()
    induced = [-1] * len(texts)  # windows up to here repeat with a segment that stands for this one
    first = base[:-1].tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        active = [k for k in range(a, b) if starts[k] > induced[owners[k]]]
        if len(active) < 2:
            continue
        trie, owner_of = BlindTrie(text, length), {}
        for k in active:
            s, own = starts[k], owners[k]
            common, leaf = trie.insert(s)
            if common < length:
                owner_of[s] = own
                continue
            other = owner_of[leaf]
            run = common_prefix(text, s, leaf, min(stop[own] - s, stop[other] - leaf))
            induced[own] = s + run - length
            out[own].append((s - first[own], s - first[own] + run))
            out[other].append((leaf - first[other], leaf - first[other] + run))
    return out


#: Bytes of segments that are sorted at once.
_SORTED = 1 << 20


def _sort_segments(segments: DataFrame, length: int) -> DataFrame:
    """(kh, sh, _rid, a, b): what repeats of the segments of :func:`_fetch`, sorted by g.

    A segment that was sent twice gives (kh, sh) if all of it repeats; any other segment the runs of bytes that do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list) -> pa.RecordBatch:
            found = repeats([r[8] for r in rows], np.array([r[5] for r in rows]), np.array([r[6] for r in rows]), np.array([r[0] for r in rows], np.int64), length)
            cut = []
            for (_, kh, sh, rid, p, _, _, single, seg), runs in zip(rows, found, strict=True):
                own = joined(runs)
                if not single and own == [(0, len(seg))]:
                    cut.append((kh, sh, None, None, None))
                else:
                    cut += [(None, None, rid, p + a, p + b) for a, b in own]
            return pa.RecordBatch.from_arrays([pa.array([c[i] for c in cut], pa.int64()) for i in range(5)], ["kh", "sh", "_rid", "a", "b"])

        held: list = []
        size = 0
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= _SORTED and r[0] != held[-1][0]:  # whole groups only
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[8])
        if held:
            yield flush(held)

    return segments.select(*_SEGMENT).mapInArrow(run, "kh long, sh long, _rid long, a long, b long")


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint spans in order; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_SEGMENT = ("g", "kh", "sh", "_rid", "p", "many", "ahead", "single", "seg")


def _fetch(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The segments wanted (_rid, g, kh, sh, loc, single, alone) with their place and bytes.

    They are taken from texts (_rid, _text), or from segments that were fetched before and hold them (_rid, p, many, seg).
    g: the group to sort it in; single: whether it is the only occurrence; alone: whether its group has no other segment
    than it and its second occurrence. Then the suffix at its first window is sorted for all (many is 1), since the two
    suffixes' common prefix tells how much of the segment repeats.
    """
    by_text = wanted.groupBy("_rid").agg(F.collect_list(F.struct("g", "kh", "sh", "loc", "single", "alone")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("_text"))
            rids, bases, held = (batch.column(c).to_pylist() for c in ("_rid", "base", "held"))
            for i in range(batch.num_rows):
                data = raw[offsets[i] : offsets[i + 1]].tobytes()
                out = []
                for x in batch.column("wanted")[i].as_py():
                    loc = x["loc"]
                    p, many, ahead = loc & _FIRST, loc >> 40 & _COUNT, loc >> 52
                    if not bases[i] <= p < bases[i] + held[i]:
                        continue
                    out.append((x["g"], x["kh"], x["sh"], rids[i], p, 1 if x["alone"] else many, ahead, x["single"], data[p - bases[i] : p - bases[i] + many - 1 + length]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                for s in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out[s : s + 4096]], t) for k, t in enumerate(kinds)], list(_SEGMENT))

    again = "seg" in texts.columns
    source = texts.select("_rid", F.col("seg" if again else "_text").alias("_text"), (F.col("p") if again else F.lit(0).cast("long")).alias("base"), (F.col("many").cast("long") if again else F.lit(_FIRST).cast("long")).alias("held"))
    return source.join(by_text, "_rid").select("_rid", "_text", "base", "held", "wanted").mapInArrow(run, "g long, kh long, sh long, _rid long, p long, many int, ahead int, single boolean, seg binary")


def _sorted(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    dealt = _fetch(texts, wanted, length).repartition(partitions_for(texts.sparkSession), "g").sortWithinPartitions("g")
    return saved(_sort_segments(dealt, length))


def _windows(segments: DataFrame, length: int) -> DataFrame:
    """(kh, sh, _rid, a, single) of each window of the segments of :func:`_fetch`; kh and sh: hashes of its halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = np.asarray(batch.column("many")).astype(np.int64)
            data = batch.column("seg")
            raw = np.frombuffer(data.buffers()[2], np.uint8)
            ends = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4).astype(np.int64)
            own = np.repeat(np.arange(len(data)), many)
            step = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            start = ends[own] + step - ends[0]
            prefix = prefix_hash(raw[ends[0] : ends[-1]])
            half = length // 2
            pick = lambda name: np.asarray(batch.column(name))[own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(span_hash(prefix, start, start + half).view(np.int64)), pa.array(span_hash(prefix, start + half, start + length).view(np.int64)), pa.array(pick("_rid")), pa.array(pick("p") + step), pa.array(np.asarray(batch.column("single").to_pylist(), bool)[own])],
                ["kh", "sh", "_rid", "a", "single"],
            )

    return segments.mapInArrow(run, "kh long, sh long, _rid long, a long, single boolean")


def _twice(one: str, two: str) -> Column:
    """An array of the first and the second occurrence, as structs (_rid, loc)."""
    return F.explode(F.array(F.col(one), F.col(two)))


def cut_repeats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """keep, n_bytes, spans (removed runs of bytes as array<struct<a, b>>, in order) and kept (the rest, binary).

    Null and empty texts and texts under `length` bytes keep all they have. Equal texts of at least `length` bytes are
    repeats of each other and lose everything. A text that repeats within itself is cut as well. Repeated and null ids
    don't matter: rows are told apart by their place. No rows give no rows. The three names get an underscore before
    them where keep has them.
    """
    ship(docs.sparkSession)
    texts = numbered(packed(docs, keep, text))
    found = saved(_anchored(texts.select("_rid", F.col("_text").alias("text")), length, gram))
    # Sides of joins by anchor are written first: a join of two plain exchanges can be split where an anchor is hot.
    again = saved(found.groupBy("kh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kh"))
    found = saved(found.join(again, "kh", "left_semi"))
    place = F.struct("_rid", "loc")
    segments = saved(found.groupBy("kh", "sh").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("one"), F.max(place).alias("two")))
    several = saved(segments.groupBy("kh").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    grouped = segments.join(several, "kh", "left").withColumn("hot", F.coalesce(F.col("n") > hot, F.lit(False)))
    any_hot = several.where(F.col("n") > hot).limit(1).count()
    once = grouped.where("c = 1").select("kh", "sh", "hot", "n", F.lit(True).alias("single"), F.col("one").alias("at"))
    more = grouped.where("c > 1").select("kh", "sh", "hot", "n", F.lit(False).alias("single"), _twice("one", "two").alias("at"))
    # A hot anchor's repeated segments are sorted in groups of their own; its windows follow one by one.
    wanted = once.where("not hot").union(more).select("at._rid", F.when(F.col("hot"), F.xxhash64("kh", "sh")).otherwise(F.col("kh")).alias("g"), "kh", "sh", "at.loc", "single", (~F.col("single") & (F.col("hot") | F.col("n").isNull())).alias("alone"))
    sorted_ = _sorted(texts, wanted, length)
    first = F.col("loc").bitwiseAND(F.lit(_FIRST))
    many = F.shiftright("loc", 40).bitwiseAND(F.lit(_COUNT))
    whole = found.join(sorted_.where("kh is not null").select("kh", "sh"), ["kh", "sh"], "left_semi").select("_rid", first.alias("a"), (first + many + (length - 1)).alias("b"))
    runs = whole.union(sorted_.where("kh is null").select("_rid", "a", "b"))
    if any_hot:
        fine = grouped.where("hot").select("one._rid", F.lit(0).cast("long").alias("g"), "kh", "sh", "one.loc", (F.col("c") == 1).alias("single"), F.lit(False).alias("alone"))
        fine = saved(_fetch(texts, fine, length))
        windows = saved(_windows(fine, length))
        place = F.struct("_rid", (F.col("a") + F.lit(1 << 40)).alias("loc"))  # one window, no distance
        again = windows.groupBy("kh", "sh").agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("asked"), F.min(place).alias("one"), F.max(place).alias("two")).where("n > 1 and asked")
        pairs = again.select("kh", "sh", _twice("one", "two").alias("at")).select("at._rid", F.col("kh").alias("g"), "kh", "sh", "at.loc", F.lit(False).alias("single"), F.lit(True).alias("alone"))
        equal = _sorted(fine, pairs, length).where("kh is not null").select("kh", "sh").distinct()
        ends = windows.where("single").join(equal, ["kh", "sh"], "left_semi").select("_rid", "a", (F.col("a") + length).alias("b"))
        runs = runs.union(ends)
    runs = runs.groupBy("_rid").agg(F.collect_list(F.struct("a", "b")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("_text"))
            spans, kept = [], []
            for i, r in enumerate(batch.column("runs").to_pylist()):
                data = raw[offsets[i] : offsets[i + 1]].tobytes()
                own = joined([(x["a"], x["b"]) for x in r or ()])
                spans.append([{"a": a, "b": b} for a, b in own])
                at, parts = 0, []
                for a, b in own:
                    parts.append(data[at:a])
                    at = b
                kept.append(b"".join([*parts, data[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary())], ["_row", "n_bytes", "spans", "kept"]
            )

    rows = texts.join(runs, "_rid", "left").select("_row", "_text", "runs")
    out = StructType([rows.schema["_row"], *_OUT.fields])
    return beside(rows.mapInArrow(run, out), "n_bytes", "spans", "kept")


_OUT = StructType([StructField("n_bytes", LongType()), StructField("spans", ArrayType(StructType([StructField("a", LongType()), StructField("b", LongType())]))), StructField("kept", BinaryType())])


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each document, by :func:`cut_repeats` with its defaults; a null text counts as empty."""
    cut = cut_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB: every 200-byte string by its md5, over hex text, and the gaps between covered runs put together again.
OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS p FROM d WHERE n >= 200)),
c AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM c),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
s AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY doc_id, run),
t AS (SELECT doc_id, count(*) AS spans, CAST(sum(b - a) AS BIGINT) AS gone, max(b) AS last FROM s GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT doc_id, coalesce(last, 0), n FROM d LEFT JOIN t USING (doc_id)),
r AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(t.gone, 0) AS n_removed, coalesce(t.spans, 0) AS n_spans, sha256(unhex(r.kept)) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) JOIN r USING (doc_id)
"""
