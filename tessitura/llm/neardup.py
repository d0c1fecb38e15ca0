"""MinHash near-duplicates: BagMinHash signatures of word shingles with their counts, bands, exact verification.

BagMinHash. A document is a multiset of shingles. Each shingle has a Poisson process over time, weight and register,
seeded by the shingle alone; a document sees the points whose weight is up to the shingle's count, and a register of its
signature is the earliest time seen there. Two documents agree in a register with a probability equal to their weighted
Jaccard similarity (sum of least over sum of greatest counts). The weight axis is discretised to whole counts and cut
into dyadic levels (0, 1], (1, 2], (2, 4], ... with a process each at the level's rate; a level below the count is taken
whole, the level that holds it is thinned by the points' weight. Points come in order of time and end at a horizon at
which all registers are filled but for a small chance; then the horizon is doubled. So a document costs a point or two
a shingle and a few for each register, not shingles times registers.

Links. Equal texts are one node. Nodes that share a band (ROWS registers) are candidates: each is verified against its
bucket's centre, the node with the most company over all its buckets (of near copies, that is the original rather than
another copy), the multiset overlap counted exactly on the texts. Nodes linked that way are in one class. Where a
bucket's nodes still are in several classes, each row is compared with those of other classes within the bucket by a
prefix-filtered set join: rows' elements in order of rarity, candidates from the prefixes that two similar rows must
share, overlaps counted exactly, and one link for two classes, after which they count as one. A bucket is dealt out in
blocks of a bounded size; only the rows outside its largest class are sent to each block. So every pair in any bucket is
in one class or has been counted, and no group's pairs are listed. At a similarity of 0.8, a pair shares none of the 40
bands of 5 with probability 1.2e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import discard, numbered, partitions_for, saved, table
from .links import components
from .textkit import mix, shingles, slices, utf8, words

SIMILARITY, SHINGLE, BANDS, ROWS = 0.8, 5, 40, 5
#: Elements (shingles with repetitions) of a bucket's rows that make a block: 8 bytes each.
BLOCK = 1 << 20
#: Registers are filled by GROUPS processes, so that a text of few shingles takes fewer steps.
GROUPS = 4
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def multiset(row: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count), each pair once."""
    key = mix(row.astype(np.uint64) * _GOLDEN + np.uint64(1)) ^ shingle
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    return row[order[first]], shingle[order[first]], count


def _points(row: np.ndarray, seed: np.ndarray, rate: float, base: np.ndarray, width: int, horizon: np.ndarray, cell: tuple[int, np.ndarray] | None, out: np.ndarray) -> None:
    """Lowers out[row, register] to the times of the processes' points up to the rows' horizons.

    cell: (span of the level, number of its unit weights that are seen) if only some are.
    """
    state, t = seed.copy(), np.zeros(len(seed))
    most = horizon[row]
    seen = None if cell is None else cell[1]
    while len(state):
        state += _GOLDEN
        draw = mix(state.copy())
        t = t - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        live = np.flatnonzero(t <= most)
        if len(live) < len(state):
            state, t, row, base, most, draw = state[live], t[live], row[live], base[live], most[live], draw[live]
            seen = None if seen is None else seen[live]
        place = mix(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        register = base + ((place >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
        if seen is None:
            np.minimum.at(out, (row, register), t)
        else:
            unit = ((place & np.uint64(0xFFFFFFFF)) * np.uint64(cell[0]) >> np.uint64(32)).astype(np.int64)
            ok = unit < seen
            np.minimum.at(out, (row[ok], register[ok]), t[ok])


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """Signature of each row's multiset; rows without shingles keep infinity."""
    out = np.full((rows, registers), np.inf)
    total = np.bincount(row, count, rows)
    horizon = np.where(total > 0, (np.log(registers) + 6.0) / np.maximum(total, 1), 0.0)
    width = registers // GROUPS
    todo = np.ones(len(row), bool)
    while todo.any():
        r0, s0, c0 = row[todo], shingle[todo], count[todo]
        level, span = 0, 1
        while True:
            low = 0 if level == 0 else span  # the level is (low, low + span]
            there = np.flatnonzero(c0 > low)
            if not len(there):
                break
            r, s, c = r0[there], s0[there], c0[there]
            r, c = np.tile(r, GROUPS), np.tile(c, GROUPS)
            group = np.repeat(np.arange(GROUPS), len(there))
            seed = mix(np.tile(s, GROUPS) + (group.astype(np.uint64) * np.uint64(64) + np.uint64(level + 1)) * np.uint64(0xD1342543DE82EF95))
            full = c >= low + span
            rate = float(width * span)
            for which, cell in ((full, None), (~full, (span, (c - low)[~full]))):
                if which.any():
                    _points(r[which], seed[which], rate, group[which] * width, width, horizon, cell, out)
            level, span = level + 1, 1 if level == 0 else span * 2
        open_rows = np.isinf(out).any(1) & (total > 0)
        horizon = np.where(open_rows, horizon * 2, horizon)
        todo = open_rows[row]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) 64-bit keys."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, bits.shape[:2]).copy()
    for i in range(rows):
        key = mix(key ^ bits[:, :, i])
    return key


def _signed(rows: DataFrame, bands: int, per_band: int, shingle: int) -> DataFrame:
    """rows (_rid, doc_id, h1, h2, text) with the text as its band keys; none for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, filled = [], []
            for i, j, part, at in slices(*utf8(batch.column("text")), 1 << 20):
                row, word, _, _ = words(part, at)
                row, s = shingles(row, word, j - i, shingle)
                row, s, count = multiset(row, s)
                signature = signatures(row, s, count, j - i, bands * per_band)
                keys.append(band_keys(signature, bands, per_band))
                filled.append(~np.isinf(signature[:, 0]))
            all_keys = np.concatenate(keys) if keys else np.zeros((0, bands), np.uint64)
            ok = np.concatenate(filled) if filled else np.zeros(0, bool)
            ends = np.concatenate([[0], np.cumsum(np.where(ok, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(all_keys[ok].view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], ["_rid", "doc_id", "h1", "h2", "bands"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, bands array<long>")


def overlaps(a: pa.Array, b: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard similarity of the texts a[i] and b[i], counted exactly; 0 if neither has a word."""
    n = len(a)
    found = []
    for column in (a, b):
        raw, offsets = utf8(column)
        rows_, hashes = [], []
        for i, j, part, at in slices(raw, offsets):
            row, word, _, _ = words(part, at)
            row, s = shingles(row, word, j - i, shingle)
            rows_.append(row + i)
            hashes.append(s)
        row, s = (np.concatenate(rows_), np.concatenate(hashes)) if rows_ else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        r, s, c = multiset(row, s)
        found.append((r, mix(r.astype(np.uint64) * _GOLDEN + np.uint64(1)) ^ s, c))
    (ra, ka, ca), (rb, kb, cb) = found  # keys ascend, as multiset sorts by them
    at = np.searchsorted(kb, ka)
    hit = np.flatnonzero(at < len(kb))
    hit = hit[kb[at[hit]] == ka[hit]]
    both = np.bincount(ra[hit], np.minimum(ca[hit], cb[at[hit]]), n)
    either = np.bincount(ra, ca, n) + np.bincount(rb, cb, n) - both
    return np.where(either > 0, both / np.maximum(either, 1), 0.0)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The rows (a, b) of pairs whose texts (_rid, text) have at least that similarity."""
    left = pairs.join(texts.select(F.col("_rid").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("_rid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(overlaps(batch.column("ta"), batch.column("tb"), shingle) >= similarity - 1e-12)
            yield batch.select(["a", "b"]).filter(keep)

    return both.mapInArrow(run, "a long, b long")


def _elements(rows: DataFrame, shingle: int) -> DataFrame:
    """(_rid, size, elements) of rows (_rid, text): 64-bit hashes of (shingle, how often it stood before), sorted, binary.

    Two texts' elements overlap as their multisets of shingles do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for i, j, part, at in slices(*utf8(batch.column("text"))):
                row, word, _, _ = words(part, at)
                row, s, count = multiset(*shingles(row, word, j - i, shingle))
                own = np.repeat(np.arange(len(row)), count)
                nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                value = mix(s[own] + nth.astype(np.uint64) * _GOLDEN)
                row = row[own]
                order = np.lexsort((value, row))
                many = np.bincount(row, minlength=j - i)
                ends = np.concatenate([[0], np.cumsum(many)])
                value = value[order]
                out += [value[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                sizes.append(many)
            yield pa.RecordBatch.from_arrays([batch.column("_rid"), pa.array(np.concatenate([*sizes, np.zeros(0, np.int64)]), pa.int64()), pa.array(out, pa.binary())], ["_rid", "size", "elements"])

    return rows.select("_rid", "text").mapInArrow(run, "_rid long, size long, elements binary")


def prefixes(elements: list[np.ndarray], similarity: float) -> list[np.ndarray]:
    """Of each row the rarest elements (counted over these rows), so many that two similar rows share one of theirs."""
    size = np.array([len(e) for e in elements])
    value = np.concatenate(elements) if elements else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(elements)), size)
    known, code, many = np.unique(value, return_inverse=True, return_counts=True)
    order = np.lexsort((code, many[code], row))
    ends = np.concatenate([[0], np.cumsum(size)])
    take = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    return [known[code[order[a : a + n]]] for a, n in zip(ends[:-1], take, strict=True)] if len(known) else [value for _ in elements]


def similar_links(homes: tuple[np.ndarray, list[bytes]], guests: tuple[np.ndarray, list[bytes]], similarity: float) -> list[tuple[int, int]]:
    """(home, guest) of similar rows, enough to join all labels that any such pair joins; each side is (label, elements).

    Rows whose labels are one already, by their own label or by links found before, are not compared.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    rows = [np.frombuffer(e, np.uint64) for e in (*homes[1], *guests[1])]
    label = [int(x) for x in (*homes[0], *guests[0])]
    first, n = prefixes(rows, similarity), len(homes[1])
    size = np.array([len(r) for r in rows], np.int64)
    key = np.concatenate([*first[:n], np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(n), [len(f) for f in first[:n]])
    order = np.argsort(key, kind="stable")
    key, owner, links = key[order], owner[order], []
    for g in range(n, len(rows)):
        low, high = np.searchsorted(key, first[g], "left"), np.searchsorted(key, first[g], "right")
        near = np.unique(np.concatenate([owner[a:b] for a, b in zip(low[high > low], high[high > low], strict=True)] or [np.zeros(0, np.int64)]))
        near = near[(size[near] >= similarity * size[g] - 1e-9) & (size[g] >= similarity * size[near] - 1e-9)]
        for h in near.tolist():
            if root(label[h]) == root(label[g]):
                continue
            small, large = (rows[h], rows[g]) if size[h] < size[g] else (rows[g], rows[h])
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            if both >= (similarity - 1e-12) * (size[h] + size[g] - both):
                parent[root(label[h])] = root(label[g])
                links.append((h, g - n))
    return links


def _across(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links across classes within the cells of rows (key, c, g, guest, _rid, label, elements), sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list) -> pa.RecordBatch:
            sides = [[r for r in held if r[3] == guest] for guest in (False, True)]
            found = similar_links(*[(np.array([r[5] for r in side], np.int64), [r[6] for r in side]) for side in sides], similarity)
            return pa.RecordBatch.from_arrays([pa.array([sides[k][x[k]][4] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        held: list = []
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[-1][:3] != r[:3]:
                    yield links(held)
                    held = []
                held.append(r)
        if held:
            yield links(held)

    return rows.select("key", "c", "g", "guest", "_rid", "label", "elements").mapInArrow(run, "a long, b long")


def _cells(unsettled: DataFrame, elements: DataFrame, block: int) -> DataFrame:
    """unsettled (key, _rid, label) in cells (key, c, g) with elements, so that rows of different labels meet in one.

    A bucket's rows are homes in one of its blocks c each; its rows outside the largest label are guests too, in one of
    the guests' blocks g each. A cell holds the homes of c and the guests of g.
    """
    weighed = unsettled.join(elements.select("_rid", "size"), "_rid")
    by_label = weighed.groupBy("key", "label").agg(F.sum("size").alias("w"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("w") / block)).cast("int")
    most = F.max(F.struct("w", "label"))
    shape = by_label.groupBy("key").agg(most["label"].alias("top"), F.sum("w").alias("w"), (F.sum("w") - most["w"]).alias("outside"))
    shape = saved(shape.select("key", "top", blocks.alias("cs"), F.greatest(F.lit(1), F.ceil(F.col("outside") / block)).cast("int").alias("gs")))
    rows = unsettled.join(shape, "key")
    c, g = F.pmod(F.xxhash64("_rid"), F.col("cs")).cast("int"), F.pmod(F.xxhash64(F.lit(3), "_rid"), F.col("gs")).cast("int")
    homes = rows.select("key", c.alias("c"), F.explode(F.expr("sequence(0, gs - 1)")).alias("g"), F.lit(False).alias("guest"), "_rid", "label")
    guests = rows.where("label <> top").select("key", F.explode(F.expr("sequence(0, cs - 1)")).alias("c"), g.alias("g"), F.lit(True).alias("guest"), "_rid", "label")
    return homes.union(guests).join(elements.select("_rid", "elements"), "_rid")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, per_band: int = ROWS, rid: str | None = None, block: int = BLOCK) -> DataFrame:
    """(_rid, doc_id, class_id, head_id, first) for each row of docs (doc_id, text and more).

    first: whether the row is its class's first by doc_id (null last), then by its place. class_id: the _rid of that row,
    so classes stay apart where ids are null or repeat; head_id: its doc_id. _rid is docs' column rid, unique for each
    row, or else the number that :func:`numbered` gives to it, which is the same as long as the scan's splits are. Equal
    texts are in one class. A text of fewer words than a shingle is one shingle; texts without words are linked with
    equal texts only; a null text is a class of its own.
    """
    ship(docs.sparkSession)
    told = docs.select("doc_id", "text", F.col(rid).alias("_rid")) if rid else numbered(docs.select("doc_id", "text"))
    rows = told.select("_rid", "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")
    rows = rows.withColumns({h: F.when(F.col("text").isNotNull(), F.col(h)) for h in ("h1", "h2")})
    texts = rows.select("_rid", "text")
    signed = saved(_signed(rows, bands, per_band, shingle))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_rid")
    nodes = signed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("_rid").alias("node"), F.min(order).alias("head"))
    distinct = signed.join(nodes.select("node"), F.col("_rid") == F.col("node"), "left_semi").select("_rid", F.explode("bands").alias("key"))
    shared = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = saved(distinct.join(shared, "key"))
    # From here on only the texts that share a bucket count.
    texts = saved(texts.join(members.select("_rid").distinct(), "_rid", "left_semi"))
    company = members.groupBy("_rid").agg(F.sum("n").alias("company"))
    centres = members.join(company, "_rid").groupBy("key").agg(F.max(F.struct("company", -F.col("_rid"))).alias("top")).select("key", (-F.col("top.col2")).alias("leader"))
    centred = saved(members.drop("n").join(centres, "key"))
    discard(members)
    links = saved(verified(centred.where("_rid <> leader").select(F.col("_rid").alias("a"), F.col("leader").alias("b")).distinct(), texts, similarity, shingle))
    labels = components(links)
    # Buckets whose nodes are in several classes still; of buckets with the same nodes one is enough.
    held = centred.join(labels, centred._rid == labels.node, "left").select("key", "_rid", F.coalesce("label", "_rid").alias("label"))
    number = [F.bit_xor(F.xxhash64(F.lit(k), "_rid")).alias(f"x{k}") for k in (1, 2)]
    mixed = held.groupBy("key").agg((F.min("label") < F.max("label")).alias("open"), F.count(F.lit(1)).alias("n"), *number).where("open")
    once = saved(mixed.groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key"))
    unsettled = saved(held.join(once, "key", "left_semi"))
    elements = saved(_elements(texts.join(unsettled.select("_rid").distinct(), "_rid", "left_semi"), shingle))
    dealt = _cells(unsettled, elements, block).repartition(partitions_for(docs.sparkSession), "key", "c", "g").sortWithinPartitions("key", "c", "g")
    more = saved(_across(dealt, similarity).distinct())
    if more.limit(1).count():
        labels = components(links.union(more))
    for done in (texts, centred, unsettled, elements):
        discard(done)
    known = saved(nodes.join(labels, "node", "left").select("h1", "h2", "head", F.coalesce("label", "node").alias("label")))
    heads = known.groupBy("label").agg(F.min("head").alias("head"))
    known = known.drop("head").join(heads, "label")
    placed = signed.select("_rid", "doc_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    alone = F.col("head").isNull()
    return placed.select("_rid", "doc_id", F.coalesce("head._rid", "_rid").alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("head_id"), (alone | (F.col("_rid") == F.col("head._rid"))).alias("first"))


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """One row for each document, by :func:`near_duplicates` with its defaults: its class, and the least doc_id in it."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("_rid")
