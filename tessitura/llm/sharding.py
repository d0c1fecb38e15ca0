"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix; DataFrame functions only.

Law ``rows``: the counts of two shards differ by one at most. Source blocks hold the rows whose hashed row number has
the block's top bits. How many rows of each block go to each shard is drawn exactly: a tree halves the set of blocks
again and again, and at each halving a multivariate hypergeometric draw, shard by shard, says how many of the rows that
a shard takes from the whole lie in the left half. Each draw inverts the distribution's cumulative weights outwards
from the mode, with a hashed uniform. Then each block is permuted (rank by a seeded hash), ranks become shards by the
block's row of the matrix, rows are exchanged to their shard, and each shard is permuted again (slot by a second hash).

Blocks and the shards' sub-ranges grow in number with the rows, so no task gets more than about a million of them. The
text takes no part in any exchange but the last one of :func:`shard_rows`, which puts the result beside the columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import free_name, numbered, partitions_for

#: Rows of a source block and of a shard's sub-range, and the least and most bits of either number.
BLOCK_ROWS, LEAST_BITS, MOST_BITS = 1 << 20, 6, 16
#: Half-width of the inverted range in standard deviations: the weight outside is under 1e-28.
SPREAD = 12


def _draw(total: str, good: str, take: str, uniform: str) -> str:
    """SQL of one exact draw: how many of `take` rows, out of `total` of which `good` are marked, are marked.

    Weights are relative to the mode's, by the ratio of neighbouring terms, so no factorial is needed.
    """
    low, high = f"greatest(0L, {take} - ({total} - {good}))", f"least({take}, {good})"
    mode = f"least(greatest(cast(floor(({take} + 1.0D) * ({good} + 1.0D) / ({total} + 2.0D)) as bigint), {low}), {high})"
    var = f"(cast({take} as double) * {good} / {total} * (1 - cast({good} as double) / {total}) * ({total} - {take}) / greatest({total} - 1, 1))"
    half = f"cast(ceil({SPREAD} * sqrt(greatest({var}, 0.0D))) + 12 as bigint)"
    up = "a.w * (d.good - k + 1.0D) * (d.take - k + 1.0D) / (cast(k as double) * (d.total - d.good - d.take + k))"
    down = "a.w * (k + 1.0D) * (d.total - d.good - d.take + k + 1.0D) / ((d.good - k + 0.0D) * (d.take - k))"
    above = "if(d.mode < d.top, sequence(d.mode + 1, d.top), cast(array() as array<bigint>))"
    below = "if(d.mode > d.bottom, sequence(d.mode - 1, d.bottom, -1L), cast(array() as array<bigint>))"
    mass = lambda seq, ratio: f"aggregate({seq}, named_struct('w', 1.0D, 's', 0.0D), (a, k) -> named_struct('w', {ratio}, 's', a.s + {ratio}), a -> a.s)"
    find = lambda seq, ratio, at: f"aggregate({seq}, named_struct('w', 1.0D, 's', {at}, 'x', d.mode), (a, k) -> named_struct('w', {ratio}, 's', a.s - {ratio}, 'x', if(a.s > 0, k, a.x)), a -> a.x)"
    picked = f"""element_at(transform(array({uniform} * (1 + d.above + d.below)), u ->
        case when u <= 1 then d.mode
             when u <= 1 + d.above then {find(above, up, "u - 1")}
             else {find(below, down, "u - 1 - d.above")} end), 1)"""
    bounds = f"named_struct('total', {total}, 'good', {good}, 'take', {take}, 'mode', {mode}, 'bottom', greatest({low}, {mode} - {half}), 'top', least({high}, {mode} + {half}))"
    masses = f"named_struct('total', d.total, 'good', d.good, 'take', d.take, 'mode', d.mode, 'bottom', d.bottom, 'top', d.top, 'above', {mass(above, up)}, 'below', {mass(below, down)})"
    drawn = f"element_at(transform(transform(array({bounds}), d -> {masses}), d -> {picked}), 1)"
    return f"case when {take} <= 0 or {good} <= 0 then 0L when {take} >= {total} then {good} when {good} >= {total} then {take} else {drawn} end"


def communication_matrix(sizes: DataFrame, shards: int, seed: int, bits: int) -> DataFrame:
    """(block, ends): for each block the running totals of its rows over the shards, as an array of shards + 1 longs.

    sizes: (block, n) for blocks 0 to 2**bits - 1; absent blocks are empty. Shards' sizes differ by one at most, and
    which shards are larger does not depend on the rows: the first ones.
    """
    full = (
        sizes.sparkSession.range(1 << bits)
        .withColumnRenamed("id", "block")
        .join(sizes, "block", "left")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("block", F.coalesce("n", F.lit(0)).cast("long").alias("n")))), lambda x: x["n"]).alias("sizes"))
    )
    total = "aggregate(sizes, 0L, (a, x) -> a + x)"
    node = full.select("sizes", F.expr(f"transform(sequence(0, {shards - 1}), s -> {total} div {shards} + if(s < {total} % {shards}, 1L, 0L))").alias("caps"), F.lit(0).cast("long").alias("node"))
    spread = partitions_for(sizes.sparkSession)
    for level in range(bits):
        half = 1 << (bits - level - 1)
        left = f"aggregate(slice(sizes, 1, {half}), 0L, (a, x) -> a + x)"
        uniform = f"(shiftrightunsigned(xxhash64({seed}, {level}, o.node, size(o.out)), 11) / {float(1 << 53)}D)"
        step = f"""aggregate(caps, named_struct('total', {total}, 'take', {left}, 'node', node, 'out', cast(array() as array<bigint>)),
            (o, cap) -> element_at(transform(array({_draw("o.total", "cap", "o.take", uniform)}), x ->
                named_struct('total', o.total - cap, 'take', o.take - x, 'node', o.node, 'out', concat(o.out, array(x)))), 1), o -> o.out)"""
        node = (
            node.select("sizes", "caps", "node", F.expr(step).alias("mine"))
            .select(
                F.explode(
                    F.array(
                        F.struct(F.expr(f"slice(sizes, 1, {half})").alias("sizes"), F.col("mine").alias("caps"), (F.col("node") * 2).alias("node")),
                        F.struct(F.expr(f"slice(sizes, {half + 1}, {half})").alias("sizes"), F.expr("zip_with(caps, mine, (c, m) -> c - m)").alias("caps"), (F.col("node") * 2 + 1).alias("node")),
                    )
                ).alias("h")
            )
            .select("h.*")
        )
        if level == 5:  # 64 nodes: from here on the halvings run side by side
            node = node.repartition(spread, "node")
    return node.select(F.col("node").alias("block"), F.expr("aggregate(caps, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x)))").alias("ends"))


def assign(keys: DataFrame, rid: str, shards: int = 40, seed: int = 17) -> DataFrame:
    """keys with shard (int) and slot (long, gapless from 0 in each shard). keys must be replayable and rid unique."""
    rows = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, rows / BLOCK_ROWS)))))
    fine = max(1, min(1 << MOST_BITS, math.ceil(max(rows, 1) / shards / BLOCK_ROWS)))
    fine = max(fine, math.ceil(partitions_for(keys.sparkSession) / shards))
    top = lambda s: F.shiftrightunsigned(F.xxhash64(F.lit(seed + s), rid), 64 - bits).cast("long")
    dealt = keys.withColumn("_block", top(0)).withColumn("_order", F.xxhash64(F.lit(seed + 1), rid))
    sizes = dealt.groupBy(F.col("_block").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    matrix = communication_matrix(sizes, shards, seed, bits).withColumnRenamed("block", "_block")
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("_block").orderBy("_order", rid)).cast("long") - 1)
    placed = (
        ranked.join(matrix, "_block")
        .withColumn("shard", F.expr("cast(size(filter(ends, e -> e <= _rank)) - 1 as int)"))
        .withColumn("_again", F.xxhash64(F.lit(seed + 2), rid))
        .withColumn("_part", F.expr(f"cast(shiftrightunsigned(_again, 32) * {fine}L div 4294967296L as int)"))
        .drop("ends", "_rank", "_order", "_block")
    )
    # The second permutation: sub-ranges of the second hash in order, rows in order within their sub-range.
    before = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(W.partitionBy("shard").orderBy("_part")) - F.col("_n")).drop("_n")
    within = W.partitionBy("shard", "_part").orderBy(F.expr("shiftrightunsigned(_again, 1)"), "_again", rid)
    return placed.join(before, ["shard", "_part"]).withColumn("slot", F.col("_before") + F.row_number().over(within) - 1).drop("_again", "_part", "_before")


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """docs with shard and slot beside its columns (an underscore before either where docs has such a column).

    Nulls in any column, equal rows and rows of one key are dealt out like any others, since only row numbers count.
    No rows give no rows; fewer rows than shards leave shards empty.
    """
    rid, shard, slot = free_name(docs, "_rid"), free_name(docs, "shard"), free_name(docs, "slot")
    with_id = numbered(docs, rid)
    found = assign(with_id.select(F.col(rid).alias("_rid_")), "_rid_", shards, seed)
    return with_id.join(found.select(F.col("_rid_").alias(rid), F.col("shard").alias(shard), F.col("slot").alias(slot)), rid).drop(rid)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """One row for each document, by :func:`assign`, law `rows`: null texts have size 16 and the empty text's checksum; ids play no part."""
    from .common import table

    text = F.coalesce("text", F.lit(""))
    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    return assign(docs, "_rid").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
