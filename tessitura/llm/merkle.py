"""Merkle manifest of a dataset: a hash tree over each group's rows in order of their key, and a proof for every row.

A row's place in its group comes from histograms, with no sort of a group: rows are counted by the leading digits of their
key (DIGIT bits from the first one in which the bucket's rows differ), running sums of the counts are exact ranks of the
buckets' first rows, and buckets of more than MOST rows are counted by their next digits. Only the rows of a bucket, MOST at
most, are ever ordered together. Rows of one key go on by digits of their leaf's digest and of their place in the scan, so
one id that a third of all rows have is dealt like any other.

Ranks are then written to the base of the fanout; a prefix of those digits is a node of the trie. All ranks that share all
but their last digits, up to SPAN of them, are reduced together, longest prefix first, to the node of what they share. A
second pass goes down again and hands every row the digests that stand beside its way to the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from ..session import ship
from .common import beside, discard, numbered, packed, saved, table

#: Bits of a digit of the histograms, and rows of a bucket that are ordered together at most.
DIGIT, MOST = 12, 4096
#: Nodes that one task reduces together at most.
SPAN = 4096
#: Rows of a table of buckets (a name and numbers) up to which it is sent to all tasks, so that the rows stay where they are.
FEW = 1 << 16


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row: sha256 over each field's number of UTF-8 bytes, a colon and its value, `-` for null."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def joined_digest(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels(digests: list[str], fanout: int, height: int | None = None) -> list[list[str]]:
    """The nodes from digests up: `height` levels more, or until one node is left."""
    out = [digests]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([joined_digest(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def folded(leaf: Column, left: Column, right: Column) -> Column:
    """The root that leaf leads to, with the digests on its left and right at each level."""
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), leaf, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


# Ranks -----------------------------------------------------------------------------------------------------------------


def _sent(buckets: DataFrame) -> DataFrame:
    return F.broadcast(buckets) if buckets.limit(FEW + 1).count() <= FEW else buckets


def radix_ranks(rows: DataFrame, group: str, words: list[str], most: int = MOST) -> DataFrame:
    """rows with rank (from 0) and size: each row's place in its group by the words (longs, no nulls), and the group's rows.

    rows is read once for each level of digits and must be the same each time; no two rows of a group have all words equal.
    """
    ends = [f(w).alias(f"_{n}{i}") for i, w in enumerate(words) for n, f in (("lo", F.min), ("hi", F.max))]
    bounds = [f"_{n}{i}" for i in range(len(words)) for n in ("lo", "hi")]
    open_ = saved(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *ends).withColumns({"_base": F.lit(0).cast("long"), "size": F.col("_n")}))
    rest, out = rows, None
    while True:
        # The digit of a bucket: DIGIT bits from the first in which the first word that is not the same throughout differs.
        shift, word, n = F.lit(0), F.lit(-1), len(words)
        for i in range(n - 1, -1, -1):
            differ = F.col(f"_lo{i}").bitwiseXOR(F.col(f"_hi{i}"))
            width = F.when(differ < 0, 64).otherwise(F.length(F.bin(differ)))
            word = F.when(differ != 0, i).otherwise(word)
            shift = F.when(differ != 0, F.greatest(F.lit(0), width - DIGIT)).otherwise(shift)
        parents = open_.select(group, "_base", "size", word.alias("_word"), shift.alias("_shift"))
        digit = F.lit(0).cast("long")
        for i, w in enumerate(words):
            digit = F.when(F.col("_word") == i, F.call_function("shiftright", F.col(w), F.col("_shift"))).otherwise(digit)
        inside = rest.join(_sent(parents), [group] if out is None else [group, "_base"]).withColumn("_digit", digit).drop("_word", "_shift")
        counts = inside.groupBy(group, "_base", "size", "_digit").agg(F.count(F.lit(1)).alias("_n"), *ends)
        before = F.sum("_n").over(W.partitionBy(group, "_base").orderBy("_digit")) - F.col("_n")
        buckets = saved(counts.withColumn("_first", F.col("_base") + before))
        placed = inside.drop("size").join(_sent(buckets.select(group, "_base", "_digit", "_first", "size", "_n")), [group, "_base", "_digit"])
        placed = placed.drop("_base", "_digit").withColumnRenamed("_first", "_base")
        done = placed.where(F.col("_n") <= most).drop("_n")
        out = done if out is None else out.unionByName(done)
        open_ = buckets.where(F.col("_n") > most).select(group, F.col("_first").alias("_base"), "size", *bounds)
        if open_.isEmpty():
            break
        rest = placed.where(F.col("_n") > most).drop("_n", "size")
    within = F.row_number().over(W.partitionBy(group, "_base").orderBy(*words))
    return out.withColumn("rank", F.col("_base") + within - 1).drop("_base")


def byte_words(value: Column, size: int) -> list[Column]:
    """Longs whose order is that of the strings' UTF-8 bytes, for strings of `size` bytes at most."""
    raw, out = F.hex(value.cast("binary")), []
    for i in range(0, size, 8):
        part = F.rpad(F.substring(raw, 2 * i + 1, 16), 16, "0")
        out.append(F.conv(part, 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63))))
    return [*out, F.octet_length(value).cast("long")]


# Trees -----------------------------------------------------------------------------------------------------------------

_NODE = "g string, rank long, digest string, size long"


def _span(fanout: int) -> tuple[int, int]:
    """(nodes that are reduced together, their levels): the greatest power of the fanout up to SPAN."""
    height = 1
    while fanout ** (height + 1) <= SPAN:
        height += 1
    return fanout**height, height


def climbed(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The nodes (g, rank, digest, size) and those some levels up, again and again until each group has one."""
    ship(nodes.sparkSession)
    span, height = _span(fanout)

    def up(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        size = rows["size"][0].as_py()
        top = levels(rows["digest"].to_pylist(), fanout, None if size <= span else height)[-1]
        return pa.table({"g": pa.array([key[0].as_py()], pa.string()), "rank": pa.array([key[1].as_py()], pa.int64()), "digest": pa.array(top, pa.string()), "size": pa.array([-(-size // span)], pa.int64())})

    out = [nodes]
    left = nodes.agg(F.max("size")).first()[0] or 0
    while left > 1:
        below = out[-1].select("g", "rank", "digest", "size")
        out.append(saved(below.groupBy("g", F.expr(f"rank div {span}").alias("part")).applyInArrow(up, _NODE)))
        left = -(-left // span)
    return out


def descended(stages: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """The lowest stage's rows (all columns) with left and right: the digests beside each node's way up, level by level.

    above: (g, left, right), the way on from each group's own root.
    """
    span, height = _span(fanout)
    way = above.select("g", F.lit(0).cast("long").alias("rank"), "left", "right")
    for s in range(len(stages) - 2, -1, -1):
        nodes = stages[s]
        schema = StructType([*nodes.schema.fields, *[StructField(n, ArrayType(StringType())) for n in ("left", "right")]])

        def down(rows: pa.Table, ways: pa.Table) -> pa.Table:
            rows = rows.sort_by("rank")
            size, n = rows["size"][0].as_py(), rows.num_rows
            tree = levels(rows["digest"].to_pylist(), fanout, None if size <= span else height)
            left, right = ([list(ways[side][0].as_py()) for _ in range(n)] for side in ("left", "right"))
            for k in range(len(tree) - 2, -1, -1):  # from the top, each level before what is there
                for i in range(n):
                    at = i // fanout**k
                    first = at - at % fanout
                    left[i].append("".join(tree[k][first:at]))
                    right[i].append("".join(tree[k][at + 1 : first + fanout]))
            return rows.append_column("left", pa.array(left, pa.list_(pa.string()))).append_column("right", pa.array(right, pa.list_(pa.string())))

        parts = nodes.groupBy("g", F.expr(f"rank div {span}").alias("part"))
        way = parts.cogroup(way.groupBy("g", F.col("rank").alias("part"))).applyInArrow(down, schema)
        if s:
            way = way.select("g", "rank", "left", "right")
    if len(stages) == 1:
        return stages[0].join(above, "g")
    return way


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang", fanout: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep with leaf, subroot, root, left and right: each row's digest, its group's, all rows', and its proof.

    A group's rows ascend by key (whole numbers); every `fanout` consecutive nodes, the last fewer, become one, until one is
    left. The groups' roots, in order of the group's name by UTF-8 bytes, null first, likewise give the root. left and right
    are the digests on either side of a row's way, from the root of all down to the row; :func:`folded` takes them reversed,
    as :func:`proof` gives them.

    Rows with a null key come first. Rows of one key are ordered by the first 64 bits of their leaf, and equal rows as they
    are scanned, each with a proof of its own. Null and empty fields have different leaves; texts of any length are hashed
    whole. No rows give no rows. Names that keep has get an underscore before them. Only numbers of rows come to the driver.
    """
    spark = docs.sparkSession
    rows = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), leaf_digest(*[F.col(f"`{c}`") for c in fields]).alias("digest"), F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{group}`").cast("string").alias("_group")))
    first = F.conv(F.substring("digest", 1, 16), 16, -10).cast("long")
    # Null is the empty name and other names have a mark before them, so that null comes first and is no other group.
    name = F.coalesce(F.concat(F.lit("="), F.col("_group")), F.lit(""))
    leaves = saved(rows.select("_row", "digest", name.alias("g"), F.coalesce("_key", F.lit(-(1 << 63)).cast("long")).alias("_key"), first.alias("_leaf"), "_rid"))
    ranked = saved(radix_ranks(leaves, "g", ["_key", "_leaf", "_rid"], MOST).select("_row", "g", "rank", "digest", "size"))
    discard(leaves)
    stages = climbed(ranked, fanout)
    roots = stages[-1].select("g", "digest")
    longest = roots.agg(F.max(F.octet_length("g"))).first()[0] or 0
    words = byte_words(F.col("g"), longest)
    named = saved(roots.select(F.col("g").alias("_name"), "digest", F.lit("").alias("g"), *[w.alias(f"_w{i}") for i, w in enumerate(words)]))
    tops = climbed(saved(radix_ranks(named, "g", [f"_w{i}" for i in range(len(words))], MOST).select("_name", "g", "rank", "digest", "size")), fanout)
    none = F.array().cast("array<string>")
    ways = descended(tops, spark.createDataFrame([("",)], "g string").select("g", none.alias("left"), none.alias("right")), fanout)
    ways = saved(ways.select(F.col("_name").alias("g"), F.col("digest").alias("subroot"), "left", "right"))
    found = descended(stages, ways.select("g", "left", "right"), fanout)
    found = found.join(ways.select("g", "subroot"), "g").join(F.broadcast(tops[-1].where("rank = 0").select(F.col("digest").alias("root"))))  # one row
    return beside(found.withColumnRenamed("digest", "leaf"), "leaf", "subroot", "root", "left", "right")


def proof(left: Column, right: Column) -> tuple[Column, Column]:
    """left and right from the row up to the root."""
    return F.reverse(left), F.reverse(right)


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """One row for each document, by :func:`merkle_manifest` with its defaults.

    The manifest then meets leaves of documents of which some were changed: they fold to another root. A null n_chars
    can't be changed; a document without an id is not.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    claimed = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + F.when(changed, 1).otherwise(0), F.col("text"))
    found = merkle_manifest(docs.withColumn("claimed", claimed), keep=("doc_id", "claimed"))
    left, right = proof(F.col("left"), F.col("right"))
    digests = F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(digests, 256).alias("proof_sha256"), folded(F.col("claimed"), left, right).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB: every level of every tree by recursion, then the way of every document by recursion over those levels.
OP11_SQL = r"""
WITH RECURSIVE poly AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM poly WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
f AS (SELECT *, CAST(doc_id AS VARCHAR) AS i, CAST(n_chars AS VARCHAR) AS n FROM documents),
l AS (SELECT doc_id, lang,
      coalesce(strlen(i) || ':' || i, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, n, n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
      coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(i, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0, false) AS changed FROM f, crc),
h AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n) || ':' || n, '-') || tail) AS leaf, sha256(head || coalesce(strlen(CAST(n_chars + CASE WHEN changed THEN 1 ELSE 0 END AS VARCHAR)) || ':' || CAST(n_chars + CASE WHEN changed THEN 1 ELSE 0 END AS VARCHAR), '-') || tail) AS claimed FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS size FROM h),
tree AS (SELECT lang, 0 AS level, rank, leaf AS digest, size FROM r UNION ALL
         SELECT lang, level + 1, rank // 2, sha256(string_agg(digest, '' ORDER BY rank)), (any_value(size) + 1) // 2 FROM tree WHERE size > 1 GROUP BY lang, level, rank // 2),
sub AS (SELECT lang, digest AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS size FROM tree WHERE size = 1),
top AS (SELECT 0 AS level, rank, subroot AS digest, size FROM sub UNION ALL
        SELECT level + 1, rank // 2, sha256(string_agg(digest, '' ORDER BY rank)), (any_value(size) + 1) // 2 FROM top WHERE size > 1 GROUP BY level, rank // 2),
node AS (SELECT coalesce('=' || t.lang, '') AS g, t.level, t.rank, t.digest FROM tree t WHERE size > 1 UNION ALL
         SELECT coalesce('=' || s.lang, ''), s.height + top.level, top.rank, top.digest FROM sub s, top WHERE top.size > 1),
way AS (SELECT doc_id, coalesce('=' || r.lang, '') AS g, 0 AS level, r.rank AS rank, claimed AS node, '' AS proof, height, sub.rank AS grp FROM r JOIN sub ON sub.lang IS NOT DISTINCT FROM r.lang UNION ALL
        SELECT doc_id, w.g, w.level + 1, w.at // 2, sha256(CASE WHEN s.digest IS NULL THEN w.node WHEN w.at % 2 = 0 THEN w.node || s.digest ELSE s.digest || w.node END), w.proof || coalesce(s.digest, ''), height, grp
        FROM (SELECT *, CASE WHEN level = height THEN grp ELSE rank END AS at FROM way) w JOIN node o ON o.g = w.g AND o.level = w.level AND o.rank = w.at LEFT JOIN node s ON s.g = w.g AND s.level = w.level AND s.rank = xor(w.at, 1)),
done AS (SELECT doc_id, arg_max(node, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM way GROUP BY doc_id),
root AS (SELECT digest AS root FROM top WHERE size = 1)
SELECT r.doc_id, r.leaf, sub.subroot, root.root, done.proof_sha256, done.folded_root, done.folded_root = root.root AS verified
FROM r JOIN sub ON sub.lang IS NOT DISTINCT FROM r.lang JOIN done ON done.doc_id = r.doc_id, root
"""
