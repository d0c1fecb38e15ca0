"""Windows over keys of any size: ranks, running sums and neighbours, with no key's rows together in one task.

A key's rows are cut into ranges that follow each other in the order, of MOST rows at most, and the window runs within each
range; what it needs of the ranges before (how many rows, their sum, their last row) is one row a range. The cuts come from
histograms of the order's leading digits, refined where a range is too long, so they are the same however the rows are
partitioned and lost tasks are made again alike. Where all keys are short there is one range for each, and nothing is added
to the plain window but a count of each key's rows.

An order is a list of columns, each `name` or `-name` for a falling one; nulls come first, and last in a falling one. Rows of
a key that are equal in all of them, or in all that can tell them apart (below), stay in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import saved

#: Rows of a range at most, and bits of a digit.
MOST, DIGIT = 1 << 17, 12
#: Rows of a table of ranges up to which it is sent to all tasks; they are numbers and a key.
FEW = 1 << 16
_LEAST, _GREATEST = -(1 << 63), (1 << 63) - 1


def _named(order: list[str]) -> list[tuple[str, bool]]:
    return [(o[1:], True) if o.startswith("-") else (o, False) for o in order]


def sorting(order: list[str]) -> list[Column]:
    return [F.desc(c) if falling else F.asc(c) for c, falling in _named(order)]


def _words(rows: DataFrame, order: list[str]) -> list[Column]:
    """Longs whose order goes with that of the columns: equal or rising where the order rises.

    A column that a long can't tell apart exactly (fractions, long strings) is the last one that counts.
    """
    out = []
    for c, falling in _named(order):
        kind, exact = rows.schema[c].dataType, True
        if isinstance(kind, (T.IntegralType, T.BooleanType)):
            word = F.col(c).cast("long")
        elif isinstance(kind, T.DateType):
            word = F.unix_date(c).cast("long")
        elif isinstance(kind, T.TimestampType):
            word = F.unix_micros(c)
        elif isinstance(kind, T.TimestampNTZType):
            seconds = F.unix_date(F.col(c).cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
            word = seconds * 1_000_000 + (F.extract(F.lit("SECOND"), F.col(c)) * 1_000_000).cast("long")
        elif isinstance(kind, (T.FractionalType, T.DecimalType)):
            # Halves of a double's range are squeezed, so that small differences of large and of small numbers count.
            v = F.col(c).cast("double")
            word, exact = F.when(F.isnan(v), _GREATEST).otherwise((F.signum(v) * F.log1p(F.abs(v)) * F.lit(float(1 << 52))).cast("long")), False
        elif isinstance(kind, T.StringType):
            raw = F.rpad(F.substring(F.hex(F.col(c).cast("binary")), 1, 14), 14, "0")
            word, exact = F.conv(raw, 16, 10).cast("long"), False
        else:
            raise TypeError(f"no ranges over {kind.simpleString()} columns")
        word = F.coalesce(word, F.lit(_LEAST))
        out.append(-1 - word if falling else word)  # the complement, so that nothing overflows
        if not exact:
            break
    return out


def _sent(table: DataFrame) -> DataFrame:
    """The table, to be sent to all tasks if it has FEW rows at most: rows that meet it then stay where they are."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def ranged(rows: DataFrame, key: list[str], order: list[str], most: int | None = None) -> tuple[DataFrame, bool]:
    """(rows with _range, is any key cut?): a long that rises with the order within a key; no range has more than `most` rows.

    _range is the number of the key's rows before the range. rows must be the same each time it is read. Only rows of keys that
    are too long are read more than twice.
    """
    most = most or MOST
    words = _words(rows, order)
    lengths = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    if lengths.where(F.col("_n") > most).isEmpty():
        return rows.withColumn("_range", F.lit(0).cast("long")), False
    known = [f"_w{i}" for i in range(len(words))]
    safe = [f"_k{i}" for i in range(len(key))]  # keys that are null are keys too
    rows = rows.withColumns(dict(zip(known, words, strict=True)) | {s: F.coalesce(F.to_json(F.struct(F.col(k).alias("k"))), F.lit("")) for s, k in zip(safe, key, strict=True)})
    ends = [f(w).alias(f"_{n}{i}") for i, w in enumerate(known) for n, f in (("lo", F.min), ("hi", F.max))]
    bounds = [f"_{n}{i}" for i in range(len(words)) for n in ("lo", "hi")]
    open_ = saved(rows.groupBy(*safe).agg(F.count(F.lit(1)).alias("_n"), *ends).withColumn("_range", F.lit(0).cast("long")))
    rest, out = rows, None
    while True:
        shift, word = F.lit(0), F.lit(-1)  # the first bits in which the rows of a range that is too long differ
        for i in range(len(words) - 1, -1, -1):
            differ = F.col(f"_lo{i}").bitwiseXOR(F.col(f"_hi{i}"))
            width = F.when(differ < 0, 64).otherwise(F.length(F.bin(differ)))
            word, shift = F.when(differ != 0, i).otherwise(word), F.when(differ != 0, F.greatest(F.lit(0), width - DIGIT)).otherwise(shift)
        parents = open_.select(*safe, "_range", (F.col("_n") > most).alias("_long"), word.alias("_word"), shift.alias("_shift"))
        digit = F.lit(0).cast("long")
        for i, w in enumerate(known):
            digit = F.when(F.col("_long") & (F.col("_word") == i), F.call_function("shiftright", F.col(w), F.col("_shift"))).otherwise(digit)
        inside = rest.join(_sent(parents), safe if out is None else [*safe, "_range"]).withColumn("_digit", digit).drop("_long", "_word", "_shift")
        counts = inside.groupBy(*safe, "_range", "_digit").agg(F.count(F.lit(1)).alias("_n"), *ends)
        before = F.sum("_n").over(W.partitionBy(*safe, "_range").orderBy("_digit")) - F.col("_n")
        alike = F.lit(True)
        for i in range(len(words)):
            alike = alike & (F.col(f"_lo{i}") == F.col(f"_hi{i}"))
        cut = saved(counts.withColumn("_first", F.col("_range") + before).withColumn("_more", (F.col("_n") > most) & ~alike))
        placed = inside.join(_sent(cut.select(*safe, "_range", "_digit", "_first", "_more")), [*safe, "_range", "_digit"]).drop("_range", "_digit").withColumnRenamed("_first", "_range")
        done = placed.where(~F.col("_more")).drop("_more")
        out = done if out is None else out.unionByName(done)
        open_ = cut.where("_more").select(*safe, F.col("_first").alias("_range"), "_n", *bounds)
        if open_.isEmpty():
            return out.drop(*known, *safe), True
        rest = placed.where("_more").drop("_more")


def _beside(ranged_rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Rows with their range's row of the table; null keys meet null keys."""
    names = {k: f"_t{i}" for i, k in enumerate(key)}
    table = table.withColumnsRenamed(names).withColumnRenamed("_range", "_at")
    same = F.col("_range") == F.col("_at")
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return ranged_rows.join(_sent(table), same).drop("_at", *names.values())


def ranked(rows: DataFrame, key: list[str], order: list[str], name: str = "rank", most: int | None = None) -> DataFrame:
    """rows with their number in their key, from 1; equal rows of the order are numbered as they come."""
    parts, cut = ranged(rows, key, order, most)
    if not cut:
        return rows.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*sorting(order))).cast("long"))
    within = F.row_number().over(W.partitionBy(*key, "_range").orderBy(*sorting(order)))
    return parts.withColumn(name, F.col("_range") + within).drop("_range")


def running(rows: DataFrame, key: list[str], order: list[str], value: str, cum: str = "cum", prev: str = "prev", most: int | None = None) -> DataFrame:
    """rows with cum, the running sum of value within the key, this row included, and prev, the one of the row before (0 for the
    first). prev is the same number as that row's cum, also where that row is in another range."""
    return _running(rows, key, order, value, cum, prev, most, F.sum, lambda a, b: a + b, 0)


def running_max(rows: DataFrame, key: list[str], order: list[str], value: str, cum: str = "cum", prev: str = "prev", most: int | None = None) -> DataFrame:
    """rows with cum, the greatest value so far within the key, this row included, and prev, that of the rows before (null for the first)."""
    return _running(rows, key, order, value, cum, prev, most, F.max, F.greatest, None)


def _running(rows, key, order, value, cum, prev, most, total, both, start) -> DataFrame:
    parts, cut = ranged(rows, key, order, most)
    if not cut:
        w = W.partitionBy(*key).orderBy(*sorting(order))
        found = rows.withColumn(cum, total(value).over(w.rowsBetween(W.unboundedPreceding, 0)))
        return found.withColumn(prev, F.coalesce(F.lag(cum).over(w), F.lit(start).cast(dict(found.dtypes)[cum])))
    sums, whole = parts.groupBy(*key, "_range").agg(total(value).alias("_sum")), W.partitionBy(*key).orderBy("_range")
    first = F.lit(start).cast(dict(sums.dtypes)["_sum"])
    sums = sums.withColumn("_end", total(F.coalesce("_sum", first)).over(whole.rowsBetween(W.unboundedPreceding, 0)))
    sums = sums.withColumn("_begin", F.coalesce(F.lag("_end").over(whole), first)).drop("_sum")
    w = W.partitionBy(*key, "_range").orderBy(*sorting(order))
    last = F.lead(F.lit(1)).over(w).isNull()
    here = both(F.col("_begin"), F.coalesce(total(value).over(w.rowsBetween(W.unboundedPreceding, 0)), first))
    found = _beside(parts, sums, key).withColumn(cum, F.when(last, F.col("_end")).otherwise(here))
    return found.withColumn(prev, F.coalesce(F.lag(cum).over(w), F.col("_begin"))).drop("_range", "_begin", "_end")


def neighbours(rows: DataFrame, key: list[str], order: list[str], before: dict[str, str], after: dict[str, str] | None = None, most: int | None = None) -> DataFrame:
    """rows with columns of the row before (name: column) and of the row after; null at a key's ends."""
    after = after or {}
    parts, cut = ranged(rows, key, order, most)
    if not cut:
        w = W.partitionBy(*key).orderBy(*sorting(order))
        return rows.withColumns({n: F.lag(c).over(w) for n, c in before.items()} | {n: F.lead(c).over(w) for n, c in after.items()})
    w = W.partitionBy(*key, "_range").orderBy(*sorting(order))
    edge = parts.withColumns({"_head": F.row_number().over(w) == 1, "_tail": F.lead(F.lit(1)).over(w).isNull()})
    at = {c: f"_c{i}" for i, c in enumerate(sorted({*before.values(), *after.values()}))}
    row = F.struct(*[F.col(c).alias(n) for c, n in at.items()])
    ends = edge.groupBy(*key, "_range").agg(F.max(F.when(F.col("_head"), row)).alias("_h"), F.max(F.when(F.col("_tail"), row)).alias("_l"))
    whole = W.partitionBy(*key).orderBy("_range")
    ends = ends.withColumns({"_left": F.lag("_l").over(whole), "_right": F.lead("_h").over(whole)}).drop("_h", "_l")
    columns = {n: F.when(F.col("_head"), F.col(f"_left.{at[c]}")).otherwise(F.lag(c).over(w)) for n, c in before.items()}
    columns |= {n: F.when(F.col("_tail"), F.col(f"_right.{at[c]}")).otherwise(F.lead(c).over(w)) for n, c in after.items()}
    return _beside(edge, ends, key).withColumns(columns).drop("_range", "_head", "_tail", "_left", "_right")
