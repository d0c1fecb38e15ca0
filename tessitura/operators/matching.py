"""Matching of speakers of two corpora: longer ones choose first, each the nearest that is free.

One after another, that is the one stable matching in which everybody ranks the small speakers by their amount: each small
speaker asks the nearest big one that holds no longer small speaker, a big one holds the longest that asks, whoever is let go
asks again.

Nobody passes a free place, so places that stay free whatever happens cut the big speakers into runs that do not meet, and a
run of RUN speakers at most is matched one after another in a task: see :func:`_runs`. In longer ones all free ones ask at
once, so the rounds are as many as the longest chain of speakers that push each other on, and
no task sees more than its share of either side. Those that have nobody left below them are pushed on together: see
:func:`_pushed`.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, saved, ship
from . import scans

#: Big speakers that a small one looks at on each side in its first round, twice as many in each further one, and at most.
LOOK, MOST = 4, 1 << 12
#: Speakers of both sides of a run that is matched in one task, at most; short runs share a task of about PACK.
RUN, PACK = 1 << 17, 1 << 15


def match_speakers(big: DataFrame, small: DataFrame, gender: str = "gender", spk: str = "spk", amount: str = "amount", threshold: float = 0.05) -> DataFrame:
    """(gender, big_spk, big_amount, small_spk, small_amount): each small speaker's match, without replacement.

    Small speakers choose by falling amount, ties by name: the nearest free big one, ties by name. If that differs by more
    than the threshold, relatively, the least free one that is not shorter is taken instead. More small than big speakers of
    a gender, or none that is long enough, is an error.
    """
    of = lambda d: d.select(F.col(gender).cast("string").alias("gender"), F.col(spk).cast("string").alias("spk"), F.col(amount).cast("double").alias("amount"))
    big, small = saved(of(big)), saved(of(small))
    many = small.groupBy("gender").agg(F.count(F.lit(1)).alias("n")).join(big.groupBy("gender").agg(F.count(F.lit(1)).alias("m")), "gender", "left")
    if not many.where("n > coalesce(m, 0)").isEmpty():
        raise ValueError("there are more small than big speakers")
    number = ~F.isnan("amount") & F.col("amount").isNotNull()
    if not big.unionAll(small).where(~number).isEmpty():
        return _in_rounds(big, small, threshold)
    runs = saved(_runs(big, small))
    long = saved(runs.groupBy("gender", "run").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > RUN))
    if long.isEmpty():
        return _in_tasks(runs, threshold)
    rest = runs.join(long, ["gender", "run"], "left_semi").where("not is_big").select("gender", "spk", "amount")
    return _in_tasks(runs.join(long, ["gender", "run"], "left_anti"), threshold).unionByName(_in_rounds(big, saved(rest), threshold))


def _runs(big: DataFrame, small: DataFrame) -> DataFrame:
    """(gender, run, is_big, spk, amount): the small speakers and the big ones that they may be matched with, by run.

    Big speakers of the same amount are a level, from 1; a small one's gap is the number of levels below it. Levels from a to b
    that all have a match, between levels that have none, take small speakers with gaps from a - 1 to b only, at least one
    each. So a level p is surely free unless for some a <= p <= b there are b - a + 1 such speakers or more: with C(x) the number
    of gaps up to x and D(x) = C(x) - x, unless the greatest D from p on is at least the least D up to p - 2, less one.
    """
    levels = saved(scans.ranked(saved(big.select("gender", "amount").distinct()), ["gender"], ["amount"], "level"))
    both = levels.select("gender", "amount", F.lit(1).alias("is_level"), F.lit("").alias("spk")).unionAll(small.select("gender", "amount", F.lit(0), "spk"))
    gaps = scans.running(saved(both), ["gender"], ["amount", "is_level", "spk"], "is_level", "gap", "_p").where("is_level = 0")
    gaps = saved(gaps.select("gender", "spk", "amount", F.col("gap").cast("long").alias("gap")))
    at = levels.select("gender", F.col("level").alias("x"))
    at = at.unionAll(levels.where("level = 1").select("gender", F.explode(F.array(*[F.lit(x).cast("long") for x in (-1, 0)]))))
    counts = gaps.groupBy("gender", F.col("gap").alias("x")).agg(F.count(F.lit(1)).alias("_n"))
    at = scans.running(saved(at.join(counts, ["gender", "x"], "left").fillna(0, ["_n"])), ["gender"], ["x"], "_n", "_c", "_p")
    at = saved(at.select("gender", "x", (F.col("_c") - F.col("x")).alias("d"), (F.col("x") - F.col("_c")).alias("e")))
    at = saved(scans.running_max(at, ["gender"], ["-x"], "d", "ahead", "_p").select("gender", "x", "ahead", "e"))
    at = saved(scans.running_max(at, ["gender"], ["x"], "e", "_c", "behind").select("gender", "x", "ahead", "behind"))
    at = scans.neighbours(at, ["gender"], ["x"], {"least": "behind"}).where(F.col("ahead") >= -F.col("least") - 1)
    taken = scans.ranked(saved(at.where("x > 0").select("gender", "x")), ["gender"], ["x"], "k")
    taken = saved(taken.select("gender", F.col("x").alias("level"), (F.col("x") - F.col("k")).alias("run")))
    own = big.join(levels, ["gender", "amount"]).join(taken, ["gender", "level"]).select("gender", "run", F.lit(True).alias("is_big"), "spk", "amount")
    asks = gaps.withColumn("level", F.greatest("gap", F.lit(1).cast("long"))).join(taken, ["gender", "level"])
    return own.unionAll(asks.select("gender", "run", F.lit(False), "spk", "amount"))


def _in_tasks(runs: DataFrame, threshold: float) -> DataFrame:
    """The matches of runs, each made in one task, many short ones in the same."""
    ship(runs.sparkSession)
    parts = runs.count() // PACK + 1
    schema = "gender string, big_spk string, big_amount double, small_spk string, small_amount double"
    names = [c.split()[0] for c in schema.split(", ")]

    def each(rows: pa.Table) -> pa.Table:
        found: list[tuple] = []
        own: dict[tuple, tuple[list, list]] = {}
        for gender, run, is_big, spk, amount in zip(*[rows.column(c).to_pylist() for c in ("gender", "run", "is_big", "spk", "amount")], strict=True):
            own.setdefault((gender, run), ([], []))[is_big].append((amount, spk))
        for (gender, _), (small, big) in own.items():
            found += [(gender, *m) for m in matched(big, small, threshold)]
        columns = list(zip(*found, strict=True)) or [[]] * len(names)
        return pa.table({n: pa.array(c, pa.float64() if n.endswith("amount") else pa.string()) for n, c in zip(names, columns, strict=True)})

    dealt = runs.withColumn("_part", F.pmod(F.xxhash64("gender", "run"), F.lit(parts)))
    found = saved(dealt.groupBy("_part").applyInArrow(each, schema))
    stuck = found.where("big_spk is null").limit(1).collect()
    if stuck:
        raise ValueError(f"no speaker is long enough for {stuck[0].small_spk}")
    return found


def matched(big: list[tuple[float, str]], small: list[tuple[float, str]], threshold: float) -> list[tuple]:
    """(big name, big amount, small name, small amount) of (amount, name) lists, one after another; nulls where there is nobody."""
    levels = sorted({a for a, _ in big})
    place = {a: k for k, a in enumerate(levels)}
    free: list[list[str]] = [[] for _ in levels]
    for a, name in sorted(big, reverse=True):
        free[place[a]].append(name)  # the first by name is the last
    up, down = list(range(len(levels) + 1)), list(range(len(levels) + 1))  # down[k + 1] is for level k

    def root(to: list[int], k: int) -> int:
        top = k
        while to[top] != top:
            top = to[top]
        while to[k] != top:
            to[k], k = top, to[k]
        return top

    out = []
    for d, name in sorted(small, key=lambda s: (-s[0], s[1])):
        at = bisect_left(levels, d)
        near = []
        if (k := root(up, at)) < len(levels):
            near.append((abs(levels[k] - d), free[k][-1], k))
        if (k := root(down, at) - 1) >= 0:
            both = levels[k] + d
            if not both or abs(2 * (levels[k] - d) / both) <= threshold:
                near.append((abs(levels[k] - d), free[k][-1], k))
        if not near:
            out.append((None, None, name, d))
            continue
        k = min(near)[2]
        out.append((free[k].pop(), levels[k], name, d))
        if not free[k]:
            up[k], down[k + 1] = k + 1, k
    return out


def _in_rounds(big: DataFrame, small: DataFrame, threshold: float) -> DataFrame:
    """The matches of all small speakers by rounds."""
    # The k-th big speaker upwards, and downwards: of equally long ones the first by name is met first from either side.
    up = scans.ranked(big, ["gender"], ["amount", "spk"], "up")
    places = saved(scans.ranked(up, ["gender"], ["amount", "-spk"], "down").withColumnRenamed("spk", "big"))
    both = big.select("gender", "amount", F.lit(1).alias("is_big"), "spk").unionAll(small.select("gender", "amount", F.lit(0), "spk"))
    below = scans.running(saved(both), ["gender"], ["amount", "is_big", "spk"], "is_big", "_upto", "shorter").where("is_big = 0")
    state = saved(below.select("gender", "spk", F.col("amount").alias("d"), F.col("shorter").cast("long").alias("lo"), (F.col("shorter") + 1).cast("long").alias("hi"), F.lit(LOOK).alias("look"), F.lit(None).cast("long").alias("match")))
    sizes = places.groupBy("gender").agg(F.max("up").alias("last"))
    left = small.count()
    while left:
        asked = saved(_asking(state.where("match is null"), state, places, sizes, threshold))
        stuck = asked.where("choice is null and done").limit(1).collect()
        if stuck:
            raise ValueError(f"no speaker is long enough for {stuck[0].spk}")
        # Each big speaker holds the longest of those that ask it; only speakers that it prefers to its own do.
        first = asked.where("choice is not null").groupBy("gender", F.col("choice.up").alias("match")).agg(F.min(F.struct((-F.col("d")).alias("d"), "spk")).alias("won"))
        won = first.select("gender", F.col("won.spk").alias("spk"), "match")
        lost = state.join(won.select("gender", "match"), ["gender", "match"], "left_semi").select("gender", "spk", "d", "lo", "hi", "look", F.lit(None).cast("long").alias("match"))
        held = state.where("match is not null").join(won.select("gender", "match"), ["gender", "match"], "left_anti").select(state.columns)
        moved = asked.join(won, ["gender", "spk"], "left").select("gender", "spk", "d", "lo", "hi", "look", "match")
        old, state = state, saved(held.unionByName(lost).unionByName(moved))
        left = state.where("match is null").count()
        discard(old)
        discard(asked)
        if left:
            old, state = state, saved(_pushed(state))
            discard(old)
    found = state.join(places.select("gender", F.col("up").alias("match"), "big", "amount"), ["gender", "match"])
    return found.select("gender", F.col("big").alias("big_spk"), F.col("amount").alias("big_amount"), F.col("spk").alias("small_spk"), F.col("d").alias("small_amount"))


def _pushed(state: DataFrame) -> DataFrame:
    """state with the speakers that only look upwards at the places that they will not stay below.

    Whoever has a place L or looks upwards from it ends at L or above. If a longer one that looks from L or below ends above
    L, the shorter one ends above that: all places between were taken when the longer one chose. So along speakers of falling
    amount and rising L each ends a place above the one before at least: k + the greatest L - k so far for the k-th. Who has
    a place below that is free again.
    """
    upwards = state.where("lo = 0").withColumn("at", F.coalesce("match", "hi"))
    rising = scans.running_max(upwards, ["gender"], ["-d", "spk"], "at", "most", "before")
    line = rising.where("before is null or at >= before").select("gender", "spk", "d", "at")
    line = scans.ranked(line, ["gender"], ["-d", "spk"], "k").withColumn("x", F.col("at") - F.col("k"))
    ends = scans.running_max(line, ["gender"], ["-d", "spk"], "x", "top", "before").select("gender", "spk", (F.col("k") + F.col("top")).alias("least")).where("least > 0")
    both = state.join(ends, ["gender", "spk"], "left")
    on = F.col("least") > F.coalesce("match", "hi")
    return both.select("gender", "spk", "d", "lo", F.when(on, F.col("least")).otherwise(F.col("hi")).alias("hi"), "look", F.when(on, F.lit(None)).otherwise(F.col("match")).alias("match"))


def _asking(free: DataFrame, state: DataFrame, places: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """free with choice, the big speaker (distance, name, up) that each asks, and where to look on: lo, hi, look; done: there
    is nobody left to look at.

    lo and hi are the nearest places on either side that may still take the speaker: who holds a longer one never will again.
    A choice is made once somebody is found, or nobody is left, on both sides.
    """
    holders = state.where("match is not null").select("gender", F.col("match").alias("up"), F.col("d").alias("held"), F.col("spk").alias("holder"))
    seen = places.join(holders, ["gender", "up"], "left")
    near = free.join(sizes, "gender")
    above = near.where("hi <= last").select("gender", "spk", "d", F.explode(F.sequence("hi", F.least(F.col("hi") + F.col("look") - 1, F.col("last")))).alias("up"))
    under = near.where("lo > 0").select("gender", "spk", "d", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("lo") - F.col("look") + 1), F.col("lo"))).alias("down"))
    takes = F.col("held").isNull() | (F.col("d") > F.col("held")) | ((F.col("d") == F.col("held")) & (F.col("spk") < F.col("holder")))
    close = F.coalesce(F.abs(2 * (F.col("amount") - F.col("d")) / (F.col("amount") + F.col("d"))) <= threshold, F.lit(True))
    person = F.struct(F.abs(F.col("amount") - F.col("d")).alias("far"), "big", "up")
    # far falls towards the speaker on both sides, so the least of them is the nearest place
    up = above.join(seen, ["gender", "up"]).groupBy("gender", "spk").agg(F.min(F.when(takes, F.col("up"))).alias("at_up"), F.min(F.when(takes, person)).alias("up_one"))
    down = under.join(seen, ["gender", "down"]).groupBy("gender", "spk").agg(F.max(F.when(takes & close, F.col("down"))).alias("at_down"), F.min(F.when(takes & close, person)).alias("down_one"), F.bool_or(~close).alias("too_short"))
    found = near.join(up, ["gender", "spk"], "left").join(down, ["gender", "spk"], "left")
    none_above = F.col("hi") + F.col("look") > F.col("last")
    none_below = (F.col("lo") - F.col("look") < 1) | F.coalesce("too_short", F.lit(False))
    settled = (F.col("up_one").isNotNull() | none_above) & (F.col("down_one").isNotNull() | none_below)
    choice = F.when(settled, F.coalesce(F.least("up_one", "down_one"), "up_one", "down_one"))
    return found.select(
        "gender", "spk", "d", F.coalesce("at_down", F.when(none_below, F.lit(0)).otherwise(F.col("lo") - F.col("look"))).cast("long").alias("lo"),
        F.coalesce("at_up", F.when(none_above, F.col("last") + 1).otherwise(F.col("hi") + F.col("look"))).alias("hi"), F.least(F.col("look") * 2, F.lit(MOST)).alias("look"), choice.alias("choice"), (settled & choice.isNull()).alias("done"),
    )
