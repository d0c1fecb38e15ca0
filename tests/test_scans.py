"""Windows in ranges, interval joins and matching by rounds, against versions that go row by row."""

from __future__ import annotations

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessitura.operators import corpus, frames, matching, scans
from tessitura.operators.matching import match_speakers
from tessitura.plans.registry import QUERIES


def hot(n: int = 700, seed: int = 1):
    """Rows of which a third and more have one key, and many one time."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        day = datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=rng.choice([0, 5, rng.random() * 1e6]))
        rows.append((rng.choice(["a", "a", "a", "b", None, f"k{i % 9}"]), rng.choice([None, 0.0, -2.5, 7.25, rng.random() * 10 ** rng.randrange(-8, 8)]), day, rng.choice(["x", "xy", "", None, "é"]), i, float(rng.randrange(9))))
    return rows


SCHEMA = "k string, x double, t timestamp, s string, i int, v double"


def by_key(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return groups


def key_of(order):
    def one(row, c, falling):
        v = row["kxtsiv".index(c)]
        v = v.encode() if isinstance(v, str) else v
        return (v is None) if falling else (v is not None), (Falling(v) if falling else v) if v is not None else 0

    return lambda row: [one(row, o.lstrip("-"), o.startswith("-")) for o in order]


class Falling:
    def __init__(self, v):
        self.v = v

    def __lt__(self, other):
        return other.v < self.v

    def __eq__(self, other):
        return other.v == self.v


@pytest.mark.parametrize("order,most", [(["t", "i"], 60), (["-x", "i"], 60), (["s", "-i"], 10_000)])
def test_windows_in_ranges_equal_plain_ones(spark, order, most):
    rows = hot(300)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    ranks = {r.i: r["rank"] for r in scans.ranked(df, ["k"], order, most=most).collect()}
    sums = {r.i: (r.cum, r.prev) for r in scans.running(df, ["k"], order, "v", most=most).collect()}
    tops = {r.i: (r.cum, r.prev) for r in scans.running_max(df, ["k"], order, "v", most=most).collect()}
    sides = {r.i: (r.b, r.a, r.n) for r in scans.neighbours(df, ["k"], order, {"b": "i", "n": "x"}, {"a": "s"}, most=most).collect()}
    for own in by_key(rows).values():
        total, top = 0.0, None
        own = sorted(own, key=key_of(order))
        for n, r in enumerate(own):
            before, after = (own[n - 1] if n else None), (own[n + 1] if n + 1 < len(own) else None)
            assert ranks[r[4]] == n + 1
            assert sums[r[4]] == pytest.approx((total + r[5], total)) and tops[r[4]] == (max(top or 0.0, r[5]), top)
            assert sides[r[4]] == (before and before[4], after and after[3], before and before[1])
            total, top = total + r[5], max(top or 0.0, r[5])
    assert len(ranks) == len(sums) == len(tops) == len(sides) == len(rows)


def test_a_hot_key_is_cut_into_ranges_of_bounded_size(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id", F.timestamp_seconds(F.col("id") % 1000).alias("t"))
    parts, cut = scans.ranged(df, ["k"], ["t", "id"], most=50)
    sizes = parts.groupBy("k", "_range").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", "id")).alias("hi")).collect()
    own = sorted((r for r in sizes if r.k == "hot"), key=lambda r: r["_range"])
    assert cut and max(r.n for r in sizes) <= 50 and len(own) > 50
    assert [r["_range"] for r in own] == [sum(x.n for x in own[:k]) for k in range(len(own))] and all(a.hi < b.lo for a, b in zip(own, own[1:], strict=False))
    assert scans.ranked(df.limit(0), ["k"], ["t"]).count() == 0


def one_after_another(big, small, threshold=0.05):
    """Pairs of one gender by the rule itself."""
    free, out = sorted(big), []
    for spk, d in sorted(small, key=lambda x: (-x[1], x[0])):
        near = min(free, key=lambda b: (abs(b[1] - d), b[0]))
        if abs(2 * (near[1] - d) / (near[1] + d)) > threshold:
            longer = [b for b in free if b[1] >= d]
            if not longer:
                return None
            near = min(longer, key=lambda b: (b[1], b[0]))
        free.remove(near)
        out.append((*near, spk, d))
    return out


def speakers(rng, spread, n_big, n_small):
    amount = lambda: float(rng.choice([rng.randint(90, 90 + spread), rng.randint(90, 95), 100])) * (1 + rng.choice([0, 0, 0.004, 0.04]))
    return [(f"b{i:02}", amount() * rng.choice([1, 1, 1.1, 3])) for i in range(n_big)], [(f"s{i:02}", amount()) for i in range(n_small)]


@pytest.mark.parametrize("seed,spread,n_big,n_small,look", [(1, 40, 20, 12, 1), (2, 1, 24, 16, 4)])
def test_matching_by_rounds_equals_one_after_another(spark, monkeypatch, seed, spread, n_big, n_small, look):
    monkeypatch.setattr("tessitura.operators.matching.LOOK", look)
    rng, big, small, want = random.Random(seed), [], [], []
    for g in ("f", "m"):
        while (pairs := one_after_another(*(sides := speakers(rng, spread, n_big, n_small)))) is None:
            pass
        big += [(g, *b) for b in sides[0]]
        small += [(g, *s) for s in sides[1]]
        want += [(g, *p) for p in pairs]
    schema = "gender string, spk string, amount double"
    got = match_speakers(spark.createDataFrame(big, schema).coalesce(1), spark.createDataFrame(small, schema).coalesce(1)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("limit", [1 << 17, 9, 0])
def test_matching_by_runs_equals_one_after_another(spark, monkeypatch, limit):
    monkeypatch.setattr("tessitura.operators.matching.RUN", limit)
    monkeypatch.setattr("tessitura.operators.matching.PACK", 5)
    if limit > 9:  # rounds are for long runs only
        monkeypatch.setattr("tessitura.operators.matching._in_rounds", None)
    rng, big, small, want = random.Random(7), [], [], []
    for g in ("f", "m"):
        while (pairs := one_after_another(*(sides := speakers(rng, 400 if g == "f" else 40, 70, 30)))) is None:
            pass
        big += [(g, *b) for b in sides[0]]
        small += [(g, *s) for s in sides[1]]
        want += [(g, *p) for p in pairs]
    schema = "gender string, spk string, amount double"
    got = match_speakers(spark.createDataFrame(big, schema), spark.createDataFrame(small, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_runs_keep_all_that_may_be_matched_and_one_after_another_is_the_rule(spark):
    rng, big, small = random.Random(11), [], []
    for k in range(300):
        sides = speakers(rng, rng.choice([1, 40, 400]), rng.randint(8, 40), rng.randint(1, 8))
        pairs = one_after_another(*sides)
        got = matching.matched(*([(a, n) for n, a in side] for side in sides), 0.05)
        assert sorted(got) == sorted(pairs) if pairs is not None else any(m[0] is None for m in got)
        if pairs is not None and k < 40:
            big += [(f"g{k}", *b) for b in sides[0]]
            small += [(f"g{k}", *s) for s in sides[1]]
    schema = "gender string, spk string, amount double"
    runs = matching._runs(spark.createDataFrame(big, schema), spark.createDataFrame(small, schema)).collect()
    assert sum(not r.is_big for r in runs) == len(small) and len({(r.gender, r.run) for r in runs}) > 60
    found = []
    for key in {(r.gender, r.run) for r in runs}:
        own = [[(r.amount, r.spk) for r in runs if (r.gender, r.run) == key and r.is_big == side] for side in (True, False)]
        found += [(key[0], *m) for m in matching.matched(*own, 0.05)]
    want = [(g, *m) for g in {b[0] for b in big} for m in one_after_another(*([r[1:] for r in side if r[0] == g] for side in (big, small)))]
    assert sorted(found) == sorted(want)


def test_matching_refuses_what_can_not_be_matched(spark):
    of = lambda *rows: spark.createDataFrame(list(rows), "gender string, spk string, amount double")
    with pytest.raises(ValueError, match="more small"):
        match_speakers(of(("f", "b", 9.0)), of(("f", "s", 1.0), ("f", "t", 1.0)))
    with pytest.raises(ValueError, match="more small"):
        match_speakers(of(("f", "b", 9.0)), of(("m", "s", 1.0)))
    with pytest.raises(ValueError, match="long enough for t"):
        match_speakers(of(("f", "b", 9.0), ("f", "c", 2.0)), of(("f", "s", 8.0), ("f", "t", 7.0)))
    assert match_speakers(of(("f", "b", 9.0)), of(("f", "b", 9.0)).limit(0)).count() == 0


def test_slices_trimming_and_splits_do_not_depend_on_ranges(spark, monkeypatch):
    rng = random.Random(8)
    rows = [("hot" if i % 3 else f"s{i % 4}", f"r{rng.randrange(6)}", i, float(i % 50), float(i % 50 + 1), float(rng.randint(1, 8))) for i in range(300)]
    utts = spark.createDataFrame(rows, "spk string, rec string, utt int, start double, stop double, duration double")
    goal = utts.groupBy("spk").agg((F.sum("duration") * 0.6).alias("target"))
    speakers = utts.select(F.col("utt").cast("string").alias("spk"), F.col("spk").alias("gender"), F.col("duration").alias("amount"))
    every = lambda: [sorted(map(tuple, d.collect())) for d in (corpus.subset_slices(utts, 5), corpus.trim(utts, goal).select("utt"), corpus.balanced_split(speakers), corpus.ranked_by_gender(speakers.drop("gender"), speakers))]
    whole = every()
    monkeypatch.setattr(scans, "MOST", 90)
    assert every() == whole


@pytest.mark.parametrize("inclusive", ["both", "left", "right", "neither"])
@pytest.mark.parametrize("most", [40, 1 << 17])
def test_frames_meet_the_segments_that_they_lie_in(spark, monkeypatch, inclusive, most):
    monkeypatch.setattr(scans, "MOST", most)
    rng = random.Random(2)
    segs = [(rng.choice(["r", "r", "q", None]), i, a := float(rng.randrange(40)), a + rng.choice([0, 0, 1, 3, 30, -1])) for i in range(30)]
    points = [(rng.choice(["r", "r", "r", "q", "z", None]), i, rng.choice([None, float(rng.randrange(-2, 75)), rng.random() * 72])) for i in range(200)]
    low = (lambda t, a: t >= a) if inclusive in ("both", "left") else (lambda t, a: t > a)
    high = (lambda t, b: t <= b) if inclusive in ("both", "right") else (lambda t, b: t < b)
    want = sorted((i, s) for r, i, t in points for q, s, a, b in segs if r is not None and r == q and t is not None and low(t, a) and high(t, b))
    f, s = spark.createDataFrame(points, "rec string, frame int, t double").coalesce(2), spark.createDataFrame(segs, "rec string, seg int, start double, stop double").coalesce(1)
    got = frames.frames_in_segments(f, s, inclusive=inclusive)
    assert got.columns == ["rec", "frame", "t", "seg", "start", "stop"] and sorted((r.frame, r.seg) for r in got.collect()) == want
    if most > 40:
        assert sorted((r.frame, r.seg) for r in frames.frames_in_segments(f, s, inclusive=inclusive, width=7.0).collect()) == want
    assert frames.frames_in_segments(f, s.limit(0)).count() == 0


def test_a_frame_on_a_shared_edge_is_in_both_segments_however_sums_are_rounded(spark, tmp_path):
    values = [3.99, 4.09, 0.3, 0.0, 1.13, 1.0, 1.0, 1.0]  # the sum before 1.13 is less than the sum with it less 1.13
    sums = list(itertools.accumulate(values))
    assert sums[4] - values[4] > sums[3]
    day = datetime.datetime(2020, 1, 1)
    events = [(k, day + datetime.timedelta(days=k), 1, "r", v, "") for k, v in enumerate(values)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["range_join_frames"](spark, str(tmp_path)).collect()
    assert sorted((r.frame, r.seg) for r in got) == sorted([*((k, k // 4) for k in range(8)), (3, 1)])


def test_no_frame_meets_a_segment_that_it_is_not_in(spark):
    f = spark.range(3000).select(F.lit("r").alias("rec"), F.col("id").alias("frame"), (F.col("id") / 100).alias("t"))
    s = spark.range(30).select(F.lit("r").alias("rec"), F.col("id").alias("seg"), F.col("id").cast("double").alias("start"), (F.col("id") + 1.0).alias("stop"))
    plan = frames.frames_in_segments(f, s)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "BETWEEN" not in plan
    assert frames.frames_in_segments(f, s).count() == 3000 + 29  # those on an edge are in two
