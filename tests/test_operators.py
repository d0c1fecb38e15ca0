from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import columns as C
from tessitura.operators import abx, corpus, frames, scans, summaries
from tessitura.plans.registry import QUERIES
from tessitura.sources.readers import Corpus


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def procedural_slices(utts, n):
    """Each speaker's utterances end to end, cut at n-ths of the total."""
    out = []
    total = sum(d for _, _, d in utts)
    for j in range(n):
        low, high, cum = j * total / n, (j + 1) * total / n, 0.0
        for utt, start, d in utts:
            if cum + d > low and cum < high:
                out.append((utt, j, start + max(0.0, low - cum), start + d - max(0.0, cum + d - high)))
            cum += d
    return out


def test_slices_equal_the_procedure(spark):
    rng = random.Random(0)
    utts, want = [], []
    for s in range(12):
        own = [(s * 100 + k, float(k * 10), rng.choice([0.25, 0.5, 1.0, 2.75, 3.0])) for k in range(rng.randint(1, 9))]
        utts += [(f"s{s}", u, a, a + d, d) for u, a, d in own]
        want += [(f"s{s}", u, j, a, b) for u, j, a, b in procedural_slices(own, 7)]
    got = corpus.subset_slices(spark.createDataFrame(utts, "spk string, utt int, start double, stop double, duration double"), 7)
    got = {(r.spk, r.utt, r.subset_id): (r.start, r.stop) for r in got.collect()}
    assert got.keys() == {w[:3] for w in want}
    assert all(got[w[:3]] == pytest.approx(w[3:], abs=1e-9) for w in want)


def procedural_trim(utts, target):
    """utts: (rec, start, utt, d). From the ends of recordings, the shortest first."""
    length = {r: sum(d for q, _, _, d in utts if q == r) for r, *_ in utts}
    current, gone = sum(length.values()), set()
    for rec, start, utt, d in sorted(utts, key=lambda u: (length[u[0]], u[0], -u[1])):
        if current <= target:
            break
        if current - d > target:
            gone.add(utt)
            current -= d
            continue
        if abs(target - current) > abs(target - (current - d)):
            gone.add(utt)
        break
    return {u[2] for u in utts} - gone


def test_trim_equals_the_procedure(spark):
    rng = random.Random(1)
    utts, targets, want = [], [], set()
    for s in range(40):
        own = [(f"r{r}", float(k), f"{s}-{r}-{k}", rng.randint(1, 16) / 4) for r in range(rng.randint(1, 4)) for k in range(rng.randint(1, 5))]
        target = rng.choice([0.0, 1.0, 3.25, sum(u[3] for u in own) * 0.5, 1e9])
        utts += [(f"s{s}", *u) for u in own]
        targets.append((f"s{s}", target))
        want |= procedural_trim(own, target)
    u = spark.createDataFrame(utts, "spk string, rec string, start double, utt string, duration double")
    got = {r.utt for r in corpus.trim(u, spark.createDataFrame(targets, "spk string, target double")).collect()}
    assert got == want


def test_a_joined_row_makes_few_triplets_at_once(spark, monkeypatch):
    held = []
    monkeypatch.setattr(abx, "saved", lambda df: held.append(df) or df)
    found = abx.triplets(spark.range(600).selectExpr("id", "int(id % 600 > 1) AS phone"), "phone", [])
    assert held[0].agg(F.max(F.size("_keys"))).first()[0] ** 3 <= 1 << 18
    assert found.count() == 598 * 597 * 2 + 2 * 598


def test_softmax_works_its_array_out_once(spark):
    drawn = spark.range(20).select(C.softmax(F.array(*[F.rand(k) for k in range(5)])).alias("p")).collect()
    assert [sum(r.p) for r in drawn] == pytest.approx([1.0] * 20)
    assert spark.sql("SELECT CAST(NULL AS ARRAY<DOUBLE>) AS v").select(C.softmax(F.col("v"))).first()[0] is None


def test_items_of_large_cells_are_sent_as_often_as_those_of_small_ones(spark, monkeypatch):
    sent, dealt = [], abx.tiled
    monkeypatch.setattr(abx, "tiled", lambda *args: sent.append(dealt(*args)) or sent[-1])
    monkeypatch.setattr(abx, "TILE", 5)
    items = spark.range(400).selectExpr("id", "IF(id % 50 = 7, NULL, array(double(id), double(id * id % 31))) AS x")
    got = {(r.i, r.j): r.d for r in abx.cell_distances(items, "euc", digits=6).collect()}
    assert sent[0].count() <= 400 * 16
    v = {r.id: r.x for r in items.collect()}
    assert got.keys() == set(itertools.combinations(range(400), 2))
    assert all((v[i] is None or v[j] is None) if d is None else d == pytest.approx(round(math.dist(v[i], v[j]), 6)) for (i, j), d in got.items())


def test_subset_slices_have_no_pieces_of_rounding(spark):
    utts = [(f"s{n}", k, n * k / 10, n * (k + 1) / 10, n / 10) for n in (1, 3, 7) for k in range(10)]
    got = rows(corpus.subset_slices(spark.createDataFrame(utts, "spk string, utt int, start double, stop double, duration double"), 10).select("spk", "utt", "subset_id"))
    assert got == sorted((f"s{n}", k, k) for n in (1, 3, 7) for k in range(10))


def test_nearest_equals_comparing_all(spark, monkeypatch):
    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), float("-inf"), 1e300, 0.0, -0.0]
    some = lambda n: [(rng.choice(["a", "b", "c"]), k, rng.choice([rng.randint(-40, 40) / 4, rng.choice(odd)])) for k in range(n)]
    for right in (some(60), [("a", 1, None), ("b", 2, float("nan")), ("b", 1, None)]):
        left, want = [*some(90), ("d", 99, 1.0), (None, 98, 1.0)], set()
        for on, k, v in left:
            def far(r):
                d = None if v is None or r[2] is None else abs(v - r[2])
                return (2, 0, r[1]) if d is None else (1, 0, r[1]) if math.isnan(d) else (0, d, r[1])

            own = [r for r in right if r[0] == on]
            want |= {(on, k, min(own, key=far)[1])} if own else set()
        schema = "g string, k int, v double"
        for most in (1 << 17, 7):
            monkeypatch.setattr(scans, "MOST", most)
            assert set(rows(corpus.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "g", "v", "k"))) == want


def test_match_speakers(spark):
    big = [("f", "b1", 10.0), ("f", "b2", 8.0), ("f", "b3", 20.0), ("m", "b4", 5.0), ("m", "b5", 30.0)]
    small = [("f", "s1", 9.9), ("f", "s2", 9.0), ("m", "s3", 6.0)]
    schema = "gender string, spk string, amount double"
    got = rows(corpus.match_speakers(spark.createDataFrame(big, schema), spark.createDataFrame(small, schema)).select("small_spk", "big_spk"))
    # s2's nearest free one is b2, but 12 % away and shorter, so the least longer one; b4 is too short for s3.
    assert got == [("s1", "b1"), ("s2", "b3"), ("s3", "b5")]
    with pytest.raises(Exception, match="long enough"):
        corpus.match_speakers(spark.createDataFrame([("m", "b", 1.0)], schema), spark.createDataFrame([("m", "s", 9.0)], schema)).collect()
    matches = corpus.match_speakers(spark.createDataFrame(big, schema), spark.createDataFrame(small, schema))
    assert set(corpus.twin_split(matches, group_size=2, train=1).columns) >= {"part", "small_spk"}


def test_matching_corpora_trims_the_longer(spark):
    schema = "utt string, spk string, rec string, start double, duration double"
    big = spark.createDataFrame([(f"b{i}", "B", f"r{i}", 0.0, 1.0 + i) for i in range(4)] + [("x", "other", "r", 0.0, 9.0)], schema)
    small = spark.createDataFrame([("s", "S", "q", 0.0, 7.0)], schema)
    matches = spark.createDataFrame([("f", "B", 10.0, "S", 7.0)], "gender string, big_spk string, big_amount double, small_spk string, small_amount double")
    a, b = corpus.matching_corpora(big, small, matches)
    assert {r.utt for r in a.collect()} == {"b2", "b3"} and b.count() == 1


def test_balanced_split_shares(spark):
    s = spark.createDataFrame([("f", f"f{i:02}", float(i)) for i in range(11)] + [("m", f"m{i}", float(i)) for i in range(6)], "gender string, spk string, amount double")
    got = {(r.gender, r.part): r["count"] for r in corpus.balanced_split(s, group_size=3, train=2).groupBy("gender", "part").count().collect()}
    assert got == {("f", "train"): 8, ("f", "test"): 3, ("m", "train"): 4, ("m", "test"): 2}


def test_aligned_subcorpus_refuses_unknown_utterances(spark):
    c = Corpus("c", spark.createDataFrame([("u1", "r", 0.0, 1.0), ("u2", "r", 1.0, 2.0)], "utt string, rec string, start double, stop double"), spark.createDataFrame([("u1", "a"), ("u2", "b")], "utt string, spk string"))
    one = corpus.aligned_subcorpus(c, spark.createDataFrame([("u2",)], "utt string"), "d")
    assert rows(one.segments.select("utt")) == [("u2",)] and rows(one.utt2spk) == [("u2", "b")]
    assert rows(corpus.speakers_subcorpus(c, spark.createDataFrame([("a",)], "spk string"), "e").segments.select("utt")) == [("u1",)]
    with pytest.raises(ValueError, match="lacks"):
        corpus.aligned_subcorpus(c, spark.createDataFrame([("u9",)], "utt string"), "d")


def test_threshold_cells(spark):
    items = spark.createDataFrame([(c, i) for c, n in (("a", 1), ("b", 2), ("c", 5), ("d", 9)) for i in range(n)], "cell string, i int")
    got = {r.cell: r["count"] for r in corpus.threshold_cells(items, ["cell"], 2, 5).groupBy("cell").count().collect()}
    assert got == {"b": 2, "c": 5, "d": 5}


@pytest.mark.parametrize("width", [None, 1.0, 0.3])
def test_frames_on_a_shared_edge_are_in_both(spark, width):
    f = spark.createDataFrame([("r", i, i * 0.25, [float(i)]) for i in range(13)], "rec string, frame int, t double, x array<double>")
    s = spark.createDataFrame([("u1", "r", 0.5, 1.5), ("u2", "r", 1.5, 2.0), ("u3", "q", 0.0, 9.0)], "utt string, rec string, start double, stop double")
    got = rows(frames.frames_in_segments(f, s, width=width).select("utt", "frame"))
    assert got == sorted([("u1", i) for i in range(2, 7)] + [("u2", i) for i in (6, 7, 8)])
    assert frames.frames_in_segments(f, s, inclusive="left", width=width).count() == 6
    cut = frames.utterance_frames(f.withColumnRenamed("rec", "item"), s)
    assert rows(cut.where("item = 'u2'").select("frame", "t")) == [(0, 0.0), (1, 0.25), (2, 0.5)]


def test_rebase_rejects_stray_frames(spark):
    s = spark.createDataFrame([("u", 1.0, 2.0)], "utt string, start double, stop double")
    ok = spark.createDataFrame([("u", 1.0), ("u", 1.5)], "utt string, t double")
    assert rows(frames.rebase(ok, s)) == [("u", 0.0), ("u", 0.5)]
    with pytest.raises(Exception, match="outside"):
        frames.rebase(spark.createDataFrame([("u", 2.5)], "utt string, t double"), s).collect()


def test_recordings_as_utterances(spark):
    u = spark.createDataFrame([("a_1", "a"), ("b_1", "b"), ("b_1", "b")], "rec string, spk string")
    assert rows(frames.recordings_as_utterances(u)) == [("a_1", "a_1", "a"), ("b_1", "b_1", "b")]
    v = spark.createDataFrame([("1", "a")], "rec string, spk string")
    assert rows(frames.recordings_as_utterances(v)) == [("a_1", "1", "a")]
    with pytest.raises(Exception, match="several"):
        frames.recordings_as_utterances(spark.createDataFrame([("1", "a"), ("1", "b")], "rec string, spk string")).collect()


def test_recodes(spark):
    df = spark.createDataFrame([("gmm_x_subsets10-3_iter1501-final",), ("gmm_x_subsets100-12_iter21",)], "name string")
    got = df.select(*[c.alias(n) for n, c in C.parse_model_name(F.col("name")).items()])
    assert rows(got) == [(10, 3, 1501), (100, 12, 21)]
    with pytest.raises(Exception, match="not a model name"):
        spark.createDataFrame([("a_b",)], "name string").select(C.parse_model_name(F.col("name"))["subset"]).collect()
    g = spark.createDataFrame([(5,), (10,), (11,), (100,), (101,), (250,)], "e int").select(C.subcorpus_group(F.col("e")))
    assert sorted(r[0] for r in g.collect()) == [2, 2, 3, 5, 10, 11]
    amount = spark.createDataFrame([("a", 10), ("z", 1)], "c string, f int").select(C.amount(F.col("c"), {"a": 20.0}, F.col("f")))
    assert rows(amount) == [(2.0,), (None,)]
    n = spark.createDataFrame([("x__mfccFEAT__kl_dtwDIS",)], "n string").select(*C.result_name_parts(F.col("n")).values())
    assert rows(n) == [("x__mfcc", "kl_dtw")]
    assert spark.range(1).select(C.bits(F.log(F.lit(8.0)))).first()[0] == pytest.approx(3.0)


def brute_warp(x, y, d):
    best = {}
    for i, j in itertools.product(range(len(x)), range(len(y))):
        prev = [best[p] for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p in best] or [(0.0, 0)]
        c, n = min(prev)
        best[i, j] = (c + d(x[i], y[j]), n + 1)
    return best[len(x) - 1, len(y) - 1]


@pytest.mark.parametrize("distance", ["euc", "cos", "kl"])
def test_warping_equals_dynamic_programming(distance):
    rng = np.random.default_rng(0)
    frame = {"euc": lambda a, b: float(np.linalg.norm(a - b)), "cos": lambda a, b: math.acos(min(1, float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)))) / math.pi, "kl": lambda a, b: float(((a - b) * (np.log(a) - np.log(b))).sum())}[distance]
    for n, m in ((1, 1), (1, 5), (4, 3), (9, 12)):
        x, y = rng.dirichlet(np.ones(4), n), rng.dirichlet(np.ones(4), m)
        cost, length = brute_warp(x, y, frame)
        assert abx.warped(x, y, distance, False) == pytest.approx(cost, abs=1e-6)
        assert abx.warped(x, y, distance, True) == pytest.approx(cost / length, abs=1e-6)


def test_pairs_of_any_lengths_step_together(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = {i: rng.dirichlet(np.ones(3), i % 4).tolist() for i in range(13)} | {13: None}
    seq = spark.createDataFrame(list(x.items()), "id int, x array<array<double>>").coalesce(1)
    monkeypatch.setattr(abx, "CELLS", 30)
    got = {(r.i, r.j): r.d for r in abx.sequence_distances(abx.all_pairs(seq), seq, "kl").collect()}
    assert len(got) == 14 * 13 // 2
    for (i, j), d in got.items():
        if not x[i] or not x[j]:
            assert d is None
        else:
            cost, n = brute_warp(np.array(x[i]), np.array(x[j]), lambda a, b: float(((a - b) * (np.log(a) - np.log(b))).sum()))
            assert d == pytest.approx(cost / n)


def test_dtw_distance_query_equals_dynamic_programming(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = [(i, [float(v) for v in rng.normal(size=64)], int(rng.integers(3))) for i in range(30)] + [(33, [1.0] * 64, 9)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    vectors = {i: np.array(v, np.float32).astype(float).reshape(8, 8) for i, v, _ in data}
    phone = {i: p for i, _, p in data}
    task = {(a, b, x) for a, b, x in itertools.permutations(phone, 3) if a % 5 == b % 5 == x % 5 and phone[a] == phone[x] != phone[b]}
    asked = {tuple(sorted(p)) for a, b, x in task for p in ((a, x), (b, x))}
    angle = lambda a, b: math.acos(max(-1, min(1, float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))))) / math.pi
    got = {(r.i, r.j): r.d for r in QUERIES["dtw_distance"](spark, str(tmp_path)).collect()}
    assert set(got) == asked
    for (i, j), d in got.items():
        cost, n = brute_warp(vectors[i], vectors[j], angle)
        assert d == pytest.approx(cost / n, abs=1e-6)


def test_sequences_of_two_tiles_are_prepared_once_not_for_each_pair(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = ([rng.dirichlet(np.ones(3), k % 4) if k % 7 else None for k in range(n)] for n in (40, 31))
    r, c = (m.ravel() for m in np.meshgrid(np.arange(40), np.arange(31), indexing="ij"))
    frames, norm = [], np.linalg.norm
    monkeypatch.setattr(np.linalg, "norm", lambda v, *a, **b: frames.append(v.size // v.shape[-1]) or norm(v, *a, **b))
    monkeypatch.setattr(abx, "STEP", 50, raising=False)
    got = abx.sequence_matrix(x, y, r, c, "cos")
    assert sum(frames) <= 8 * sum(len(v) for v in (*x, *y) if v is not None)  # each pair's frames before
    monkeypatch.undo()
    angle = lambda a, b: math.acos(max(-1, min(1, float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))))) / math.pi
    for i, j, d in zip(r, c, got, strict=True):
        if x[i] is None or y[j] is None or not len(x[i]) or not len(y[j]):
            assert math.isnan(d)
        else:
            cost, n = brute_warp(x[i], y[j], angle)
            assert d == pytest.approx(cost / n, abs=1e-6)


def test_distances_that_are_there_are_not_made_again(spark, tmp_path):
    rng = random.Random(5)
    frames_of = lambda: [[rng.random() + 0.1 for _ in range(3)] for _ in range(rng.randint(1, 4))]
    stimuli = spark.createDataFrame([(i, frames_of()) for i in range(5)], "id long, x array<array<double>>")
    first = abx.precompute_distances({"gmm": stimuli}, str(tmp_path), "kl_dtw")
    assert first == {"gmm": f"{tmp_path}/gmmFEAT__kl_dtwDIS"} and spark.read.parquet(first["gmm"]).count() == 10
    fewer = stimuli.where("id < 2")
    again = abx.precompute_distances({"gmm": fewer, "hmm": fewer}, str(tmp_path), "kl_dtw")
    assert [spark.read.parquet(again[name]).count() for name in ("gmm", "hmm")] == [10, 1]


def test_triplets_counts_and_scores(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("abc"), rng.choice("xy"), [rng.random(), rng.random()]) for i in range(24)]
    items = spark.createDataFrame(data, "id int, phone string, speaker string, x array<double>")
    want = sorted((s, a, b, x) for a, pa, s, _ in data for x, px, sx, _ in data if sx == s and px == pa and x != a for b, pb, sb, _ in data if sb == s and pb != pa)
    task = abx.triplets(items, "phone", ["speaker"])
    assert rows(task.select("speaker", "a", "b", "x")) == sorted(want, key=repr)
    assert sum(r.n_triplets for r in abx.triplet_counts(items, "phone", ["speaker"]).collect()) == len(want)
    assert rows(abx.task_pairs(items, "phone", ["speaker"])) == rows(abx.needed_pairs(task))
    lone = items.where("id < 9").withColumn("speaker", F.col("id") % 4)  # cells of two and three: some pairs are not asked for
    assert rows(abx.task_pairs(lone, "phone", ["speaker"])) == rows(abx.needed_pairs(abx.triplets(lone, "phone", ["speaker"])))
    assert abx.task_pairs(items.limit(0), "phone", ["speaker"]).count() == 0
    d = abx.vector_distances(abx.needed_pairs(task), items, "euc")
    v = {i: np.array(x) for i, _, _, x in data}
    dist = lambda i, j: float(np.linalg.norm(v[i] - v[j]))
    score = sum(1 if dist(a, x) < dist(b, x) else -1 if dist(a, x) > dist(b, x) else 0 for _, a, b, x in want)
    assert abx.scored(task, d).agg(F.sum("score")).first()[0] == score
    ab = abx.contrast_errors(abx.analysed(abx.scored(task, d), ["speaker"]), ["speaker"], F.when(F.col("on_a") == "a", "V").otherwise("C"))
    assert ab.count() == 4
    seq = items.withColumn("x", F.array("x", "x"))
    assert rows(abx.sequence_distances(abx.needed_pairs(task), seq, "dur").select("d").distinct()) == [(0.0,)]


def test_triplets_of_one_cell_are_the_work_of_many_tasks(spark, monkeypatch):
    data = [(i, "aab"[i % 3], "s") for i in range(45)] + [(3, "a", "s"), (None, "a", "s"), (None, "b", "s"), (50, None, "s"), (51, "a", None), (52, "a", "t"), (53, "b", "t")]
    items = spark.createDataFrame(data, "id int, phone string, speaker string")
    same = lambda s, t: s is not None and s == t
    for by in (["speaker"], []):
        want = sorted(repr((*([s] if by else []), a, b, x, pa, pb)) for a, pa, s in data for x, px, sx in data if pa and (same(s, sx) or not by) and px == pa and None not in (a, x) and x != a for b, pb, sb in data if (same(s, sb) or not by) and pb and pb != pa)
        for bundle, listed in ((abx.BUNDLE, abx.LISTED), (5, 500)):
            monkeypatch.setattr(abx, "LISTED", listed)
            found = abx.triplets(items, "phone", by, bundle=bundle)
            assert sorted(repr(tuple(r)) for r in found.collect()) == want and found.columns == [*by, "a", "b", "x", "on_a", "on_b"]
    parts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) >= 8 and max(parts) < len(want) / 3
    assert abx.triplets(items.limit(0), "phone", ["speaker"]).count() == 0


def test_unit_runs(spark):
    u = spark.createDataFrame([("i", k, k * 0.01, [1.0 if x == c else 0.0 for x in "abc"]) for k, c in enumerate("aabbbac")], "item string, frame int, t double, post array<double>")
    runs = abx.unit_runs(abx.dominant_unit(u))
    assert rows(runs) == [("i", 0, 0, 2), ("i", 0, 5, 1), ("i", 1, 2, 3), ("i", 2, 6, 1)]
    assert rows(abx.activation_durations(abx.dominant_unit(u), 1)) == [(0, 1, 0.02), (1, 1, 0.03)]


def test_summaries(spark):
    df = spark.createDataFrame([("m", "C", "L", 1.0), ("m", "C", "L", 3.0), ("m", "V", "L", 10.0), ("m", "V", None, 99.0)], "model_type string, contrast_type string, cond string, error double")
    means = summaries.by_condition(df, ["cond"], ["error"])
    assert rows(means) == [("m", "C", "L", 2.0), ("m", "V", "L", 10.0)]
    assert rows(summaries.consonants_and_vowels(means, ["cond"], ["error"])) == [("m", "L", 6.0)]
    boots = summaries.bootstrap(spark.range(300).withColumn("v", F.col("id") % 10), 200, F.col("id"))
    per = boots.groupBy("boot_id").agg(summaries.weighted_mean("v").alias("v"), F.sum("times").alias("n"))
    stats = per.agg(F.avg("v"), F.stddev("v"), F.avg("n")).first()
    assert abs(stats[0] - 4.5) < 0.1 and abs(stats[1] - 2.87 / 300**0.5) < 0.04 and abs(stats[2] - 300) < 5
    one = summaries.with_std(spark.createDataFrame([("a", 1.0)], "k string, v double"), spark.createDataFrame([("a", 1.0)], "k string, v double"), ["k"], "v")
    assert one.first()["std"] is None
    with pytest.raises(Exception, match="unknown id"):
        summaries.lookup(spark.createDataFrame([("z",)], "k string"), spark.createDataFrame([("a", 1)], "k string, size int"), "k").collect()
    parts = summaries.split_by(spark.createDataFrame([(True,), (False,), (True,)], "f boolean"), "f")
    assert (parts[True].count(), parts[False].count()) == (2, 1)


def test_sets_that_are_none_have_no_condition(spark):
    cases = [("None", "WSJ", "NA"), ("WSJ", "None", "NA"), ("None", "None", "NA"), (None, "WSJ", "NA"), ("WSJ", "WSJ", "same C"), ("WSJ", "BUC", "same L diff R"), ("GPJ", "WSJ", "diff L same R"), ("CSJ", "WSJ", "diff L diff R")]
    part = lambda name, k: F.coalesce(C.recode(F.col(name), {c: v[k] for c, v in C.CORPORA.items()}), F.lit("None"))
    df = spark.createDataFrame(cases, "x string, y string, cond string")
    got = df.withColumn("got", C.train_test_match(part("x", 0), part("y", 0), part("x", 1), part("y", 1), F.col("x"), F.col("y"))).withColumn("tuned", C.tuning_condition(F.col("x"), part("x", 0)))
    assert all(r.got == r.cond for r in got.collect())
    assert {r.x: r.tuned for r in got.collect()} == {"None": "No language tuning", None: "No language tuning", "WSJ": "Am. Eng. native", "GPJ": "Jap. native", "CSJ": "Jap. native"}


def test_rank_scores_equal_those_of_all_triplets(spark):
    rng = random.Random(4)
    items = spark.createDataFrame([(i, rng.choice("abc"), rng.choice(["s", "t"]), [float(rng.randrange(3)), float(rng.randrange(2)) + 1]) for i in range(24)] + [(90, "lone", "u", [1.0, 2.0]), (91, None, "s", [1.0, 2.0])], "id int, phone string, speaker string, x array<double>")
    task = abx.triplets(items.where("phone is not null"), "phone", ["speaker"])
    for distance, tile in (("euc", 4), ("cos", 256)):
        pairs = abx.vector_distances(abx.needed_pairs(task), items, distance).withColumn("d", F.round("d", 6))
        near = abx.cell_distances(items, distance, "phone", ["speaker"], tile=tile).withColumn("d", F.round("d", 6))
        assert {(r.i, r.j): r.d for r in near.collect()} == pytest.approx({(r.i, r.j): r.d for r in pairs.collect()})
        want = {(r.speaker, r.on_a, r.on_b): (r.score, r.n, r.error) for r in abx.analysed(abx.scored(task, pairs), ["speaker"]).collect()}
        got = {(r.speaker, r.on_a, r.on_b): (r.score, r.n, r.error) for r in abx.rank_scores(near, ["speaker"]).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert rows(abx.task_pairs(items, "phone", ["speaker"], tile=3)) == rows(abx.needed_pairs(task))


@pytest.mark.parametrize("by", [["speaker"], []])
def test_cell_scores_equal_rank_scores_and_send_no_distances(spark, monkeypatch, by):
    rng = random.Random(9)
    data = [(i, rng.choice([1, 1, 1, 2, 3, None]), f"s{i % 2}", None if i % 13 == 0 else [float(rng.randint(1, 3)), float(rng.randint(1, 3))]) for i in range(90)] + [(90, 1, "lone", [1.0, 1.0])]
    items = spark.createDataFrame(data, "id long, phone int, speaker string, x array<double>")
    for distance, over in (("cos", by), ("euc", [])):
        near = abx.cell_distances(items.where("phone is not null"), distance, "phone", by).withColumn("d", F.round("d", 6))
        want = {tuple(r)[:-3]: tuple(r)[-3:] for r in abx.rank_scores(near.drop(*set(by) - set(over)), over).collect()}
        for held, block in ((1 << 24, 1 << 20), (200, 7)):
            monkeypatch.setattr(abx, "BLOCK", block)
            found = abx.cell_scores(items, distance, "phone", by, over=over, digits=6, held=held)
            got = {tuple(r)[:-3]: tuple(r)[-3:] for r in found.collect()}
            assert len(want) >= 6 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
            assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_an_item_is_sent_to_few_tiles_and_their_pairs_come_in_blocks(spark, monkeypatch):
    sent = []
    dealt = abx.tiled
    monkeypatch.setattr(abx, "tiled", lambda *a: sent.append(dealt(*a)) or sent[-1])
    items = spark.range(5000).select("id", (F.col("id") % 9).alias("phone"), F.array(F.rand(1), F.rand(2)).alias("x"))
    found = abx.cell_distances(items, "euc")
    assert sent[0].count() == 2 * 5000  # 20 times before
    monkeypatch.setattr(abx, "BLOCK", 1000)
    few = abx.cell_distances(items.where("id < 100"), "euc").cache()
    assert few.count() == 100 * 99 // 2 and few.where("i >= j").count() == 0 and found.columns == ["i", "j", "d"]


def test_tiles_deal_a_cell_to_many_tasks(spark):
    items = spark.range(600).select("id", (F.col("id") % 7).alias("phone"), F.lit("s").alias("speaker"), F.array(F.rand(1), F.rand(2)).alias("x"))
    dealt = abx.tiled(items, "phone", ["speaker"], tile=50)
    groups = dealt.groupBy("_p", "_q").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).collect()
    assert len(groups) == 12 * 13 // 2 and max(r.n for r in groups) < 600 / 3 and all(r.n == r.ids for r in groups)
    assert dealt.count() == 600 * 12  # an item is sent once for each pair of tiles that its own is in
    seq = items.limit(9).withColumn("x", F.transform(F.sequence(F.lit(0), (F.col("id") % 3).cast("int")), lambda k: F.array(k + F.col("id") + 1.0, F.lit(2.0))))
    seq = seq.withColumn("x", F.when(F.col("id") == 4, F.lit(None)).otherwise(F.col("x")))
    whole = {(r.i, r.j): r.d for r in abx.sequence_distances(abx.all_pairs(seq), seq, "cos").collect()}
    for tile in (2, 256):
        got = {(r.i, r.j): r.d for r in abx.cell_distances(seq, "cos", warp=True, tile=tile).collect()}
        assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k], abs=1e-9) if whole[k] is not None else got[k] is None for k in whole)


def test_bootstrap_sums_are_those_of_the_resampled_rows(spark):
    data = spark.createDataFrame([(i, rng_name, float(i % 11) if i % 9 else None) for i in range(240) for rng_name in (["a", None] if i % 2 else ["a"])], "id int, g string, v double")
    weight = lambda b, k: (k * 7 + b * 3) % 4
    got = {(r.g, r.boot_id): (r.times, r.total) for r in summaries.bootstrap_sums(data.repartition(3), 50, ["g"], "v", F.col("id"), weight).collect()}
    want: dict = {}
    for r in data.where("v is not null").collect():
        for b in range(50):
            if t := weight(b, r.id):
                n, s = want.get((r.g, b), (0, 0.0))
                want[r.g, b] = (n + t, s + t * r.v)
    assert got == want
    one, two = (summaries.bootstrap_sums(data.repartition(n), 400, ["g"], "v", F.col("id"), seed=5) for n in (1, 4))
    key = lambda d: sorted(((r.g or "", r.boot_id, r.times, r.total) for r in d.collect()))
    assert key(one) == key(two)
    stats = one.where("g = 'a'").agg(F.avg("times"), F.variance("times"), F.avg(F.col("total") / F.col("times"))).first()
    n = data.where("g = 'a' and v is not null").count()
    assert abs(stats[0] - n) < 4 * (n / 400) ** 0.5 and 0.7 * n < stats[1] < 1.35 * n and abs(stats[2] - 5) < 0.2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
