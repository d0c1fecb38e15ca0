from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessitura.mixture import posteriors, sequential
from tessitura.mixture.priors import DirichletMultinomial, NormalInverseWishart, Single, multi_lgamma, sample_categorical
from tessitura.mixture.sampler import Chain, Cluster, fit, log_split_ratio, superclusters
from tessitura.mixture.synthetic import gaussian_points, multinomial_docs


def stat_of(prior, rows):
    return prior.stats(rows, np.zeros(len(rows), int), 1)[0]


@pytest.mark.parametrize("prior", [NormalInverseWishart(np.zeros(3), np.eye(3)), DirichletMultinomial(4, 0.7)])
def test_marginal_is_the_product_of_predictives(prior):
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(7, 3)) if isinstance(prior, NormalInverseWishart) else rng.multinomial(6, [0.1, 0.2, 0.3, 0.4], 7).astype(float)
    one, total = Single(prior), 0.0
    for r in rows:
        total += one.predictive(r)
        one.add(r)
    assert prior.log_marginal(one.stat) == pytest.approx(total)
    one.remove(rows[0])
    assert one.stat == pytest.approx(stat_of(prior, rows[1:]))
    assert one.merged_marginal(Single(prior, stat_of(prior, rows[:1]))) == pytest.approx(total)


def test_draws_have_posterior_moments():
    rng = np.random.default_rng(1)
    prior = NormalInverseWishart(np.zeros(2), np.eye(2))
    rows = rng.multivariate_normal([3, -1], [[2, 0.6], [0.6, 1]], 4000)
    draws = [prior.draw(stat_of(prior, rows), rng) for _ in range(60)]
    assert np.mean([m for m, _ in draws], 0) == pytest.approx(rows.mean(0), abs=0.05)
    assert np.mean([s for _, s in draws], 0) == pytest.approx(np.cov(rows.T), abs=0.1)
    p = DirichletMultinomial(3).draw(np.array([1, 700.0, 200, 100, 0]), rng)[0]
    assert np.exp(p).sum() == pytest.approx(1) and np.exp(p) == pytest.approx([0.7, 0.2, 0.1], abs=0.06)


def test_functions():
    assert multi_lgamma(2.5, 1) == pytest.approx(math.lgamma(2.5)) and multi_lgamma(3.0, 2) == pytest.approx(0.5 * math.log(math.pi) + math.lgamma(3) + math.lgamma(2.5))
    rng = np.random.default_rng(2)
    z = sample_categorical(np.log([[0.2, 0.5, 0.3]] * 20000), rng)
    assert np.bincount(z) / 20000 == pytest.approx([0.2, 0.5, 0.3], abs=0.02)
    niw = NormalInverseWishart(np.zeros(2), np.eye(2))
    p, q = (np.zeros(2), np.eye(2)), (np.ones(2), 2 * np.eye(2))
    assert niw.divergence(p, p) == pytest.approx(0) and niw.divergence(p, q) == pytest.approx(niw.divergence(q, p))
    sparse = DirichletMultinomial(5).matrix(pd.Series([{1: 2, 4: 1}, [0, 2, 0, 0, 1], [(1, 2), (4, 1)]]))
    assert (sparse == [0, 2, 0, 0, 1]).all()


def test_statistics_equal_a_recount(spark):
    points = gaussian_points(spark, 300, 3, 3).withColumns({"z": F.col("truth"), "side": (F.col("pid") % 2).cast("int")})
    prior = NormalInverseWishart(np.zeros(3), np.eye(3))
    pdf = points.toPandas()
    for r in posteriors.component_stats(points.repartition(5), prior).collect():
        own = pdf[(pdf.z == r.z) & (pdf.side == r.side)]
        assert np.array(r.stat) == pytest.approx(stat_of(prior, np.stack(own.x)))
    mean, cov = posteriors.global_moments(points)
    assert mean == pytest.approx(np.stack(pdf.x).mean(0)) and cov == pytest.approx(np.cov(np.stack(pdf.x).T))
    random_z = points.withColumn("z", (F.col("pid") * 7919 % 3).cast("int"))
    assert posteriors.label_log_likelihood(points, prior) > posteriors.label_log_likelihood(random_z, prior)


def test_posteriors_sum_to_one_and_equal_the_density(spark):
    model = spark.createDataFrame([(0, math.log(0.3), [0.0, 0.0], [[1.0, 0.2], [0.2, 1.0]]), (1, math.log(0.7), [3.0, 1.0], [[2.0, 0.0], [0.0, 0.5]])], "component int, log_weight double, mean array<double>, cov array<array<double>>")
    frames = spark.createDataFrame([("i", 0, [0.5, 0.1]), ("i", 1, [2.5, 1.0]), ("j", 0, [90.0, -90.0])], "item string, frame int, x array<double>")
    for r in posteriors.posteriors(frames, model).collect():
        x = np.array(r.x)
        like = [w * math.exp(-0.5 * (x - m) @ np.linalg.inv(s) @ (x - m)) / math.sqrt(np.linalg.det(s)) for w, m, s in ((0.3, np.zeros(2), np.array([[1, 0.2], [0.2, 1]])), (0.7, np.array([3, 1.0]), np.diag([2, 0.5])))]
        assert sum(r.post) == pytest.approx(1)
        if r.item == "i":
            assert r.post == pytest.approx(np.array(like) / sum(like))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[-12, 0], [12, 0]])
    return spark.createDataFrame([(i, (centres[i % 2] + rng.normal(size=2)).tolist(), i % 2) for i in range(360)], "pid long, x array<double>, truth int")


@pytest.mark.parametrize("grouped", [False, True])
def test_chain_keeps_counts(spark, blobs, grouped):
    mean, cov = posteriors.global_moments(blobs)
    chain = Chain(blobs, NormalInverseWishart(mean, cov), k=3, seed=3, grouped=grouped)
    start = chain.log_likelihood()
    chain.run(4)
    assert sum(c.n for c in chain.clusters) == 360 and chain.log_likelihood() > start - 1
    recount = {r.z: r["count"] for r in chain.points.groupBy("z").count().collect()}
    assert recount == {i: c.n for i, c in enumerate(chain.clusters) if c.n}
    assert chain.trace_table().count() == 4 and abs(sum(math.exp(r.log_weight) for r in chain.model().collect()) - 1) < 1e-9


@pytest.mark.parametrize("seed", [1, 4])
def test_chain_finds_two_groups_from_one(blobs, seed):
    mean, cov = posteriors.global_moments(blobs)
    chain = Chain(blobs, NormalInverseWishart(mean, cov), k=1, seed=seed)
    while chain.step < 100 and len(chain.clusters) < 2:
        chain.run(1)
    chain.run(8)
    found = chain.points.join(blobs.select("pid", "truth"), "pid").groupBy("z", "truth").count().toPandas()
    assert found.z.nunique() >= 2 and found.groupby("z")["count"].max().sum() >= 355


def test_diagonal_posteriors_are_the_same_packed_and_joined(spark, monkeypatch):
    rng = np.random.default_rng(4)
    means, variances, w = rng.normal(size=(5, 3)), rng.uniform(0.5, 2, (5, 3)), rng.dirichlet(np.ones(5))
    model = spark.createDataFrame([(k, math.log(w[k]), means[k].tolist(), variances[k].tolist()) for k in range(5)], "component int, log_weight double, mean array<double>, var array<double>")
    x = rng.normal(size=(40, 3))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pid long, x array<double>")
    joint = np.log(w) - 0.5 * (((x[:, None] - means) ** 2 / variances) + np.log(2 * math.pi * variances)).sum(2)
    want = np.exp(joint - np.logaddexp.reduce(joint, 1)[:, None])
    for most in (posteriors.MODEL_BYTES, 0):
        monkeypatch.setattr(posteriors, "MODEL_BYTES", most)
        out = posteriors.diagonal_posteriors(points, model, "pid")
        got = {(r.pid, r.component): r.post for r in out.collect()}
        assert len(got) == 200 and all(p == pytest.approx(want[k]) for k, p in got.items())
        assert {r.pid: r.component for r in posteriors.hard_labels(out, "pid").collect()} == dict(enumerate(want.argmax(1)))
    monkeypatch.undo()
    assert posteriors.diagonal_posteriors(points, model.limit(0), "pid").count() == 0


def test_chain_goes_on_from_a_checkpoint(spark, blobs, tmp_path):
    prior = NormalInverseWishart(np.zeros(2), np.eye(2))
    chain = fit(blobs, prior, steps=3, folder=str(tmp_path), k=3, seed=1)
    again = Chain.load(spark, str(tmp_path / "4"), prior, seed=1)
    assert again.step == 3 and [c.n for c in again.clusters] == [c.n for c in chain.clusters]
    again.run(1)
    assert [t[0] for t in again.trace] == [1, 2, 3, 4] and sum(c.n for c in again.clusters) == 360


def test_finite_and_multinomial_chains(spark):
    docs = multinomial_docs(spark, 150, 12, 3, seed=2, most_words=60)
    prior = DirichletMultinomial(12)
    chain = Chain(docs, prior, k=6, kind="finite", spread_alpha=False).run(3)
    assert len(chain.clusters) == 6 and sum(c.n for c in chain.clusters) == 150
    dp = Chain(docs, prior, k=2, seed=1).run(6)
    assert dp.log_likelihood() > dp.trace[0][2] - 1 and dp.model().columns[-1] == "log_p"


def test_random_splits_keep_all_points(spark, blobs):
    chain = Chain(blobs, NormalInverseWishart(np.zeros(2), np.eye(2)), k=1, seed=2)
    rng = np.random.default_rng(0)
    chain.sample_params(rng)
    for _ in range(3):
        chain.step += 1
        chain.propose_random_splits(rng)
    assert sum(c.n for c in chain.clusters) == 360


def test_superclusters_and_ratio():
    prior = NormalInverseWishart(np.zeros(1), np.eye(1))
    far = [Cluster([np.zeros(3)] * 2, (np.array([float(m)]), np.eye(1))) for m in (0, 0.1, 500, 500.1)]
    g = superclusters(far, prior, np.random.default_rng(0))
    assert g[0] != g[2] and superclusters(far[:3], prior, np.random.default_rng(0)) == [0, 0, 0]
    rng = np.random.default_rng(1)
    a, b = rng.normal(-20, 1, (30, 1)), rng.normal(20, 1, (30, 1))
    assert log_split_ratio(prior, stat_of(prior, a), stat_of(prior, b), 1.0) > 0 > log_split_ratio(prior, stat_of(prior, a[:15]), stat_of(prior, a[15:]), 1.0)


def test_collapsed_samplers(spark, blobs):
    prior = NormalInverseWishart(np.zeros(2), np.eye(2))
    some = blobs.where("pid < 90").withColumns({"chain": F.lit(1), "z": F.lit(0)})
    out = sequential.collapsed(some, prior, sweeps=4, moves=3).join(blobs, "pid").groupBy("z", "truth").count().toPandas()
    assert out["count"].sum() == 90 and out.groupby("z")["count"].max().sum() >= 85
    swept = sequential.supercluster_sweep(some.drop("chain").withColumn("z", F.col("truth")), prior, groups=2)
    assert swept.count() == 90 and swept.select("pid").distinct().count() == 90


def test_collapsed_samplers_of_counts(spark):
    rng = np.random.default_rng(3)
    topics = np.array([[0.46, 0.46, 0.02, 0.02, 0.02, 0.02], [0.02, 0.02, 0.02, 0.02, 0.46, 0.46]])
    docs = [(i, [float(c) for c in rng.multinomial(40, topics[i % 2])]) for i in range(60)]
    points = spark.createDataFrame(docs, "pid long, x array<double>").withColumns({"chain": F.lit(1), "z": F.lit(0)})
    prior = DirichletMultinomial(6)
    out = sequential.collapsed(points, prior, sweeps=4, moves=3).toPandas()
    truth = out.assign(truth=out.pid % 2).groupby(["z", "truth"]).size()
    assert len(out) == 60 and truth.groupby("z").max().sum() == 60  # no component mixes the topics
    swept = sequential.supercluster_sweep(points.drop("chain"), prior, groups=2)
    assert swept.count() == 60 and swept.select("pid").distinct().count() == 60


def test_every_supercluster_has_two_components():
    prior = NormalInverseWishart(np.zeros(1), np.eye(1))
    clusters = [Cluster([np.zeros(prior.size), np.zeros(prior.size)], (np.array([3.0 * i]), np.eye(1))) for i in range(8)]
    for seed in range(50):
        sizes = np.bincount(superclusters(clusters, prior, np.random.default_rng(seed)))
        assert sizes.min() >= 2 and len(sizes) <= 4
    assert superclusters(clusters[:3], prior, np.random.default_rng(0)) == [0, 0, 0]


def test_checkpoints_are_kept_before_outer_steps_of_powers_of_two_and_at_the_end(spark, blobs, tmp_path):
    prior = NormalInverseWishart(np.zeros(2), np.eye(2))
    chain = fit(blobs, prior, steps=7, folder=str(tmp_path), inner=2, k=2, seed=3)
    assert chain.step == 7 and sorted(p.name for p in tmp_path.iterdir()) == ["1", "3", "7", "8-final", "points"]  # 1 + 2 x (0, 1, 3), and all 7
    again = Chain.load(spark, str(tmp_path / "3"), prior).run(5)
    assert [t[0] for t in again.trace] == list(range(1, 8))
    assert [t[2] for t in again.trace] == pytest.approx([t[2] for t in chain.trace]) and [c.n for c in again.clusters] == [c.n for c in chain.clusters]
    with pytest.raises(ValueError, match="other options"):
        Chain.load(spark, str(tmp_path / "3"), prior, seed=4)
    with pytest.raises(ValueError, match="other options"):
        Chain.load(spark, str(tmp_path / "3"), prior, grouped=True)


def test_labels_follow_from_parameters_in_any_partitioning(spark, blobs):
    prior = NormalInverseWishart(np.zeros(2), np.eye(2))
    one, two = (Chain(blobs.repartition(n), prior, k=3, seed=3).run(4) for n in (1, 5))
    assert [t[2:] for t in one.trace] == [pytest.approx(t[2:]) for t in two.trace]
    labels = lambda c: {r.pid: (r.z, r.side) for r in c.points.collect()}
    assert labels(one) == labels(two) == labels(one)
    stats = posteriors.component_stats(one.points, prior)
    for r in stats.collect():
        assert np.array(r.stat) == pytest.approx(one.clusters[r.z].stats[r.side])


def test_a_sweep_writes_no_points(spark, blobs, monkeypatch):
    from tessitura.mixture import sampler

    written = []
    monkeypatch.setattr(sampler, "saved", lambda df, f=sampler.saved: written.append(f(df)) or written[-1])
    Chain(blobs, NormalInverseWishart(np.zeros(2), np.eye(2)), k=2, seed=1).run(2)
    assert len(written) == 1 and written[0].columns == ["pid", "x"]
    chain = Chain(blobs, NormalInverseWishart(np.zeros(2), np.eye(2)), k=5, seed=1, grouped=True).run(2)
    import os

    assert [os.path.exists(d.written_at.removeprefix("file:")) for d in written[1:]].count(True) == 1 and chain.base is written[-1]


def test_sparse_and_dense_counts_make_the_same_chain(spark):
    docs = multinomial_docs(spark, 80, 30, 3, seed=2, most_words=40)
    dense = docs.select("pid", F.transform(F.sequence(F.lit(0), F.lit(29)), lambda t: F.coalesce(F.try_element_at("x", t), F.lit(0)).cast("double")).alias("x"))
    prior = DirichletMultinomial(30)
    one, two = (Chain(d, prior, k=3, seed=5).run(3) for d in (docs, dense))
    assert [t[2:] for t in one.trace] == [pytest.approx(t[2:]) for t in two.trace]
    import pyarrow as pa

    column = pa.array([[(1, 2), (4, 1)], [], [(0, 3)]], pa.map_(pa.int32(), pa.int32()))
    rows, full = prior.rows(column.slice(1)), np.zeros((2, 30))
    full[1, 0] = 3
    assert len(rows) == 2 and (prior.stats(rows, np.array([1, 0]), 2) == prior.stats(full, np.array([1, 0]), 2)).all()
    p = prior.draw(np.zeros(prior.size), np.random.default_rng(0))
    assert prior.log_density(rows, p) == pytest.approx(prior.log_density(full, p)) and prior.log_density(rows[np.array([1])], p) == pytest.approx(prior.log_density(full[1:], p))


def test_full_posteriors_are_the_same_in_blocks_of_components(spark, monkeypatch):
    rng = np.random.default_rng(6)
    model = spark.createDataFrame([(k, -1.0 * k, rng.normal(size=2).tolist(), (np.eye(2) * (k + 1)).tolist()) for k in range(4)], "component int, log_weight double, mean array<double>, cov array<array<double>>")
    frames = spark.createDataFrame([(i, rng.normal(size=2).tolist()) for i in range(9)], "frame int, x array<double>")
    whole = {r.frame: r.post for r in posteriors.posteriors(frames, model).collect()}
    monkeypatch.setattr(posteriors, "MODEL_BYTES", 70)
    for r in posteriors.posteriors(frames, model).collect():
        assert r.post == pytest.approx(whole[r.frame]) and sum(r.post) == pytest.approx(1)


def test_terms_in_blocks_make_the_finite_chain(spark, monkeypatch):
    from tessitura.mixture import terms

    docs = multinomial_docs(spark, 90, 40, 3, seed=2, most_words=50)
    whole = Chain(docs, DirichletMultinomial(40, 0.3), k=4, kind="finite", seed=7).run(3)
    one = terms.TermChain(docs, 40, 0.3, k=4, seed=7).run(3)
    assert [t[2:] for t in one.trace] == [pytest.approx(t[2:]) for t in whole.trace]
    assert one._block(0) == pytest.approx(np.stack([s[1:-1] for c in whole.clusters for s in c.stats]))
    sizes, sent = [], terms.log_gammas
    monkeypatch.setattr(terms, "log_gammas", lambda shape, rng: sizes.append(len(shape)) or sent(shape, rng))
    monkeypatch.setattr(terms, "HELD", 8)
    chain = terms.TermChain(docs, 40, 0.3, k=4, seed=7, block=16)
    start = chain.log_likelihood()
    chain.run(4)
    assert set(sizes) == {16, 8} and chain.n.sum() == 90 and chain.log_likelihood() > start
    counts = np.concatenate([chain._block(lo) for lo in (0, 16, 32)], axis=1).sum(0)
    want = np.zeros(40)
    for r in docs.collect():
        for t, c in r.x.items():
            want[t] += c
    assert counts == pytest.approx(want)
    stat = [np.concatenate([[chain.n[2 * i : 2 * i + 2].sum()], *[chain._block(lo)[2 * i : 2 * i + 2].sum(0) for lo in (0, 16, 32)], [chain.coefficients[2 * i : 2 * i + 2].sum()]]) for i in range(4)]
    assert chain.log_likelihood() == pytest.approx(posteriors.joint_log_likelihood(dict(enumerate(stat)), DirichletMultinomial(40, 0.3)))


def test_the_vocabulary_of_the_word_mixture_is_not_whole_on_the_driver(spark, monkeypatch, tmp_path):
    from tessitura.mixture import priors
    from tessitura.plans import registry

    spark.createDataFrame([(i, " ".join("abcdefgh"[(i * j) % 8] * (1 + j % 5) for j in range(1, 30))) for i in range(30)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(registry, "WORD_SWEEPS", 2)
    made = []
    init = priors.DirichletMultinomial.__init__
    monkeypatch.setattr(priors.DirichletMultinomial, "__init__", lambda self, *a, **b: made.append(a) or init(self, *a, **b))
    trace = registry.QUERIES["word_mixture_fit"](spark, str(tmp_path)).collect()
    assert [r.iter for r in trace] == [1, 2] and not made  # its statistics hold every term
