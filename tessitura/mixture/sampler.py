"""Dirichlet-process mixtures by parallel sub-cluster moves, and finite approximations.

A chain is a driver loop. Each sweep is one pass over the points: every task draws its points' components and sides from
broadcast parameters and adds up their statistics and likelihoods, and only those of the K components come to the driver,
which draws parameters and decides about merges and splits. No point ever does.

Labels are not written: a point's draws come from a hash of seed, step and the point's id, so its labels follow from its
vector and the recipe (the parameters of the sweep and the moves after it), in any task, in any partitioning and again after
a lost executor. Only with superclusters, where a point's draw depends on the component that it had, are points written with
their labels after each sweep, and the copy before is deleted.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, saved, ship
from ..sources.readers import exists
from .posteriors import joint_log_likelihood, sparse_sums
from .priors import ConjugatePrior, log_sum_exp, sample_categorical, sample_log_dirichlet

LOG_RANDOM = math.log(100)

# Draws ---------------------------------------------------------------------------------------------------------------

#: What a draw is for: first labels, first sides, labels, sides, new sides, halves.
FIRST, FIRST_SIDE, LABEL, SIDE, COIN, HALF = range(6)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def uniforms(pid: np.ndarray, seed: int, step: int, purpose: int, columns: int = 1) -> np.ndarray:
    """Numbers in (0, 1), a row for each point, that depend on nothing but the arguments."""
    key = np.zeros(1, np.uint64)
    for part in (seed, step, purpose):
        key = _mixed(key + _GOLDEN + np.uint64(part % (1 << 64)))
    own = _mixed(pid.astype(np.int64).view(np.uint64) + key)
    return ((_mixed(own[:, None] + _GOLDEN * np.arange(1, columns + 1, dtype=np.uint64)[None, :]) >> np.uint64(12)) + 0.5) / float(1 << 52)


def drawn(log_p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A column for each row of unnormalised log weights, by the uniforms of the same shape."""
    return (log_p - np.log(-np.log(u))).argmax(axis=1)


def replayed(recipe: list[tuple], prior: ConjugatePrior, seed: int, pid: np.ndarray, rows, given: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(component, side, log likelihood under the sides of the last draw) of the points, by the steps of the recipe."""
    z = side = np.zeros(len(pid), np.int64)
    like = np.zeros(len(pid))
    for kind, *args in recipe:
        if kind == "first":
            z, side = ((uniforms(pid, seed, 0, p)[:, 0] * n).astype(np.int64) for p, n in ((FIRST, args[0]), (FIRST_SIDE, 2)))
        elif kind == "given":
            z, side = given
        elif kind == "draw":
            state, group, step = args
            log_p = np.column_stack([w + prior.log_density(rows, p) for w, p, _, _ in state])
            if group is not None:  # only the components of the point's present group
                group = np.array(group)
                log_p = np.where(group[None, :] == group[z][:, None], log_p, -np.inf)
            z = drawn(log_p, uniforms(pid, seed, step, LABEL, len(state)))
            u, side = uniforms(pid, seed, step, SIDE, 2), np.zeros(len(pid), np.int64)
            for k in np.unique(z):
                at = np.flatnonzero(z == k)
                own = rows[at]
                both = np.column_stack([state[k][2][s] + prior.log_density(own, state[k][3][s]) for s in (0, 1)])
                side[at], like[at] = drawn(both, u[at]), log_sum_exp(both)
        elif kind == "move":  # by (component, side); side -1 is drawn anew
            to, to_side, step = args
            new = to_side[z, side]
            z, side = to[z, side], np.where(new < 0, uniforms(pid, seed, step, COIN)[:, 0] < 0.5, new).astype(np.int64)
        elif kind == "halves":  # sides by a coin of each component
            share, step = args
            side = (uniforms(pid, seed, step, HALF)[:, 0] >= share[z]).astype(np.int64)
        elif kind == "part":  # the second halves of some components become new ones
            share, new, step = args
            over = uniforms(pid, seed, step, HALF)[:, 0] >= share[z]
            taken = new[z] >= 0
            side = np.where(taken, uniforms(pid, seed, step, COIN)[:, 0] < 0.5, side).astype(np.int64)
            z = np.where(taken & over, new[z], z)
        elif kind == "renumber":
            z = args[0][z]
    return z, side, like


# Chains --------------------------------------------------------------------------------------------------------------


@dataclass
class Cluster:
    """A component with its two sides: statistics, parameters, weights, and how its sides' likelihood moves."""

    stats: list[np.ndarray]
    params: tuple = ()
    side_params: list[tuple] = field(default_factory=list)
    log_weight: float = 0.0
    side_log_weights: np.ndarray = field(default_factory=lambda: np.log([0.5, 0.5]))
    likelihood: float = -math.inf
    splittable: bool = False

    @property
    def stat(self) -> np.ndarray:
        return self.stats[0] + self.stats[1]

    @property
    def n(self) -> float:
        return self.stat[0]


def superclusters(clusters: list[Cluster], prior: ConjugatePrior, rng: np.random.Generator | None) -> list[int]:
    """A group for each component: each draws one other component by divergence, and linked ones are one group.

    Without rng each takes the nearest, the first if equal.
    """
    k = len(clusters)
    if k <= 3:
        return [0] * k
    d = np.array([[math.inf if i == j else prior.divergence(a.params, b.params) for j, b in enumerate(clusters)] for i, a in enumerate(clusters)])
    parent = list(range(k))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in enumerate(d.argmin(1) if rng is None else sample_categorical(-4 * d, rng)):
        parent[root(i)] = root(int(j))
    names = {r: n for n, r in enumerate(dict.fromkeys(root(i) for i in range(k)))}
    return [names[root(i)] for i in range(k)]


def log_split_ratio(prior: ConjugatePrior, left: np.ndarray, right: np.ndarray, alpha: float) -> float:
    """Log Hastings ratio of splitting left + right into the two."""
    both = left + right
    return math.log(alpha) + math.lgamma(left[0]) + math.lgamma(right[0]) - math.lgamma(both[0]) + prior.log_marginal(left) + prior.log_marginal(right) - prior.log_marginal(both)


class Chain:
    """A Markov chain over partitions of points (pid, x).

    kind: "dp" (sub-cluster splits and merges) or "finite" (K components throughout, weights with alpha / K each).
    """

    def __init__(self, points: DataFrame, prior: ConjugatePrior, alpha: float = 1.0, k: int = 10, seed: int = 0, kind: str = "dp", grouped: bool = False, spread_alpha: bool = True) -> None:
        ship(points.sparkSession)
        self.spark, self.prior, self.alpha, self.seed, self.kind, self.grouped, self.spread_alpha = points.sparkSession, prior, alpha, seed, kind, grouped, spread_alpha
        self.step, self.trace = 0, []
        self.base, self.recipe = saved(points.select("pid", "x")), [("first", k)]
        self.clusters: list[Cluster] = []
        self._recount(k)

    # Labels --------------------------------------------------------------------------------------------------------

    def _replay(self, recipe: list[tuple]):
        """What a task does with a batch: (component, side, likelihood), rows."""
        prior, seed = self.prior, self.seed
        shared = self.spark.sparkContext.broadcast(recipe)  # parameters of K components

        def labels(batch: pa.RecordBatch):
            rows = prior.rows(batch.column("x"))
            given = tuple(np.asarray(batch.column(c), np.int64) for c in ("z", "side")) if "z" in batch.schema.names else None
            return replayed(shared.value, prior, seed, np.asarray(batch.column("pid")), rows, given), rows

        return labels

    @property
    def points(self) -> DataFrame:
        """(pid, x, z, side): the points with the labels that they have now."""
        labels = self._replay(self.recipe)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (z, side, _), _ = labels(batch)
                yield pa.RecordBatch.from_arrays([batch.column("pid"), batch.column("x"), pa.array(z, pa.int32()), pa.array(side, pa.int32())], ["pid", "x", "z", "side"])

        return self.base.mapInArrow(run, f"pid long, x {self.base.schema['x'].dataType.simpleString()}, z int, side int")

    def _counted(self, recipe: list[tuple], k: int) -> tuple[list[list[np.ndarray]], np.ndarray]:
        """(statistics by component and side, log likelihood by component) in one pass over the points."""
        labels, prior = self._replay(recipe), self.prior

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((2 * k, prior.size + 1))
            for batch in batches:
                (z, side, like), rows = labels(batch)
                held[:, :-1] += prior.stats(rows, 2 * z + side, 2 * k)
                held[:, -1] += np.bincount(2 * z + side, like, 2 * k)
            at, pos = np.nonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pos), pa.array(held[at, pos])], ["at", "pos", "v"])

        # Sums that are not 0 only: of sparse counts, a row for each component's terms.
        stats = sparse_sums(self.base.mapInArrow(add, "at long, pos long, v double"), 2 * k, prior.size + 1)
        return [[stats[2 * i, :-1], stats[2 * i + 1, :-1]] for i in range(k)], stats[:, -1].reshape(k, 2).sum(1)

    def _recount(self, k: int) -> np.ndarray:
        stats, like = self._counted(self.recipe, k)
        self._with_stats(stats)
        return like

    def _with_stats(self, stats: list[list[np.ndarray]]) -> None:
        old = self.clusters
        self.clusters = [Cluster(s) for s in stats]
        for c, o in zip(self.clusters, old, strict=False):
            c.params, c.side_params, c.log_weight, c.side_log_weights, c.likelihood, c.splittable = o.params, o.side_params, o.log_weight, o.side_log_weights, o.likelihood, o.splittable

    def _relabel(self, moves: dict[tuple[int, int], tuple[int, int | None]], k: int, stats: list[list[np.ndarray]] | None = None) -> None:
        """Moves all points of a (component, side) to another; side None draws the side anew. stats: what they are then, if that is known."""
        n = max(k, 1 + max(a for a, _ in moves))  # components without a move stay
        to, to_side = np.tile(np.arange(n)[:, None], 2), np.tile(np.arange(2)[None, :], (n, 1))
        for (a, s), (b, t) in moves.items():
            to[a, s], to_side[a, s] = b, -1 if t is None else t
        self.recipe = [*self.recipe, ("move", to, to_side, self.step)]
        if stats is None:
            self._recount(k)
        else:
            self._with_stats(stats)

    def _drop_empty(self) -> None:
        self.kept = kept = [i for i, c in enumerate(self.clusters) if c.n > 0 or self.kind == "finite"]
        if len(kept) == len(self.clusters):
            return
        number = np.zeros(len(self.clusters), np.int64)
        number[kept] = np.arange(len(kept))
        self.clusters = [self.clusters[i] for i in kept]
        self.recipe = [*self.recipe, ("renumber", number)]

    # Moves ---------------------------------------------------------------------------------------------------------

    def sample_params(self, rng: np.random.Generator, loosened: bool = False) -> None:
        n = np.array([c.n for c in self.clusters])
        if self.kind == "finite":
            weights = sample_log_dirichlet(n + (self.alpha / len(n) if self.spread_alpha else self.alpha), rng)
        else:
            weights = sample_log_dirichlet(np.maximum(n, 1e-9), rng)
        for c, w in zip(self.clusters, weights, strict=True):
            c.log_weight = float(w)
            c.params = self.prior.draw(c.stat, rng, loosened)
            c.side_params = [self.prior.draw(s, rng, loosened) for s in c.stats]
            c.side_log_weights = sample_log_dirichlet(0.5 * (np.array([s[0] for s in c.stats]) + self.alpha), rng)

    def sample_labels(self, groups: list[int] | None) -> None:
        draw = ("draw", [(c.log_weight, c.params, c.side_log_weights, c.side_params) for c in self.clusters], groups, self.step)
        # Without groups nothing that was before matters any more.
        self.recipe = [*self.recipe, draw] if groups is not None else [draw]
        like = self._recount(len(self.clusters))
        for c, total in zip(self.clusters, like, strict=True):  # sides that no longer gain are worth proposing
            new = float(total / c.n) if c.n else -math.inf
            c.splittable, c.likelihood = bool(new <= c.likelihood + 1e-9 or c.splittable), new
        self._drop_empty()

    def propose_merges(self, rng: np.random.Generator, groups: list[int] | None) -> None:
        """Pairs in random order; the first accepted merge of a component counts. The two become the merged one's sides."""
        k = len(self.clusters)
        free, moves, gone = set(range(k)), {}, set()
        pairs = [(i, j) for i in range(k) for j in range(i + 1, k) if groups is None or groups[i] == groups[j]]
        for i, j in (pairs[p] for p in rng.permutation(len(pairs))):
            if i in free and j in free:
                a, b = self.clusters[i], self.clusters[j]
                ratio = -log_split_ratio(self.prior, a.stat, b.stat, self.alpha) - LOG_RANDOM
                if math.log(rng.random()) < ratio:
                    moves |= {(i, 0): (i, 0), (i, 1): (i, 0), (j, 0): (i, 1), (j, 1): (i, 1)}
                    free -= {i, j}
                    gone.add(j)
                    a.log_weight = float(np.logaddexp(a.log_weight, b.log_weight))
                    a.likelihood, a.splittable = -math.inf, False
        if gone:
            kept = [i for i in range(k) if i not in gone]
            number = {i: n for n, i in enumerate(kept)}
            every = {(i, s): moves.get((i, s), (i, s)) for i in range(k) for s in (0, 1)}
            stats = [[np.zeros(self.prior.size), np.zeros(self.prior.size)] for _ in kept]  # no side is drawn, so no pass
            for (i, s), (b, t) in every.items():
                stats[number[b]][t] = stats[number[b]][t] + self.clusters[i].stats[s]
            self.clusters = [self.clusters[i] for i in kept]
            self._relabel({a: (number[b], t) for a, (b, t) in every.items()}, len(kept), stats)

    def propose_splits(self, rng: np.random.Generator) -> None:
        """Sides become components where that is accepted, with sides drawn anew; an empty side has them redrawn too."""
        k, moves, weights = len(self.clusters), {}, {}
        for i in range(k):
            c = self.clusters[i]
            if not c.splittable:
                continue
            left, right = c.stats
            if left[0] < 1 or right[0] < 1:
                moves |= {(i, 0): (i, None), (i, 1): (i, None)}
            elif math.log(rng.random()) < log_split_ratio(self.prior, left, right, self.alpha):
                new = k + len(weights)
                moves |= {(i, 0): (i, None), (i, 1): (new, None)}
                weights[new] = (i, c.log_weight)
        self._apply_splits(k, moves, weights)

    def propose_random_splits(self, rng: np.random.Generator) -> list[int]:
        """Every component is cut by coin flips, all in one pass; the ratio pays for the choice of the flips.

        Returns the components that were split, in the order of the new ones.
        """
        k = len(self.clusters)
        shares = np.array([rng.beta(self.alpha / 2 + 1e-9, self.alpha / 2 + 1e-9) for _ in range(k)])
        stats, _ = self._counted([*self.recipe, ("halves", shares, self.step)], k)
        accepted = [i for i, (a, b) in enumerate(stats) if a[0] > 0 and b[0] > 0 and math.log(rng.random()) < log_split_ratio(self.prior, a, b, self.alpha) + LOG_RANDOM]
        if not accepted:
            return []
        new = np.full(k, -1)
        new[accepted] = k + np.arange(len(accepted))
        self.recipe = [*self.recipe, ("part", shares, new, self.step)]
        for i in sorted(accepted):
            self.clusters.append(Cluster(stats[i], self.clusters[i].params, list(self.clusters[i].side_params), self.clusters[i].log_weight - math.log(2)))
            self.clusters[i].log_weight -= math.log(2)
        self._recount(len(self.clusters))
        return sorted(accepted)

    def _apply_splits(self, k: int, moves: dict, weights: dict[int, tuple[int, float]]) -> None:
        if not moves:
            return
        for i, w in weights.values():
            old = self.clusters[i]
            share = log_sum_exp(old.side_log_weights[None])[0]
            self.clusters.append(Cluster(old.stats, old.side_params[1] if old.side_params else (), [], w + old.side_log_weights[1] - share))
            old.log_weight, old.likelihood, old.splittable = w + old.side_log_weights[0] - share, -math.inf, False
        self._relabel(moves, k + len(weights))

    # The loop ------------------------------------------------------------------------------------------------------

    def sweep(self) -> None:
        began = time.monotonic()
        self.step += 1
        rng = np.random.default_rng([self.seed, self.step])
        self.sample_params(rng)
        groups = superclusters(self.clusters, self.prior, rng) if self.grouped and self.kind == "dp" else None
        self.sample_labels(groups)
        groups = groups and [groups[i] for i in self.kept]  # components that died in this sweep are gone
        if self.kind == "dp":
            if rng.random() < 0.01:
                halves = self.propose_random_splits(rng)
                groups = groups and groups + [groups[i] for i in halves]
            self.propose_merges(rng, groups)
            self.propose_splits(rng)
        if groups is not None:  # the next draw depends on these labels, and so on: they are written, and the copy before goes
            old, self.base = self.base, saved(self.points)
            self.recipe = [("given",)]
            discard(old)
        self.trace.append((self.step, time.monotonic() - began, self.log_likelihood(), len([c for c in self.clusters if c.n > 0]), int(max(c.n for c in self.clusters))))

    def run(self, steps: int, seconds: float | None = None) -> Chain:
        """`steps` sweeps, or fewer if the time is up; a chain goes on where it stopped."""
        began = time.monotonic()
        for _ in range(steps):
            if seconds is not None and time.monotonic() - began > seconds:
                break
            self.sweep()
        return self

    def log_likelihood(self) -> float:
        return joint_log_likelihood({i: c.stat for i, c in enumerate(self.clusters)}, self.prior, self.alpha)

    def trace_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.trace, "iter int, secs double, loglik double, k int, nk int").withColumn("total_secs", F.expr("sum(secs) over (order by iter)"))

    def model(self) -> DataFrame:
        """(component, log_weight, n, mean, cov) for Gaussians, (component, log_weight, n, log_p) for multinomials."""
        total = sum(c.n for c in self.clusters)
        rows = [(i, math.log(c.n / total), float(c.n), *[np.asarray(p).tolist() for p in c.params]) for i, c in enumerate(self.clusters) if c.n > 0]
        kinds = "mean array<double>, cov array<array<double>>" if len(rows[0]) == 5 else "log_p array<double>"
        return self.spark.createDataFrame(rows, f"component int, log_weight double, n double, {kinds}")

    def _options(self) -> dict:
        return {"alpha": float(self.alpha), "seed": self.seed, "kind": self.kind, "grouped": self.grouped, "spread_alpha": self.spread_alpha}

    def save(self, folder: str, points: str | None = None) -> None:
        """Labels, trace, state and options; :meth:`load` goes on from them with the same draws.

        points: where the points (pid, x) are already; else they are written too.
        """
        if points is None:
            points = f"{folder}/points"
            self.base.select("pid", "x").write.mode("overwrite").parquet(points)
        self.points.select("pid", "z", "side").write.mode("overwrite").parquet(f"{folder}/labels")
        self.trace_table().write.mode("overwrite").parquet(f"{folder}/trace")
        states = [(self.step, i, float(c.likelihood) if math.isfinite(c.likelihood) else None, c.splittable) for i, c in enumerate(self.clusters)]
        self.spark.createDataFrame(states, "step int, component int, likelihood double, splittable boolean").write.mode("overwrite").parquet(f"{folder}/state")
        options = self._options() | {"points": points}
        self.spark.createDataFrame([tuple(options.values())], "alpha double, seed long, kind string, grouped boolean, spread_alpha boolean, points string").write.mode("overwrite").parquet(f"{folder}/options")

    @classmethod
    def load(cls, spark, folder: str, prior: ConjugatePrior, **options) -> Chain:
        """A saved chain, or its last state if folder has it as `-final`. An option other than the saved one is an error."""
        if not exists(spark, f"{folder}/state/_SUCCESS") and exists(spark, f"{folder}-final/state/_SUCCESS"):
            folder += "-final"
        chain = cls.__new__(cls)
        ship(spark)
        chain.spark, chain.prior = spark, prior
        kept = spark.read.parquet(f"{folder}/options").first().asDict()
        points = kept.pop("points")
        wrong = {k: v for k, v in options.items() if k not in kept or kept[k] != v}
        if wrong:
            raise ValueError(f"the chain was run with other options than {wrong}: {kept}")
        for k, v in kept.items():
            setattr(chain, k, v)
        chain.base = saved(spark.read.parquet(points).join(spark.read.parquet(f"{folder}/labels"), "pid"))
        chain.recipe = [("given",)]
        chain.trace = [(r.iter, r.secs, r.loglik, r.k, r.nk) for r in spark.read.parquet(f"{folder}/trace").orderBy("iter").collect()]
        state = spark.read.parquet(f"{folder}/state").orderBy("component").collect()
        chain.step, chain.clusters = state[0].step, []
        chain._recount(len(state))
        for c, s in zip(chain.clusters, state, strict=True):
            c.likelihood, c.splittable = -math.inf if s.likelihood is None else s.likelihood, s.splittable
        return chain


def fit(points: DataFrame, prior: ConjugatePrior, steps: int = 1500, folder: str | None = None, inner: int = 20, **options) -> Chain:
    """A whole run of `steps` sweeps in outer steps of `inner`, the last one of what is left.

    folder keeps the chain as it is before the outer steps 1, 2, 4, 8, ..., named by the number of the next sweep (1, 21, 61,
    141, ... by default), and at the end, with `-final` after that number; the points once.
    """
    from ..sources.writers import is_checkpoint

    chain = Chain(points, prior, **options)
    if folder:
        chain.base.select("pid", "x").write.mode("overwrite").parquet(f"{folder}/points")
    for outer in range(1, -(-steps // inner) + 1):
        if folder and is_checkpoint(outer, 0):
            chain.save(f"{folder}/{chain.step + 1}", f"{folder}/points")
        chain.run(min(inner, steps - chain.step))
    if folder:
        chain.save(f"{folder}/{chain.step + 1}-final", f"{folder}/points")
    return chain
