"""Collapsed samplers, one point at a time: Gibbs, sequentially allocated merge-split, and Gibbs within superclusters.

Each point's draw depends on all the others', so a chain over a set of points is one task. Independent sets (chains, or
superclusters within one sweep) run side by side; this is for test-sized sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .priors import ConjugatePrior, Single, sample_categorical
from .sampler import log_split_ratio


def gibbs_sweep(rows: np.ndarray, z: np.ndarray, prior: ConjugatePrior, alpha: float, rng: np.random.Generator) -> np.ndarray:
    """One sweep in a random order: each point leaves its component and joins one by size and prediction, or a new one."""
    z = z.copy()
    clusters = {int(k): Single(prior, prior.stats(rows[z == k], np.zeros((z == k).sum(), int), 1)[0]) for k in np.unique(z)}
    fresh = max(clusters, default=-1) + 1
    empty = Single(prior)
    for i in rng.permutation(len(rows)):
        own = int(z[i])
        clusters[own].remove(rows[i])
        if clusters[own].n < 0.5:
            del clusters[own]
        keys = list(clusters)
        log_p = np.array([math.log(clusters[k].n) + clusters[k].predictive(rows[i]) for k in keys] + [math.log(alpha) + empty.predictive(rows[i])])
        pick = int(sample_categorical(log_p[None], rng)[0])
        if pick == len(keys):
            z[i], clusters[fresh], fresh = fresh, Single(prior), fresh + 1
        else:
            z[i] = keys[pick]
        clusters[int(z[i])].add(rows[i])
    return z


def merge_split(rows: np.ndarray, z: np.ndarray, prior: ConjugatePrior, alpha: float, rng: np.random.Generator) -> np.ndarray:
    """One sequentially allocated merge or split of the components of two random points."""
    if len(rows) < 2:
        return z
    i, j = rng.choice(len(rows), 2, replace=False)
    z = z.copy()
    members = np.flatnonzero((z == z[i]) | (z == z[j]))
    rest = rng.permutation(members[(members != i) & (members != j)])
    one, two = Single(prior), Single(prior)
    one.add(rows[i])
    two.add(rows[j])
    split, log_q, merging = {int(i): 0, int(j): 1}, 0.0, z[i] != z[j]
    for m in rest:
        log_p = np.array([math.log(c.n) + c.predictive(rows[m]) for c in (one, two)])
        log_p -= np.logaddexp(*log_p)
        # A merge is judged by how likely the sequential allocation is to give the present split.
        side = int(z[m] == z[j]) if merging else int(rng.random() >= math.exp(log_p[0]))
        log_q += log_p[side]
        split[int(m)] = side
        (one, two)[side].add(rows[m])
    ratio = log_split_ratio(prior, one.stat, two.stat, alpha) - log_q
    if merging:
        if math.log(rng.random()) < -ratio:
            z[members] = z[i]
    elif math.log(rng.random()) < ratio:
        new = z.max() + 1
        for m, side in split.items():
            if side:
                z[m] = new
    return z


def collapsed(points: DataFrame, prior: ConjugatePrior, sweeps: int, chain: str = "chain", alpha: float = 1.0, moves: int = 1, seed: int = 0) -> DataFrame:
    """(chain, pid, z) after `sweeps` sweeps, each followed by `moves` merge-split moves; points (chain, pid, x, z)."""
    ship(points.sparkSession)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pid")
        rows, z = prior.matrix(group["x"]), group["z"].to_numpy()
        rng = np.random.default_rng([seed, abs(int(group["chain"].iloc[0]))])
        for _ in range(sweeps):
            z = gibbs_sweep(rows, z, prior, alpha, rng)
            for _ in range(moves):
                z = merge_split(rows, z, prior, alpha, rng)
        return pd.DataFrame({"chain": group["chain"], "pid": group["pid"], "z": pd.Series(z, index=group.index).astype("int32")})

    return points.select(F.col(chain).cast("long").alias("chain"), "pid", "x", "z").groupBy("chain").applyInPandas(one, "chain long, pid long, z int")


def supercluster_sweep(points: DataFrame, prior: ConjugatePrior, alpha: float = 1.0, groups: int = 8, step: int = 0, seed: int = 0) -> DataFrame:
    """(pid, x, z): one sweep of Gibbs within superclusters, all of them at once.

    Components are dealt to superclusters by a seeded draw (a Dirichlet-process mixture is a mixture of smaller ones with
    alpha / groups each); points only move between the components of their supercluster, or to a new one there.
    """
    ship(points.sparkSession)
    dealt = points.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "z"), F.lit(groups)).cast("int"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pid")
        g = int(group["g"].iloc[0])
        z = gibbs_sweep(prior.matrix(group["x"]), group["z"].to_numpy(), prior, alpha / groups, np.random.default_rng([seed, step, g]))
        new = ~np.isin(z, group["z"].to_numpy())
        # New numbers of different superclusters must differ.
        z = np.where(new, 1_000_000 * (step * groups + g + 1) + z, z)
        return pd.DataFrame({"pid": group["pid"], "x": group["x"], "z": pd.Series(z, index=group.index).astype("int64")})

    x = points.schema["x"].dataType.simpleString()
    return dealt.withColumn("z", F.col("z").cast("long")).groupBy("g").applyInPandas(one, f"pid long, x {x}, z long")
