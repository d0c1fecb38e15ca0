"""Seeded synthetic mixtures for tests and demos."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .priors import NormalInverseWishart


def gaussian_points(spark: SparkSession, n: int = 10_000, d: int = 2, k: int = 6, seed: int = 0, spread: float = 10.0) -> DataFrame:
    """(pid, x, truth): Dirichlet(1) weights, means N(0, spread^2 I), inverse-Wishart covariances."""
    rng = np.random.default_rng(seed)
    prior = NormalInverseWishart(np.zeros(d), np.eye(d), nu=d + 2)
    weights = rng.dirichlet(np.ones(k))
    parts = [(rng.normal(0, spread, d), prior.draw(np.zeros(prior.size), rng)[1]) for _ in range(k)]
    z = rng.choice(k, n, p=weights)
    x = np.array([rng.multivariate_normal(*parts[i]) for i in z])
    return spark.createDataFrame([(i, x[i].tolist(), int(z[i])) for i in range(n)], "pid long, x array<double>, truth int")


def multinomial_docs(spark: SparkSession, n: int = 10_000, d: int = 100, k: int = 3, seed: int = 0, most_words: int = 1000) -> DataFrame:
    """(pid, x map<int, int>, truth): Dirichlet(0.05) topics, 1 to most_words words each."""
    rng = np.random.default_rng(seed)
    topics = rng.dirichlet(np.full(d, 0.05), k)
    z = rng.integers(0, k, n)
    counts = [rng.multinomial(rng.integers(1, most_words + 1), topics[i]) for i in z]
    return spark.createDataFrame([(i, {int(t): int(c[t]) for t in np.flatnonzero(c)}, int(z[i])) for i, c in enumerate(counts)], "pid long, x map<int, int>, truth int")
