"""Conjugate families of mixture components: normal-inverse-Wishart Gaussians and Dirichlet multinomials.

A family turns rows into a matrix, adds rows up into sufficient statistics (flat vectors, so that sums of statistics are
sums of vectors wherever they are computed), draws parameters from a statistic's posterior, and scores rows and
statistics. Everything here is numpy over a batch or over the few components; Spark moves batches and statistics only.
"""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def multi_lgamma(x: float, d: int) -> float:
    """Multivariate log-gamma, for any dimension."""
    return d * (d - 1) / 4 * math.log(math.pi) + sum(math.lgamma(x + (1 - j) / 2) for j in range(1, d + 1))


def log_sum_exp(a: np.ndarray, axis: int = -1) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def sample_categorical(log_weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One draw for each row of unnormalised log weights (Gumbel-max); -inf is never drawn."""
    return (log_weights + rng.gumbel(size=log_weights.shape)).argmax(axis=1)


def sample_log_dirichlet(shape: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Logs of a Dirichlet draw, kept apart from 0 for small shapes: Gamma(a) = Gamma(a + 1) U^(1/a)."""
    g = np.log(rng.gamma(shape + 1)) + np.log(rng.random(shape.shape)) / shape
    return g - log_sum_exp(g)


def dense_rows(x: pa.Array, width: int) -> np.ndarray:
    """The rows of a column of arrays of one width."""
    return np.asarray(x.flatten().cast(pa.float64())).reshape(len(x), width)


class Counts:
    """Sparse rows of counts: rows i's terms and counts are at start[i] to start[i + 1]."""

    def __init__(self, start: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        self.start, self.term, self.count = start, term, count
        self.row = np.repeat(np.arange(len(start) - 1), np.diff(start))
        self._coefficient: np.ndarray | None = None

    @classmethod
    def of(cls, x: pa.MapArray) -> Counts:
        start = np.asarray(x.offsets)
        a, b = int(start[0]), int(start[-1])
        return cls(start - a, np.asarray(x.keys.slice(a, b - a)).astype(np.int64), np.asarray(x.items.slice(a, b - a)).astype(float))

    def __len__(self) -> int:
        return len(self.start) - 1

    def __getitem__(self, rows: np.ndarray) -> Counts:
        lengths = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(start[-1]) + np.repeat(self.start[:-1][rows] - start[:-1], lengths)
        return Counts(start, self.term[at], self.count[at])

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums over each row's terms."""
        return np.bincount(self.row, values, len(self))

    @property
    def totals(self) -> np.ndarray:
        return self.per_row(self.count)

    @property
    def coefficient(self) -> np.ndarray:
        if self._coefficient is None:
            self._coefficient = _log_factorial(self.totals) - self.per_row(_log_factorial(self.count))
        return self._coefficient


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """Log of n!, from a table for whole numbers that are not large."""
    if len(n) and n.max() < 1 << 20 and (n == np.floor(n)).all():
        return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(n.max()) + 1)))])[n.astype(np.int64)]
    return _lgamma(n + 1) if len(n) else np.zeros(0)


class ConjugatePrior(Protocol):
    size: int

    def matrix(self, x: pd.Series) -> np.ndarray: ...
    def rows(self, x: pa.Array) -> np.ndarray | Counts: ...
    def stats(self, rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray: ...
    def draw(self, stat: np.ndarray, rng: np.random.Generator, loosened: bool = False) -> tuple: ...
    def log_density(self, rows: np.ndarray, params: tuple) -> np.ndarray: ...
    def log_marginal(self, stat: np.ndarray) -> float: ...
    def log_predictive(self, rows: np.ndarray, stat: np.ndarray) -> np.ndarray: ...
    def divergence(self, p: tuple, q: tuple) -> float: ...


class NormalInverseWishart:
    """Gaussian components. Statistic: n, sum of x, sum of x x' (flat)."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, kappa: float = 1.0, nu: float | None = None) -> None:
        self.d = len(mean)
        self.theta, self.delta, self.kappa, self.nu = np.asarray(mean, float), np.asarray(cov, float), kappa, nu or self.d + 3
        self.size = 1 + self.d + self.d**2

    def matrix(self, x: pd.Series) -> np.ndarray:
        return np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, self.d))

    def rows(self, x: pa.Array) -> np.ndarray:
        return dense_rows(x, self.d)

    def stats(self, rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        out = np.zeros((groups, self.size))
        for g in np.unique(group):
            own = rows[group == g]
            out[g] = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        return out

    def posterior(self, stat: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """(kappa, nu, theta, nu * delta)."""
        n, t, square = stat[0], stat[1 : 1 + self.d], stat[1 + self.d :].reshape(self.d, self.d)
        kappa, nu = self.kappa + n, self.nu + n
        theta = (self.kappa * self.theta + t) / kappa
        scale = self.nu * self.delta + square + self.kappa * np.outer(self.theta, self.theta) - kappa * np.outer(theta, theta)
        return kappa, nu, theta, (scale + scale.T) / 2

    def draw(self, stat: np.ndarray, rng: np.random.Generator, loosened: bool = False) -> tuple:
        """(mean, covariance) from the posterior: Bartlett's decomposition, then the mean. loosened: a wider proposal."""
        kappa, nu, theta, scale = self.posterior(stat)
        if loosened:
            kappa, nu = kappa - 0.001 * stat[0], nu - 0.001 * stat[0]
        a = np.tril(rng.standard_normal((self.d, self.d)), -1) + np.diag(np.sqrt(rng.chisquare(nu - np.arange(self.d))))
        root = np.linalg.cholesky(scale) @ np.linalg.inv(a).T
        cov = root @ root.T
        return theta + np.linalg.cholesky(cov) @ rng.standard_normal(self.d) / math.sqrt(kappa), cov

    def log_density(self, rows: np.ndarray, params: tuple) -> np.ndarray:
        return gaussian_log_density(rows, *params)

    def log_marginal(self, stat: np.ndarray) -> float:
        n = stat[0]
        if n <= 0:
            return 0.0
        kappa, nu, _, scale = self.posterior(stat)
        logdet = lambda m: np.linalg.slogdet(m)[1]
        return float(
            -n * self.d / 2 * math.log(math.pi) + multi_lgamma(nu / 2, self.d) - multi_lgamma(self.nu / 2, self.d) + self.nu / 2 * logdet(self.nu * self.delta) - nu / 2 * logdet(scale) + self.d / 2 * math.log(self.kappa / kappa)
        )

    def log_predictive(self, rows: np.ndarray, stat: np.ndarray) -> np.ndarray:
        """Student-t: the density of one more row given the rows in stat."""
        kappa, nu, theta, scale = self.posterior(stat)
        df = nu - self.d + 1
        root = np.linalg.cholesky(scale * (kappa + 1) / (kappa * df))
        z = np.linalg.solve(root, (rows - theta).T)
        return math.lgamma((df + self.d) / 2) - math.lgamma(df / 2) - self.d / 2 * math.log(df * math.pi) - np.log(np.diag(root)).sum() - (df + self.d) / 2 * np.log1p((z * z).sum(0) / df)

    def divergence(self, p: tuple, q: tuple) -> float:
        """J-divergence: both Kullback-Leibler directions."""
        (m1, s1), (m2, s2) = p, q
        p1, p2, d = np.linalg.inv(s1), np.linalg.inv(s2), m1 - m2
        return float(0.5 * (np.trace(p1 @ s2) + np.trace(p2 @ s1) + d @ (p1 + p2) @ d) - self.d)


def gaussian_log_density(rows: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    root = np.linalg.cholesky(cov)
    z = np.linalg.solve(root, (rows - mean).T)
    return -0.5 * (z * z).sum(0) - np.log(np.diag(root)).sum() - len(mean) / 2 * math.log(2 * math.pi)


class DirichletMultinomial:
    """Multinomial components over v terms. Statistic: n, counts by term, sum of the rows' coefficients (logs)."""

    def __init__(self, terms: int, alpha: float = 1.0) -> None:
        self.v, self.alpha, self.size = terms, alpha, terms + 2

    def matrix(self, x: pd.Series) -> np.ndarray:
        """Rows of counts, from arrays of all counts or maps of those over 0."""
        out = np.zeros((len(x), self.v))
        for i, row in enumerate(x):
            if isinstance(row, dict):
                out[i, list(row.keys())] = list(row.values())
            elif len(row) and isinstance(row[0], tuple):  # a map, as Arrow hands it over
                out[i, [k for k, _ in row]] = [c for _, c in row]
            else:
                out[i] = row
        return out

    def rows(self, x: pa.Array) -> np.ndarray | Counts:
        """Maps of counts over 0 stay sparse, on their Arrow buffers; arrays of all counts are dense."""
        return Counts.of(x) if pa.types.is_map(x.type) else dense_rows(x, self.v)

    @staticmethod
    def coefficient(rows: np.ndarray | Counts) -> np.ndarray:
        """Log of each row's multinomial coefficient."""
        return rows.coefficient if isinstance(rows, Counts) else _lgamma(rows.sum(1) + 1) - _lgamma(rows + 1).sum(1)

    def stats(self, rows: np.ndarray | Counts, group: np.ndarray, groups: int) -> np.ndarray:
        out = np.zeros((groups, self.size))
        if isinstance(rows, Counts):
            out[:, 0] = np.bincount(group, minlength=groups)
            out[:, 1:-1] = np.bincount(np.asarray(group)[rows.row] * self.v + rows.term, rows.count, groups * self.v).reshape(groups, self.v)
            out[:, -1] = np.bincount(group, rows.coefficient, groups)
            return out
        np.add.at(out, group, np.column_stack([np.ones(len(rows)), rows, self.coefficient(rows)]) if len(rows) else np.zeros((0, self.size)))
        return out

    def draw(self, stat: np.ndarray, rng: np.random.Generator, loosened: bool = False) -> tuple:
        return (sample_log_dirichlet(stat[1:-1] + self.alpha, rng),)

    def log_density(self, rows: np.ndarray, params: tuple) -> np.ndarray:
        return (rows.per_row(rows.count * params[0][rows.term]) if isinstance(rows, Counts) else rows @ params[0]) + self.coefficient(rows)

    def log_marginal(self, stat: np.ndarray) -> float:
        counts = stat[1:-1]
        return float(_lgamma(counts + self.alpha).sum() - self.v * math.lgamma(self.alpha) + math.lgamma(self.v * self.alpha) - math.lgamma(counts.sum() + self.v * self.alpha) + stat[-1])

    def log_predictive(self, rows: np.ndarray, stat: np.ndarray) -> np.ndarray:
        a = stat[1:-1] + self.alpha
        total = a.sum()
        return self.coefficient(rows) + math.lgamma(total) - _lgamma(total + rows.sum(1)) + (_lgamma(a + rows) - _lgamma(a)).sum(1)

    def divergence(self, p: tuple, q: tuple) -> float:
        return float(((np.exp(p[0]) - np.exp(q[0])) * (p[0] - q[0])).sum())


class Single:
    """One component under a prior: its statistic, with rows coming and going."""

    def __init__(self, prior: ConjugatePrior, stat: np.ndarray | None = None) -> None:
        self.prior, self.stat = prior, np.zeros(prior.size) if stat is None else stat.copy()

    @property
    def n(self) -> float:
        return self.stat[0]

    def add(self, row: np.ndarray) -> None:
        self.stat += self.prior.stats(row[None], np.zeros(1, int), 1)[0]

    def remove(self, row: np.ndarray) -> None:
        self.stat -= self.prior.stats(row[None], np.zeros(1, int), 1)[0]
        if self.stat[0] < -0.5:
            raise ValueError("more rows were removed than added")

    def predictive(self, row: np.ndarray) -> float:
        return float(self.prior.log_predictive(row[None], self.stat)[0])

    def merged_marginal(self, other: Single) -> float:
        return self.prior.log_marginal(self.stat + other.stat)
