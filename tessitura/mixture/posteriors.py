"""Statistics, posteriors and likelihoods of mixtures over DataFrames of points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import ship
from .priors import ConjugatePrior, gaussian_log_density, log_sum_exp


def component_stats(points: DataFrame, prior: ConjugatePrior, x: str = "x", z: str = "z", side: str = "side") -> DataFrame:
    """(z, side, stat array<double>): sufficient statistics, added up in each task and then over tasks, all in Spark."""
    ship(points.sparkSession)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            keys, codes = np.unique(b[["z", "side"]].to_numpy(), axis=0, return_inverse=True)
            for k, s in zip(keys, prior.stats(prior.matrix(b["x"]), codes.ravel(), len(keys)), strict=True):
                held[tuple(k)] = held.get(tuple(k), 0) + s
        yield pd.DataFrame([(int(k[0]), int(k[1]), s) for k, s in held.items()], columns=["z", "side", "stat"])

    parts = points.select(F.col(z).cast("int").alias("z"), F.col(side).cast("int").alias("side"), F.col(x).alias("x")).mapInPandas(part, "z int, side int, stat array<double>")
    summed = parts.select("z", "side", F.posexplode("stat")).groupBy("z", "side", "pos").agg(F.sum("col").alias("v"))
    return summed.groupBy("z", "side").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("stat"))


def sparse_sums(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The matrix whose entries are sums of the parts (at, pos, v): what tasks have added up, of which the rest is 0."""
    out = np.zeros((rows, columns))
    found = parts.groupBy("at", "pos").agg(F.sum("v").alias("v")).toArrow()
    out[found["at"].to_numpy(), found["pos"].to_numpy()] = found["v"].to_numpy()
    return out


def diagonal_stats(points: DataFrame, label: str, x: str = "x") -> DataFrame:
    """(label, dim, n, sum, sum_sq): statistics of diagonal Gaussians, native."""
    return points.select(label, F.posexplode(x).alias("dim", "v")).groupBy(label, "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum"), F.sum(F.col("v").cast("double") * F.col("v").cast("double")).alias("sum_sq"))


def term_counts(docs: DataFrame, label: str, term: str, n: str) -> DataFrame:
    """(label, term, n): counts by component and term, native."""
    return docs.groupBy(label, term).agg(F.sum(n).alias("n"))


def global_moments(points: DataFrame, x: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of all points, from one statistic: what priors are made of by default."""
    first = points.select(F.size(x).alias("d")).limit(1).collect()
    from .priors import NormalInverseWishart

    d = first[0].d
    stat = np.array(component_stats(points.select(x).withColumns({"z": F.lit(0), "side": F.lit(0)}), NormalInverseWishart(np.zeros(d), np.eye(d)), x).collect()[0].stat)
    n, mean = stat[0], stat[1 : 1 + d] / stat[0]
    return mean, (stat[1 + d :].reshape(d, d) - n * np.outer(mean, mean)) / max(1.0, n - 1)


def log_posteriors(points: np.ndarray, log_weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Log responsibilities, a row for each point and a column for each component."""
    joint = np.column_stack([gaussian_log_density(points, m, s) for m, s in zip(means, covs, strict=True)]) + log_weights
    return joint - log_sum_exp(joint)[:, None]


def posteriors(frames: DataFrame, model: DataFrame, x: str = "x", out: str = "post") -> DataFrame:
    """frames with out: each component's posterior (array<double>), components by number.

    model: (component, log_weight, mean, cov). Its size is measured first; blocks of MODEL_BYTES at most are read and sent to
    all tasks one after another, each adding its components' log joints to the frames' rows.
    """
    spark = frames.sparkSession
    ship(spark)
    sizes = model.select("component", (8 * (F.size("mean") * (F.size("mean") + 1) + 2)).alias("bytes")).orderBy("component").collect()  # two numbers a component
    blocks, held = [[]], 0
    for r in sizes:
        if blocks[-1] and held + r.bytes > MODEL_BYTES:
            blocks, held = [*blocks, []], 0
        blocks[-1].append(r.component)
        held += r.bytes
    joint = frames.withColumn(out, F.array().cast("array<double>"))
    for block in blocks:
        if not block:
            continue
        rows = sorted(model.where(F.col("component").between(block[0], block[-1])).collect(), key=lambda r: r["component"])
        joint = joint.withColumn(out, F.concat(out, _joint(spark, rows)(x)))
    m = F.array_max(out)
    total = F.aggregate(out, F.lit(0.0), lambda s, v: s + F.exp(v - m))
    return joint.withColumn(out, F.transform(out, lambda v: F.exp(v - m) / total)) if sizes else joint


def _joint(spark, rows: list):
    """A function of vectors to their log joints with the components of the rows, which it sends to all tasks."""
    shared = spark.sparkContext.broadcast(([r["log_weight"] for r in rows], [np.array(r["mean"]) for r in rows], [np.array(r["cov"]) for r in rows]))

    @F.pandas_udf("array<double>")
    def one(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        points = np.stack(v.to_numpy()).astype(float)
        return pd.Series(list(np.column_stack([gaussian_log_density(points, m, s) + w for w, m, s in zip(*shared.value, strict=True)])))

    return one


def diagonal_log_density(x: Column, mean: Column, var: Column) -> Column:
    """Log density of a diagonal Gaussian, native: x, mean and var are arrays of the same length."""
    z = F.zip_with(F.zip_with(x, mean, lambda a, b: a.cast("double") - b), var, lambda d, v: d * d / v + F.log(v))
    return -0.5 * (C.total(z) + F.size(x) * math.log(2 * math.pi))


#: Bytes of means and variances (or covariances) of the components that are sent to all tasks at once.
MODEL_BYTES = 64 << 20


def diagonal_joint(points: DataFrame, model: DataFrame, key: str, x: str = "x") -> DataFrame:
    """(key, _all): each point's log joint (_j) with each diagonal component (component, log_weight, mean, var), native.

    The model is packed into rows of MODEL_BYTES at most, which are sent to all tasks one after another: each adds its
    components to the points' own rows, so no point is exchanged and no pair of point and component is a row of its own.
    """
    size, n = model.agg(F.coalesce(F.sum(16 * F.size("mean") + 32), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, min(n, -(-size // max(1, MODEL_BYTES))))
    blocks = model.withColumn("_b", F.pmod(F.xxhash64("component"), F.lit(parts)))
    joint = points.select(key, x).withColumn("_all", F.array().cast("array<struct<component:" + model.schema["component"].dataType.simpleString() + ",_j:double>>"))
    for b in range(parts):
        packed = blocks.where(F.col("_b") == b).agg(F.sort_array(F.collect_list(F.struct("component", "log_weight", "mean", "var"))).alias("_model"))
        own = F.transform("_model", lambda c: F.struct(c["component"].alias("component"), (c["log_weight"] + diagonal_log_density(F.col(x), c["mean"], c["var"])).alias("_j")))
        joint = joint.crossJoin(F.broadcast(packed)).withColumn("_all", F.concat("_all", own)).drop("_model")  # one row
    return joint.select(key, F.sort_array("_all").alias("_all"))


def diagonal_posteriors(points: DataFrame, model: DataFrame, key: str, x: str = "x") -> DataFrame:
    """(key, component, post) for diagonal components (component, log_weight, mean, var), native; see :func:`diagonal_joint`."""
    joint = diagonal_joint(points, model, key, x).withColumn("_m", F.array_max(F.transform("_all", lambda c: c["_j"])))
    total = F.aggregate("_all", F.lit(0.0), lambda s, c: s + F.exp(c["_j"] - F.col("_m")))
    return joint.withColumn("_t", total).select(key, "_m", "_t", F.explode("_all").alias("c")).select(key, "c.component", (F.exp(F.col("c._j") - F.col("_m")) / F.col("_t")).alias("post"))


def component_sizes(points: DataFrame, z: str = "z") -> DataFrame:
    """(k, largest): how many components have points, and how many points the largest has."""
    return points.groupBy(z).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("k"), F.max("_n").alias("largest"))


def hard_labels(posterior: DataFrame, key: str) -> DataFrame:
    """(key, component): the most probable component, the least number if equal."""
    return posterior.groupBy(key).agg(F.max_by("component", F.struct("post", -F.col("component"))).alias("component"))


def best_components(points: DataFrame, model: DataFrame, key: str, x: str = "x") -> DataFrame:
    """(key, component): the same from the points and a diagonal model, each point's within its row: no point is exchanged."""
    joint = diagonal_joint(points, model, key, x)
    best = F.array_max(F.transform("_all", lambda c: F.struct(c["_j"].alias("j"), (-c["component"]).alias("c"))))
    return joint.select(key, (-best["c"]).alias("component"))


def joint_log_likelihood(stats: dict[int, np.ndarray], prior: ConjugatePrior, alpha: float = 1.0) -> float:
    """Log probability of a partition and its points, components integrated out, under a Dirichlet process."""
    n = sum(s[0] for s in stats.values())
    return math.lgamma(alpha) - math.lgamma(alpha + n) + sum(math.log(alpha) + math.lgamma(s[0]) + prior.log_marginal(s) for s in stats.values() if s[0] > 0)


def label_log_likelihood(points: DataFrame, prior: ConjugatePrior, alpha: float = 1.0, x: str = "x", z: str = "z") -> float:
    """The same from labelled points: one job for the statistics, K rows to the driver."""
    rows = component_stats(points.withColumn("_s", F.lit(0)), prior, x, z, "_s").collect()
    return joint_log_likelihood({r.z: np.array(r.stat) for r in rows}, prior, alpha)


# Native sums over sparse counts and coordinates ------------------------------------------------------------------------


def count_marginals(counts: DataFrame, by: list[str], terms: int, alpha: float = 1.0, n: str = "n") -> DataFrame:
    """(by, total, value): log marginal of term counts (by, term, n) under a symmetric Dirichlet over `terms` terms.

    Terms without a count add nothing, so only those there are are read.
    """
    part = C.log_gamma(F.col(n) + F.lit(float(alpha))) - math.lgamma(alpha)
    summed = counts.withColumn("_part", part).groupBy(*by).agg(F.sum(n).alias("total"), F.sum("_part").alias("_sum"))
    return summed.select(*by, "total", (F.col("_sum") + math.lgamma(terms * alpha) - C.log_gamma(F.col("total") + F.lit(float(terms * alpha)))).alias("value"))


def merge_gains(counts: DataFrame, terms: int, alpha: float = 1.0, component: str = "component", term: str = "term", n: str = "n") -> DataFrame:
    """(a, b, gain) for each pair of components, a < b: how much the log marginal grows if they are one.

    A row for each pair is what is asked for; components are few, but a component's counts need not be.
    """
    own = count_marginals(counts, [component], terms, alpha, n)
    names = own.select(F.col(component).alias("a"))
    pairs = names.join(names.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    both = pairs.withColumn("_own", F.explode(F.array("a", "b"))).join(counts.withColumnRenamed(component, "_own"), "_own").groupBy("a", "b", term).agg(F.sum(n).alias(n))
    one = lambda side: own.select(F.col(component).alias(side), F.col("value").alias(f"_{side}"))
    merged = count_marginals(both, ["a", "b"], terms, alpha, n).join(one("a"), "a").join(one("b"), "b")
    return merged.select("a", "b", (F.col("value") - F.col("_a") - F.col("_b")).alias("gain"))


def count_densities(docs: DataFrame, counts: DataFrame, terms: int, alpha: float = 1.0, key: str = "pid") -> DataFrame:
    """(key, component, log_p): log probability of each document (key, term, n) under each component's mean probabilities.

    counts: (component, term, n) of the components; a term that a component lacks has the prior's share. A document's terms
    meet the components' on the term, so neither is made dense.
    """
    totals = counts.groupBy("component").agg(F.sum("n").alias("_total"))  # a row for each component
    shares = totals.select("component", (F.col("_total") + F.lit(float(terms * alpha))).alias("_mass"))
    seen = docs.join(counts.withColumnRenamed("n", "_there"), "term").join(F.broadcast(shares), "component")
    # What a document's terms gain over the prior's share, where the component has them, and that share for all.
    gain = seen.groupBy(key, "component").agg(F.sum(F.col("n") * F.log1p(F.col("_there") / F.lit(float(alpha)))).alias("_gain"))
    whole = docs.withColumn("_f", C.log_gamma(F.col("n") + F.lit(1.0))).groupBy(key).agg(F.sum("n").alias("_n"), F.sum("_f").alias("_f"))
    base = whole.withColumn("_c", C.log_gamma(F.col("_n") + F.lit(1.0)) - F.col("_f")).crossJoin(F.broadcast(shares))  # components
    found = base.join(gain, [key, "component"], "left")
    return found.select(key, "component", (F.col("_c") + F.coalesce("_gain", F.lit(0.0)) + F.col("_n") * (math.log(alpha) - F.log("_mass"))).alias("log_p"))


def coordinate_predictives(stats: DataFrame, label: str, kappa: float = 1.0, nu: float = 4.0, scale: float = 4.0) -> DataFrame:
    """(label, dim, df, centre, spread): the Student-t of one more value of each coordinate, from (label, dim, n, sum, sum_sq).

    The prior has mean 0, `kappa` and `nu` observations' weight and the sum of squares `scale`.
    """
    k, df = F.col("n") + kappa, F.col("n") + nu
    centre = F.col("sum") / k
    squares = F.lit(scale) + F.col("sum_sq") - k * centre * centre
    return stats.select(label, "dim", df.alias("df"), centre.alias("centre"), (squares * (k + 1) / (k * df)).alias("spread"))


def student_log_density(x: Column, df: Column, centre: Column, spread: Column, constant: Column) -> Column:
    """Log density of a Student-t; constant: log_gamma((df + 1) / 2) - log_gamma(df / 2), which depends on the component only."""
    d = x - centre
    return constant - 0.5 * F.log(df * math.pi * spread) - (df + 1) / 2 * F.log1p(d * d / (df * spread))
