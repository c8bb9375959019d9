"""Gaussian mixtures of many groups by expectation maximisation over all rows, with the number of components by BIC."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Files, shared_folder, stored
from .shards import beside, dealt, sharded

MAX_CLUSTERS, STARTS, ROUNDS = 50, 3, 40
#: Added to the diagonal of covariances; a fit ends when a round adds less than this to the log likelihood of a row.
RIDGE, ENOUGH = 1e-4, 1e-3
#: Groups up to this size are fitted in one task; the rounds of larger ones are Spark jobs over shards. Both do the same.
TASK_ROWS = 4000
#: Rows of a group that a task of a round takes: few, as each of them meets every mixture.
SHARD_ROWS = 10_000

Parameters = tuple[np.ndarray, np.ndarray, np.ndarray]


def log_density(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """rows x components: log of weight times density."""
    low = np.linalg.cholesky(covs)
    inverse = np.linalg.inv(low)
    z = np.einsum("kij,nj->kni", inverse, x, optimize=True) - np.einsum("kij,kj->ki", inverse, means)[:, None]
    height = np.log(weights) - 0.5 * x.shape[1] * np.log(2 * np.pi) - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1)
    return (height[:, None] - 0.5 * (z**2).sum(2)).T


def features(x: np.ndarray) -> np.ndarray:
    """One, the entries of each row, and their products: log densities are linear in them, and the sums of a round are sums of them."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], 1)


def expectation(seen: np.ndarray, parameters: Parameters) -> np.ndarray:
    """What rows add up to under a mixture: log likelihood, then mass, sums and outer products of each component, as one array.

    seen: the features of the rows. Densities of all components and their sums are one matrix product each.
    """
    weights, means, covs = parameters
    k, d = means.shape
    low = np.linalg.cholesky(covs)
    inverse = np.linalg.inv(low)
    precision = np.einsum("kji,kjl->kil", inverse, inverse)
    linear = np.einsum("kij,kj->ki", precision, means)
    height = np.log(weights) - 0.5 * d * np.log(2 * np.pi) - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1) - 0.5 * (linear * means).sum(1)
    i, j = np.triu_indices(d)
    logs = seen @ np.concatenate([height[:, None], linear, precision[:, i, j] * np.where(i == j, -0.5, -1.0)], 1).T
    top = logs.max(1, keepdims=True)
    share = np.exp(logs - top)
    whole = share.sum(1, keepdims=True)
    share /= whole
    sums = share.T @ seen
    outer = np.empty((k, d, d))
    outer[:, i, j] = outer[:, j, i] = sums[:, d + 1 :]
    return np.concatenate([[top.sum() + np.log(whole).sum()], sums[:, 0], sums[:, 1 : d + 1].ravel(), outer.ravel()])


def maximisation(sums: np.ndarray, k: int, d: int) -> tuple[float, Parameters]:
    """(log likelihood, new parameters) from the sums of all rows."""
    mass = sums[1 : k + 1] + 1e-9
    means = sums[k + 1 : k + 1 + k * d].reshape(k, d) / mass[:, None]
    covs = sums[k + 1 + k * d :].reshape(k, d, d) / mass[:, None, None] - means[:, :, None] * means[:, None, :]
    values, axes = np.linalg.eigh((covs + covs.transpose(0, 2, 1)) / 2)  # rounding may leave a flat direction under zero
    covs = np.einsum("kij,kj,klj->kil", axes, np.maximum(values, 0) + RIDGE, axes)
    return float(sums[0]), (mass / mass.sum(), means, covs)


def flat(parameters: Parameters) -> list[float]:
    return np.concatenate([p.ravel() for p in parameters]).tolist()


def shaped(numbers, k: int, d: int) -> Parameters:
    p = np.asarray(numbers, float)
    return p[:k], p[k : k + k * d].reshape(k, d), p[k + k * d :].reshape(k, d, d)


def first_parameters(starts: np.ndarray, spread: np.ndarray, k: int) -> Parameters:
    """Equal weights, the first k starting rows as means, and the covariance of all rows for each component."""
    return np.full(k, 1 / k), starts[:k], np.repeat((spread + RIDGE * np.eye(len(spread)))[None], k, 0)


def spread_of(n: int, sums: np.ndarray, outer: np.ndarray) -> np.ndarray:
    return (outer - np.outer(sums, sums) / n) / (n - 1)


def most_components(n: int, most: int) -> int:
    return min(most, n // 2, n - 1)


def bic(log_likelihood: float, k: int, d: int, n: int) -> float:
    return -2 * log_likelihood + (k * d + k * d * (d + 1) / 2 + k - 1) * np.log(n)


def fit_mixture(x: np.ndarray, k: int, starts: np.ndarray) -> tuple[float, Parameters]:
    """(log likelihood, parameters) of one start."""
    n, d = x.shape
    parameters, last, seen = first_parameters(starts, spread_of(n, x.sum(0), x.T @ x), k), -np.inf, features(x)
    for _ in range(ROUNDS):
        likelihood, parameters = maximisation(expectation(seen, parameters), k, d)
        if likelihood - last < ENOUGH * n:
            break
        last = likelihood
    return likelihood, parameters


def best_mixture(x: np.ndarray, orders: list[np.ndarray] | None = None, most: int = MAX_CLUSTERS) -> Parameters | None:
    """Parameters with the lowest BIC over k = 2 .. min(most, n / 2, n - 1) and all starts; None for fewer than four rows.

    orders: for each start, in which order rows become first means; by default random ones.
    """
    n, d = x.shape
    orders = [np.random.default_rng(s).permutation(n) for s in range(STARTS)] if orders is None else orders
    fits = [(bic(f[0], k, d, n), k, s, f[1]) for k in range(2, most_components(n, most) + 1) for s, order in enumerate(orders) for f in [fit_mixture(x, k, x[order[:k]])]]
    return min(fits, key=lambda f: f[:3])[3] if fits else None


def fit_mixtures(rows: DataFrame, group: str, key: str, vector: str, most: int = MAX_CLUSTERS, task_rows: int = TASK_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(group, n, k, parameters) of the mixture of lowest BIC over all rows of each group; one component where there are
    fewer than four rows. First means are the rows of least hash of start and key, so results do not depend on the dealing.
    """
    name = rows.schema[group].dataType.simpleString()
    held = rows.select(group, key, F.transform(vector, lambda v: v.cast("double")).alias("x"))
    sizes = stored(held.groupBy(group).agg(F.count("*").alias("n"), F.first(F.size("x")).alias("d")), "mixture-sizes")
    ranks = [F.xxhash64(F.lit(s), F.col(key).cast("string")).alias(f"start{s}") for s in range(STARTS)]
    schema = f"{group} {name}, n long, k int, parameters array<double>"

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["x"].to_numpy())
        text = frame[key].astype(str).to_numpy()
        got = best_mixture(x, [np.lexsort((text, frame[f"start{s}"])) for s in range(STARTS)], most)
        p = got or (np.ones(1), x.mean(0, keepdims=True), np.eye(x.shape[1])[None])
        return pd.DataFrame({group: [frame[group].iloc[0]], "n": [len(x)], "k": [len(p[0])], "parameters": [flat(p)]})

    small = sizes.where(F.col("n") <= task_rows).select(F.col(group).alias("small_group"))
    fitted = held.join(small, F.col(group).eqNullSafe(F.col("small_group"))).drop("small_group").select("*", *ranks)
    fitted = dealt(fitted, group).groupBy(group).applyInPandas(fit, schema)
    large = stored(sizes.where(F.col("n") > task_rows), "mixture-large")
    if not large.limit(1).count():
        return fitted
    return fitted.unionByName(_fit_large(held, group, key, large, most, shard_rows))


def _summed(partial: DataFrame, by: list[str], finish, schema: str) -> DataFrame:
    """Adds up arrays: first some shards at a time, then what that leaves, so that no task reads all shards of a group."""
    def some(frame: pd.DataFrame) -> pd.DataFrame:
        one = frame.iloc[:1].copy()
        one["sums"] = [np.sum(np.stack(frame["sums"].to_numpy()), 0).tolist()]
        return one

    parts = partial.withColumn("dealt", F.pmod("shard", F.lit(32)))
    return parts.groupBy(*by, "dealt").applyInPandas(some, parts.schema).drop("dealt").groupBy(*by).applyInPandas(lambda frame: finish(some(frame).iloc[0]), schema)


def _fit_large(held: DataFrame, group: str, key: str, sizes: DataFrame, most: int, shard_rows: int) -> DataFrame:
    """The same fits as jobs: each round, one pass over the rows adds up what every mixture that has not converged needs."""
    spark, name = held.sparkSession, held.schema[group].dataType.simpleString()
    rows = stored(sharded(held, group, key, sizes, shard_rows).select(group, "shard", key, "x"), "mixture-rows")

    def moments(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["x"].to_numpy())
        return pd.DataFrame({group: [frame[group].iloc[0]], "shard": [frame["shard"].iloc[0]], "sums": [[float(len(x)), *x.sum(0), *(x.T @ x).ravel()]]})

    whole = rows.groupBy(group, "shard").applyInPandas(moments, f"{group} {name}, shard int, sums array<double>")
    whole = stored(_summed(whole, [group], lambda r: pd.DataFrame({group: [r[group]], "sums": [r["sums"]]}), f"{group} {name}, sums array<double>"), "mixture-moments")
    each = rows.select(group, key, "x", F.explode(F.array(*[F.lit(s) for s in range(STARTS)])).alias("start"))
    order = F.row_number().over(Window.partitionBy(group, "start").orderBy(F.xxhash64("start", F.col(key).cast("string")), F.col(key).cast("string")))
    first = each.withColumn("place", order).where(F.col("place") <= most).select(group, "start", "place", "x")
    models = f"{group} {name}, k int, start int, last double, done boolean, parameters array<double>"

    def begin(starts: pd.DataFrame, moment: pd.DataFrame) -> pd.DataFrame:
        sums = np.asarray(moment["sums"].iloc[0])
        d, n = len(starts["x"].iloc[0]), int(sums[0])
        spread = spread_of(n, sums[1 : d + 1], sums[d + 1 :].reshape(d, d))
        made = []
        for s, mine in starts.groupby("start"):
            x = np.stack(mine.sort_values("place")["x"].to_numpy())
            made += [(starts[group].iloc[0], k, int(s), -np.inf, False, flat(first_parameters(x, spread, k))) for k in range(2, most_components(n, most) + 1)]
        return pd.DataFrame(made, columns=[group, "k", "start", "last", "done", "parameters"])

    now = stored(first.groupBy(group).cogroup(whole.groupBy(group)).applyInPandas(begin, models), "mixture-models")

    def add(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(found):
            return pd.DataFrame({c: pd.Series([], dtype="object") for c in (group, "shard", "k", "start", "last", "sums")})
        x = np.stack(frame["x"].to_numpy())
        seen = features(x)
        sums = [expectation(seen, shaped(p, k, x.shape[1])).tolist() for k, p in zip(found["k"], found["parameters"])]
        return found[[group, "shard", "k", "start", "last"]].assign(sums=sums)

    def renew(r: pd.Series) -> pd.DataFrame:
        k, size = int(r["k"]), len(r["sums"]) - 1  # k (1 + d + d d) numbers
        d = int(round((-1 + np.sqrt(1 - 4 * (1 - size / k))) / 2))
        likelihood, parameters = maximisation(np.asarray(r["sums"]), k, d)
        return pd.DataFrame({group: [r[group]], "k": [k], "start": [int(r["start"])], "last": [likelihood], "gain": [likelihood - r["last"]], "parameters": [flat(parameters)]})

    partial, renewed = f"{group} {name}, shard int, k int, start int, last double, sums array<double>", f"{group} {name}, k int, start int, last double, gain double, parameters array<double>"
    folder, files = shared_folder(spark, "mixture-rounds"), Files(spark, shared_folder(spark, "x"))
    for number in range(ROUNDS):
        new = _summed(beside(rows, now.where("not done"), group, add, partial), [group, "k", "start"], renew, renewed)
        new = new.join(sizes.select(F.col(group).alias("sized"), "n"), F.col(group).eqNullSafe(F.col("sized"))).withColumn("done", F.col("gain") < ENOUGH * F.col("n"))
        now.where("done").unionByName(new.select(group, "k", "start", "last", "done", "parameters")).write.parquet(f"{folder}/{number}")
        now = spark.read.schema(now.schema).parquet(f"{folder}/{number}")
        if number:
            files.delete(f"{folder}/{number - 1}")
        if not now.where("not done").limit(1).count():
            break
    known = now.join(sizes.select(F.col(group).alias("sized"), "n", "d"), F.col(group).eqNullSafe(F.col("sized"))).drop("sized")
    cost = F.expr("-2 * last + (k * d + k * d * (d + 1) / 2 + k - 1) * ln(n)")
    best = known.groupBy(group).agg(F.min_by(F.struct("n", "k", "parameters"), F.struct(cost, "k", "start")).alias("best"))
    return best.select(group, "best.*")


def assign(rows: DataFrame, models: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, key, cluster): the likeliest component of each row."""
    types = {c: rows.schema[c].dataType.simpleString() for c in (group, key)}
    held = sharded(rows.select(group, key, F.col(vector).alias("x")), group, key, models.select(group, "n"))

    def label(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        x, k = np.stack(frame["x"].to_numpy()).astype(float), int(found["k"].iloc[0])
        return frame[[group, key]].assign(cluster=log_density(x, *shaped(found["parameters"].iloc[0], k, x.shape[1])).argmax(1).astype(np.int32))

    return beside(held, models.select(group, "k", "parameters"), group, label, f"{group} {types[group]}, {key} {types[key]}, cluster int")
