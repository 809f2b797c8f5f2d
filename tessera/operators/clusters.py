"""Clustering with several starts, and a small mixture model with diagonal covariances."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.learning import side_by_side


def features(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with the columns as one vector."""
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def kmeans(vectors: DataFrame, ks: Sequence[int], starts: int = 10, seed: int = 1) -> dict:
    """For each number of clusters the best of several k-means models by the sum of squares; fits run side by side."""
    fits = side_by_side(lambda job: (job[0], KMeans(k=job[0], seed=seed + job[1]).fit(vectors)), [(k, s) for k in ks for s in range(starts)])
    return {k: min((m for n, m in fits if n == k), key=lambda m: m.summary.trainingCost) for k in ks}


def kmeans_bic(model, d: int) -> float:
    """Information criterion of a k-means model under spherical clusters of one variance."""
    sizes = [n for n in model.summary.clusterSizes if n]
    n, k = sum(sizes), len(model.clusterCenters())
    var = max(model.summary.trainingCost / (max(n - k, 1) * d), 1e-12)
    ll = sum(m * math.log(m) - m * math.log(n) - m * d / 2 * math.log(2 * math.pi * var) - (m - 1) * d / 2 for m in sizes)
    return -2 * ll + k * (d + 1) * math.log(n)


def mixture(vectors: DataFrame, k: int, seed: int = 1):
    """A mixture of normals with full covariances, and its information criterion."""
    model = GaussianMixture(k=k, seed=seed, maxIter=50).fit(vectors)
    n, d = vectors.count(), len(model.gaussians[0].mean)
    return model, -2 * model.summary.logLikelihood + (k - 1 + k * d + k * d * (d + 1) / 2) * math.log(n)


def diagonal_mixture(df: DataFrame, columns: list[str], k: int, rounds: int = 30, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(weights, means, variances, bic) of normals with diagonal covariances, by EM with one aggregation per round."""
    spark = df.sparkSession
    rows = df.select(*columns).dropna()
    first = rows.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.var_pop(c) for c in columns]).first()
    n, d = first[0], len(columns)
    mean, var = np.array(first[1 : d + 1], float), np.maximum(np.array(first[d + 1 :], float), 1e-6)
    rng = np.random.default_rng(seed)
    w, mu, s2 = np.full(k, 1 / k), mean + rng.normal(size=(k, d)) * np.sqrt(var), np.tile(var, (k, 1))
    width = 1 + 2 * d
    loglik = -math.inf
    for _ in range(rounds):
        handle = spark.sparkContext.broadcast((w, mu, s2))

        def step(batches):
            import pandas as pd

            weight, centre, spread = handle.value
            total = np.zeros((k, width + 1))
            for b in batches:
                x = b.to_numpy(float)
                logp = np.log(weight) - 0.5 * (((x[:, None] - centre) ** 2 / spread) + np.log(2 * np.pi * spread)).sum(2)
                top = logp.max(1, keepdims=True)
                p = np.exp(logp - top)
                norm = p.sum(1, keepdims=True)
                r = p / norm
                total[:, 0] += r.sum(0)
                total[:, 1 : d + 1] += r.T @ x
                total[:, d + 1 : width] += r.T @ (x * x)
                total[0, width] += float((top + np.log(norm)).sum())
            yield pd.DataFrame({"j": range(k), "v": list(total)})

        got = rows.mapInPandas(step, "j int, v array<double>").groupBy("j").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(width + 1)]).orderBy("j").collect()
        t = np.array([list(r)[1:] for r in got])
        new = t[:, width].sum()
        m = np.maximum(t[:, 0], 1e-9)
        w, mu = m / m.sum(), t[:, 1 : d + 1] / m[:, None]
        s2 = np.maximum(t[:, d + 1 : width] / m[:, None] - mu**2, 1e-4)
        if abs(new - loglik) < 1e-6 * abs(new):
            break
        loglik = new
    return w, mu, s2, -2 * float(loglik) + (k - 1 + 2 * k * d) * math.log(max(n, 1))
