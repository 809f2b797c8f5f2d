"""Posterior sampling by adaptive Metropolis chains, one task per chain, and diagnostics over long-form draws."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.special import _lgamma, log_half_normal, log_negbin, log_normal, log_poisson

LogDensity = Callable[[np.ndarray], float]
DRAWS = "chain int, draw int, param string, value double"


def metropolis(log_density: LogDensity, start: np.ndarray, tune: int, draws: int, rng: np.random.Generator, blocks: Sequence[Sequence[int]] | None = None, target: float = 0.234) -> np.ndarray:
    """Draws of a random-walk chain whose scale and covariance adapt while tuning, block by block.

    Each block keeps a running mean and covariance of the chain; its scale follows the Robbins-Monro rule towards the
    target acceptance. Both freeze after tuning.
    """
    x = np.array(start, float)
    now = log_density(x)
    if not math.isfinite(now):
        raise ValueError("the start has no density")
    blocks = [np.array(b) for b in (blocks or [range(len(x))])]
    scale = [2.38 / math.sqrt(len(b)) * 0.3 for b in blocks]
    mean = [x[b].copy() for b in blocks]
    cov = [np.eye(len(b)) * 0.1 for b in blocks]
    root = [np.linalg.cholesky(c) for c in cov]
    out = np.empty((draws, len(x)))
    for t in range(tune + draws):
        for i, b in enumerate(blocks):
            new = x.copy()
            new[b] += scale[i] * root[i] @ rng.standard_normal(len(b))
            then = log_density(new)
            rate = math.exp(min(0.0, then - now)) if math.isfinite(then) else 0.0
            if rng.random() < rate:
                x, now = new, then
            if t < tune:
                gain = 1 / (t + 2) ** 0.6
                scale[i] *= math.exp(gain * (rate - target))
                off = x[b] - mean[i]
                mean[i] += gain * off
                cov[i] += gain * (np.outer(off, off) - cov[i])
                if t % 50 == 49:
                    root[i] = np.linalg.cholesky(cov[i] + 1e-8 * np.eye(len(b)))
        if t >= tune:
            out[t - tune] = x
    return out


def sample(spark: SparkSession, log_density: LogDensity, names: Sequence[str], start: np.ndarray, chains: int = 4, tune: int = 1_000, draws: int = 1_000, seed: int = 1, blocks=None) -> DataFrame:
    """(chain, draw, param, value) of independent chains, one task each; a chain's seed is seed + 1000 * chain."""
    names, start = list(names), np.array(start, float)
    if len(names) != len(start):
        raise ValueError("one name per parameter")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b["id"]:
                rng = np.random.default_rng(seed + 1_000 * int(c))
                got = metropolis(log_density, start + 0.05 * rng.standard_normal(len(start)), tune, draws, rng, blocks)
                yield pd.DataFrame({"chain": int(c), "draw": np.repeat(np.arange(draws), len(names)), "param": names * draws, "value": got.ravel()})

    return spark.range(0, chains, 1, chains).mapInPandas(run, DRAWS)


def fit(spark: SparkSession, log_density: LogDensity, names: Sequence[str], start: np.ndarray, attempts: int = 3, tune: int = 1_000, draws: int = 1_000, **options) -> tuple[DataFrame, bool]:
    """Draws and whether they converged; tuning and draws double between attempts."""
    from tessera.session import materialize

    for i in range(attempts):
        got = materialize(sample(spark, log_density, names, start, tune=tune << i, draws=draws << i, seed=1 + i, **options), "draws")
        bad = summary(got).where("rhat > 1.01 OR ess < 400").limit(1).count()
        if not bad:
            return got, True
    return got, False


def rhat(draws: DataFrame) -> DataFrame:
    """(param, rhat): split R-hat; the last draw of an odd chain is left out."""
    n = draws.groupBy("param", "chain").agg(F.floor(F.count("*") / 2).alias("h"))
    half = draws.join(n, ["param", "chain"]).withColumn("part", F.floor(F.col("draw") / F.col("h"))).where("part < 2")
    each = half.groupBy("param", "chain", "part").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    s = each.groupBy("param").agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.max("n").alias("n"))
    return s.select("param", F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w")).alias("rhat"))


def _ess(pdf: pd.DataFrame) -> pd.DataFrame:
    x = pdf.sort_values(["chain", "draw"])
    a = np.array([g["value"].to_numpy() for _, g in x.groupby("chain")])
    m, n = a.shape
    a = a - a.mean(1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    acov = np.fft.irfft(np.abs(np.fft.rfft(a, size, axis=1)) ** 2, size, axis=1)[:, :n] / n
    rho = acov.mean(0) / acov[:, 0].mean() if acov[:, 0].mean() > 0 else np.zeros(n)
    total, t = 0.0, 1
    while t + 1 < n and rho[t] + rho[t + 1] > 0:
        total += rho[t] + rho[t + 1]
        t += 2
    return pd.DataFrame({"param": [pdf["param"].iloc[0]], "ess": [min(m * n / (1 + 2 * total), float(m * n))]})


def ess(draws: DataFrame) -> DataFrame:
    """(param, ess): effective draws by the initial positive pairs of the autocorrelation."""
    return draws.groupBy("param").applyInPandas(_ess, "param string, ess double")


def hdi(draws: DataFrame, prob: float = 0.94, by: Sequence[str] = ("param",), value: str = "value") -> DataFrame:
    """(by, lo, hi): the shortest interval that skips floor(prob * n) sorted draws; the first of equals."""
    n = Window.partitionBy(*by)
    w = n.orderBy(value)
    ranked = draws.select(*by, F.col(value).alias("lo"), F.row_number().over(w).alias("i"), F.greatest(F.floor(prob * F.count("*").over(n)), F.lit(1)).cast("int").alias("k"))
    ends = ranked.select(*by, F.col("lo").alias("hi"), (F.col("i") - F.col("k")).alias("i"))
    spans = ranked.select(*by, "lo", "i").join(ends, [*by, "i"]).withColumn("width", F.col("hi") - F.col("lo"))
    return spans.groupBy(*by).agg(F.min(F.struct("width", "i", "lo", "hi")).alias("s")).select(*by, "s.lo", "s.hi")


def weighted_summary(df: DataFrame, value: str, weight: str, prob: float = 0.94) -> DataFrame:
    """One row (mean, sd, lo, hi) of weighted draws; the interval is the shortest with at least `prob` of the weight."""
    total = df.agg(F.sum(weight)).first()[0]
    w = Window.partitionBy(F.lit(1)).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = df.groupBy(value).agg((F.sum(weight) / F.lit(total)).alias("p")).select(F.col(value).alias("v"), "p", F.sum("p").over(w).alias("c"))
    rows = c.orderBy("v").collect() if c.count() <= 100_000 else None
    if rows is None:
        raise ValueError("summarise at most 100,000 different values")
    v, p, cum = (np.array([r[k] for r in rows]) for k in ("v", "p", "c"))
    end = np.searchsorted(cum, cum - p + prob - 1e-12)
    ok = end < len(v)
    best = np.argmin(np.where(ok, v[np.minimum(end, len(v) - 1)] - v, np.inf))
    mean = float((v * p).sum())
    return df.sparkSession.createDataFrame([(mean, float(math.sqrt(((v - mean) ** 2 * p).sum())), float(v[best]), float(v[end[best]]))], "mean double, sd double, lo double, hi double")


def summary(draws: DataFrame) -> DataFrame:
    """(param, mean, sd, lo, hi, rhat, ess, converged)."""
    base = draws.groupBy("param").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    full = base.join(hdi(draws), "param").join(rhat(draws), "param").join(ess(draws), "param")
    return full.withColumn("converged", (F.col("rhat") <= 1.01) & (F.col("ess") >= 400))


def pointwise(ll: DataFrame) -> DataFrame:
    """(obs, lppd, p, elpd) of (draw, obs, ll): log mean density, its variance, and their difference."""
    top = ll.groupBy("obs").agg(F.max("ll").alias("top"))
    s = ll.join(top, "obs").groupBy("obs").agg((F.first("top") + F.log(F.avg(F.exp(F.col("ll") - F.col("top"))))).alias("lppd"), F.var_samp("ll").alias("p"))
    return s.withColumn("elpd", F.col("lppd") - F.col("p"))


def waic(ll: DataFrame) -> DataFrame:
    """One row (elpd, p, waic, se)."""
    return pointwise(ll).agg(F.sum("elpd").alias("elpd"), F.sum("p").alias("p"), (-2 * F.sum("elpd")).alias("waic"), F.sqrt(F.count("*") * F.var_samp("elpd")).alias("se"))


def fit_pareto(x: np.ndarray) -> tuple[float, float]:
    """(k, sigma) of a generalised Pareto distribution by the profile posterior mean over a grid."""
    x = np.sort(x)
    n = len(x)
    m = 30 + int(math.sqrt(n))
    q = x[max(int(n / 4 + 0.5) - 1, 0)]
    b = 1 / x[-1] + (1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3 * q)
    k = np.log1p(-b[:, None] * x).mean(1)
    profile = n * (np.log(-b / k) - k - 1)
    w = 1 / np.exp(np.clip(profile[None] - profile[:, None], -700, 700)).sum(1)
    mean_b = float((b * w).sum() / w.sum())
    shape = float(np.log1p(-mean_b * x).mean())
    sigma = -shape / mean_b
    return (n * shape + 5) / (n + 10), sigma


def _psis(pdf: pd.DataFrame) -> pd.DataFrame:
    ll = pdf["ll"].to_numpy()
    w = -ll - (-ll).max()
    n = len(w)
    tail = int(min(0.2 * n, 3 * math.sqrt(n)))
    k = math.nan
    if tail >= 5:
        order = np.argsort(w)
        cut = w[order[-tail - 1]]
        over = np.exp(w[order[-tail:]]) - math.exp(cut)
        if over[0] >= 0 and over[-1] > 0:
            k, sigma = fit_pareto(np.maximum(over, 1e-300))
            p = (np.arange(tail) + 0.5) / tail
            smooth = sigma / k * ((1 - p) ** -k - 1) if abs(k) > 1e-8 else -sigma * np.log1p(-p)
            w[order[-tail:]] = np.minimum(np.log(math.exp(cut) + np.maximum(smooth, 0)), 0.0)
    w = w - (w.max() + np.log(np.exp(w - w.max()).sum()))
    top = (w + ll).max()
    return pd.DataFrame({"obs": [int(pdf["obs"].iloc[0])], "elpd": [float(top + np.log(np.exp(w + ll - top).sum()))], "k": [k]})


def loo(ll: DataFrame) -> DataFrame:
    """(obs, elpd, k): leave-one-out densities by Pareto-smoothed importance sampling; one group per observation."""
    return ll.groupBy("obs").applyInPandas(_psis, "obs bigint, elpd double, k double")


def compare(models: dict[str, DataFrame]) -> DataFrame:
    """(model, elpd, diff, se) of pointwise elpd tables, best first; the error is that of the paired differences."""
    every = None
    for name, t in models.items():
        part = t.select(F.lit(name).alias("model"), "obs", "elpd")
        every = part if every is None else every.unionByName(part)
    best = every.groupBy("model").agg(F.sum("elpd").alias("s")).orderBy(F.desc("s"), "model").first()["model"]
    ref = every.where(F.col("model") == best).select("obs", F.col("elpd").alias("b"))
    d = every.join(ref, "obs").groupBy("model").agg(F.sum("elpd").alias("elpd"), F.sum(F.col("elpd") - F.col("b")).alias("diff"), F.sqrt(F.count("*") * F.var_samp(F.col("elpd") - F.col("b"))).alias("se"))
    return d.orderBy(F.desc("elpd"), "model")


# --- models: densities of plain arrays, picklable with their data ------------------------------------------------------
class HierarchicalRates:
    """Counts y with exposure per group: `pooled`, `poisson`, `negbin`, `walk` (yearly random walk) or `period` effects.

    Parameters: mean log rate; then log sd and one offset per group unless pooled; then log dispersion for the negative
    binomial kinds; then log sd and standardised effects in the walk's spectral basis, or effects that sum to 0.
    """

    def __init__(self, kind: str, y: np.ndarray, exposure: np.ndarray, group: np.ndarray, time: np.ndarray) -> None:
        self.kind, self.y, self.x, self.g, self.t = kind, np.asarray(y, float), np.log(np.asarray(exposure, float)), np.asarray(group), np.asarray(time)
        self.groups, self.times = int(self.g.max()) + 1, int(self.t.max()) + 1
        self.different, self.at = np.unique(self.y, return_inverse=True)
        self.constant = _lgamma(self.y + 1)
        self.names = ["mean"]
        if kind != "pooled":
            self.names += ["log_sd", *[f"group_{i}" for i in range(self.groups)]]
        if kind in ("negbin", "walk", "period"):
            self.names.append("log_phi")
        if kind == "walk":
            steps = np.diff(np.eye(self.times), axis=0)
            value, vector = np.linalg.eigh(steps.T @ steps)
            self.basis = vector[:, 1:] / np.sqrt(value[1:])
            self.names += ["log_walk_sd", *[f"walk_{i}" for i in range(self.times - 1)]]
        if kind == "period":
            self.names += ["log_period_sd", *[f"period_{i}" for i in range(self.times - 1)]]
        self.start = np.zeros(len(self.names))
        self.start[0] = math.log((self.y.sum() + 0.5) / np.exp(self.x).sum())
        if kind != "pooled":
            self.start[1] = math.log(0.5)

    def log_rate(self, p: np.ndarray) -> np.ndarray:
        eta = np.full(len(self.y), p[0])
        if self.kind != "pooled":
            eta = eta + p[2 : 2 + self.groups][self.g]
        if self.kind in ("walk", "period"):
            at = 3 + self.groups
            sd, z = math.exp(p[at]), p[at + 1 :]
            effect = self.basis @ z * sd if self.kind == "walk" else np.concatenate([z, [-z.sum()]]) * sd
            eta = eta + effect[self.t]
        return eta

    def pointwise(self, p: np.ndarray) -> np.ndarray:
        eta = np.clip(self.log_rate(p) + self.x, -30, 30)
        if self.kind in ("pooled", "poisson"):
            return self.y * eta - np.exp(eta) - self.constant
        phi = math.exp(min(max(p[2 + self.groups], -10), 15))
        far = np.log(phi + np.exp(eta))
        return (_lgamma(self.different + phi) - math.lgamma(phi))[self.at] - self.constant + phi * (math.log(phi) - far) + self.y * (eta - far)

    def blocks(self) -> list[list[int]]:
        """Parameters that a chain moves together: group and time effects in small blocks, the others on their own."""
        runs: dict[str, list[int]] = {}
        for i, name in enumerate(self.names):
            runs.setdefault(name.rstrip("0123456789"), []).append(i)
        return [r[i : i + 6] for r in runs.values() for i in range(0, len(r), 6)]

    def __call__(self, p: np.ndarray) -> float:
        prior = float(log_normal(p[0], self.start[0], 3.0))
        if self.kind != "pooled":
            sd = math.exp(min(p[1], 10))
            prior += float(log_half_normal(sd, 1.0)) + p[1] + float(log_normal(p[2 : 2 + self.groups], 0.0, max(sd, 1e-8)).sum())
        if self.kind in ("negbin", "walk", "period"):
            prior += float(log_normal(p[2 + self.groups], 1.0, 1.5))
        if self.kind in ("walk", "period"):
            at = 3 + self.groups
            prior += float(log_half_normal(math.exp(min(p[at], 10)), 0.5)) + p[at] + float(log_normal(p[at + 1 :]).sum())
        return prior + float(self.pointwise(p).sum())


class TruncatedCounts:
    """Counts from 1 up: zero-truncated Poisson, or negative binomial with a dispersion parameter."""

    def __init__(self, values: np.ndarray, times: np.ndarray, negbin: bool) -> None:
        self.v, self.m, self.negbin = np.asarray(values, float), np.asarray(times, float), negbin
        self.names = ["log_mean", "log_phi"] if negbin else ["log_mean"]
        self.start = np.array([math.log(max((self.v * self.m).sum() / self.m.sum() - 0.5, 0.2)), 0.0][: len(self.names)])

    def __call__(self, p: np.ndarray) -> float:
        mu = math.exp(min(max(p[0], -15), 15))
        if self.negbin:
            phi = math.exp(min(max(p[1], -10), 10))
            zero = phi * math.log(phi / (phi + mu))
            ll = log_negbin(self.v, mu, phi)
            prior = float(log_normal(p[1], 0.0, 1.5))
        else:
            zero, ll, prior = -mu, log_poisson(self.v, mu), 0.0
        return prior + float(log_normal(p[0], 0.0, 2.0)) + float((self.m * (ll - math.log(max(-math.expm1(zero), 1e-300)))).sum())


class LogitTrend:
    """k of n by a covariate with normal priors on intercept and slope."""

    def __init__(self, x: np.ndarray, k: np.ndarray, n: np.ndarray, scale: float = 2.5) -> None:
        self.x, self.k, self.n, self.scale = np.asarray(x, float), np.asarray(k, float), np.asarray(n, float), scale
        self.names, self.start = ["intercept", "slope"], np.zeros(2)

    def __call__(self, p: np.ndarray) -> float:
        eta = np.clip(p[0] + p[1] * self.x, -30, 30)
        return float((self.k * eta - self.n * np.log1p(np.exp(eta))).sum() + log_normal(p, 0.0, self.scale).sum())


class TopicTrend:
    """Counts by year and topic: Dirichlet-multinomial shares whose logits against the last topic have a level, a trend per
    decade and a random walk, of which level and trend are projected out; and a dispersion."""

    def __init__(self, counts: np.ndarray, years: np.ndarray) -> None:
        self.counts, years = np.asarray(counts, float), np.asarray(years, float)
        self.t, self.k = self.counts.shape[0], self.counts.shape[1] - 1
        self.z = (years - years.mean()) / 10
        line = np.column_stack([np.ones(self.t), self.z])
        self.walk = (np.eye(self.t) - line @ np.linalg.pinv(line)) @ np.tril(np.ones((self.t, self.t)))
        k = range(self.k)
        self.names = [*(f"level_{i}" for i in k), *(f"trend_{i}" for i in k), *(f"log_sd_{i}" for i in k), *(f"w_{i}_{j}" for i in k for j in range(self.t)), "log_phi"]
        share = np.maximum(self.counts.sum(0) / self.counts.sum(), 1e-3)
        self.start = np.zeros(len(self.names))
        self.start[: self.k] = np.log(share[:-1] / share[-1])
        self.start[2 * self.k : 3 * self.k], self.start[-1] = math.log(0.25), math.log(40.0)

    def shares(self, p: np.ndarray) -> np.ndarray:
        """Shares by year and topic."""
        k = self.k
        w = p[3 * k : -1].reshape(k, self.t)
        eta = p[:k] + np.outer(self.z, p[k : 2 * k]) + (self.walk @ w.T) * np.exp(p[2 * k : 3 * k])
        eta = np.column_stack([eta, np.zeros(self.t)])
        e = np.exp(eta - eta.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def __call__(self, p: np.ndarray) -> float:
        k = self.k
        if abs(p[-1]) > 12 or (np.abs(p[2 * k : 3 * k]) > 6).any():
            return -math.inf
        a = math.exp(p[-1]) * np.maximum(self.shares(p), 1e-12)
        total, n = a.sum(1), self.counts.sum(1)
        ll = (_lgamma(total) - _lgamma(total + n)).sum() + (_lgamma(a + self.counts) - _lgamma(a)).sum()
        prior = log_normal(p[:k], 0.0, 2.0).sum() + log_normal(p[k : 2 * k], 0.0, 1.5).sum() + log_normal(p[2 * k : 3 * k], math.log(0.25), 0.75).sum()
        return float(ll + prior + log_normal(p[3 * k : -1]).sum() + log_normal(p[-1], math.log(40.0), 1.5))

    def blocks(self) -> list[list[int]]:
        """The three parameters of each topic, its walk by four years, the dispersion."""
        k, base = self.k, 3 * self.k
        own = [[i, k + i, 2 * k + i] for i in range(k)]
        walks = [list(range(base + i * self.t + j, base + i * self.t + min(j + 4, self.t))) for i in range(k) for j in range(0, self.t, 4)]
        return [*own, *walks, [len(self.names) - 1]]


class HyperWalk:
    """Log step and level deviations of a latent walk, by evidence interpolated between the points of a grid."""

    def __init__(self, steps: np.ndarray, levels: np.ndarray, evidence: np.ndarray) -> None:
        self.steps, self.levels, self.evidence = (np.asarray(v, float) for v in (steps, levels, evidence))
        self.names = ["log_step", "log_level"]
        best = np.unravel_index(np.argmax(self.evidence), self.evidence.shape)
        self.start = np.array([self.steps[best[0]], self.levels[best[1]]])

    def __call__(self, p: np.ndarray) -> float:
        if not (self.steps[0] <= p[0] <= self.steps[-1] and self.levels[0] <= p[1] <= self.levels[-1]):
            return -math.inf
        along = np.array([np.interp(p[0], self.steps, self.evidence[:, j]) for j in range(len(self.levels))])
        e = float(np.interp(p[1], self.levels, along))
        return e + float(log_half_normal(math.exp(p[0]), 1.0)) + p[0] + float(log_half_normal(math.exp(p[1]), 2.0)) + p[1]


def latent_walk_evidence(k: np.ndarray, n: np.ndarray, sd: float, level_sd: float = 2.0) -> tuple[float, np.ndarray, np.ndarray]:
    """(log evidence, mode, variances) of logit shares that follow a random walk with this step, by Laplace's method."""
    t = len(k)
    q = np.zeros((t, t))
    q[0, 0] = 1 / level_sd**2
    for i in range(1, t):
        q[i, i] += 1 / sd**2
        q[i - 1, i - 1] += 1 / sd**2
        q[i, i - 1] -= 1 / sd**2
        q[i - 1, i] -= 1 / sd**2
    f = np.zeros(t)
    for _ in range(100):
        p = 1 / (1 + np.exp(-f))
        h = q + np.diag(n * p * (1 - p))
        step = np.linalg.solve(h, k - n * p - q @ f)
        f = f + step
        if np.abs(step).max() < 1e-9:
            break
    p = 1 / (1 + np.exp(-f))
    h = q + np.diag(n * p * (1 - p))
    ll = (k * f - n * np.log1p(np.exp(f))).sum() - f @ q @ f / 2
    return float(ll + np.linalg.slogdet(q)[1] / 2 - np.linalg.slogdet(h)[1] / 2), f, np.diag(np.linalg.inv(h))


def change_points(spark: SparkSession, series: dict[str, np.ndarray], most: int = 2, shortest: int = 3, alpha: float = 1.0) -> DataFrame:
    """(series, k, first, second, log_evidence, posterior) of every segmentation of year-by-category counts.

    Segments have their own category probabilities under a Dirichlet prior, integrated exactly over prefix sums; all
    segmentations with 0 to `most` (2 at most) changes are enumerated, each number of changes and each place equally likely
    beforehand.
    """
    from tessera.functions.special import log_dirichlet_multinomial

    def one(counts: np.ndarray) -> list[tuple[int, int | None, int | None, float]]:
        t = len(counts)
        run = np.vstack([np.zeros(counts.shape[1]), np.cumsum(counts, 0)])
        prior = np.full(counts.shape[1], alpha)
        seg: dict[tuple[int, int], float] = {}

        def value(i: int, j: int) -> float:
            if (i, j) not in seg:
                seg[i, j] = log_dirichlet_multinomial(run[j] - run[i], prior)
            return seg[i, j]

        out = [(0, None, None, value(0, t))]
        if most >= 1:
            out += [(1, i, None, value(0, i) + value(i, t)) for i in range(shortest, t - shortest + 1)]
        if most >= 2:
            out += [(2, i, j, value(0, i) + value(i, j) + value(j, t)) for i in range(shortest, t - 2 * shortest + 1) for j in range(i + shortest, t - shortest + 1)]
        return out

    held = {n: np.asarray(c, float) for n, c in series.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["series"]:
                rows = one(held[name])
                sizes = {k: sum(1 for r in rows if r[0] == k) for k, *_ in rows}
                score = np.array([r[3] - math.log(sizes[r[0]]) for r in rows])
                post = np.exp(score - score.max())
                df = pd.DataFrame(rows, columns=["k", "first", "second", "log_evidence"])
                df.insert(0, "series", name)
                df["posterior"] = post / post.sum()
                yield df

    names = spark.createDataFrame([(n,) for n in held], "series string").repartition(max(1, len(held)))
    return names.mapInPandas(run, "series string, k int, first int, second int, log_evidence double, posterior double")


def log_evidence_is(spark: SparkSession, log_density: LogDensity, mean: np.ndarray, cov: np.ndarray, b: int = 4_000, df: float = 5.0, seed: int = 1) -> float:
    """Log marginal likelihood by importance sampling from a multivariate t around the posterior."""
    d = len(mean)
    root = np.linalg.cholesky(cov + 1e-9 * np.eye(d))
    const = math.lgamma((df + d) / 2) - math.lgamma(df / 2) - d / 2 * math.log(df * math.pi) - np.log(np.diag(root)).sum()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            out = []
            for i in ids["id"]:
                rng = np.random.default_rng([seed, int(i)])
                z = rng.standard_normal(d) / math.sqrt(rng.chisquare(df) / df)
                out.append(log_density(mean + root @ z) - (const - (df + d) / 2 * math.log1p(z @ z / df)))
            yield pd.DataFrame({"w": out})

    w = spark.range(b).mapInPandas(run, "w double").where("w > -1e300")
    top = w.agg(F.max("w")).first()[0]
    return float(top + math.log(w.agg(F.sum(F.exp(F.col("w") - top))).first()[0] / b))


def shrinkage(panel: DataFrame, post: DataFrame, grand: float) -> DataFrame:
    """(group, raw, post, shrink): how far posterior rates moved to the grand rate, in per cent; NULL where undefined."""
    raw = F.try_divide(F.col("y"), F.col("x"))
    both = panel.join(post, "group").select("group", raw.alias("raw"), "post")
    far = F.abs(F.log(F.col("raw") / grand)) > 0.05
    return both.withColumn("shrink", F.when((F.col("raw") > 0) & far, 100 * (1 - F.log(F.col("post") / grand) / F.log(F.col("raw") / grand))))


def log_likelihood(draws: DataFrame, model: HierarchicalRates) -> DataFrame:
    """(draw, obs, ll) of a model's draws; one group per draw of a chain."""
    names = model.names

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.set_index("param")["value"].reindex(names).to_numpy()
        ll = model.pointwise(p)
        return pd.DataFrame({"draw": int(pdf["chain"].iloc[0]) * 1_000_000 + int(pdf["draw"].iloc[0]), "obs": np.arange(len(ll)), "ll": ll})

    return draws.groupBy("chain", "draw").applyInPandas(run, "draw bigint, obs bigint, ll double")


def wide_draws(draws: DataFrame, names: Sequence[str]) -> DataFrame:
    """(chain, draw, names): one column per parameter."""
    return draws.groupBy("chain", "draw").pivot("param", list(names)).agg(F.first("value"))


def exceedance(column: Column) -> Column:
    """Posterior probability of a statement about the draws."""
    return F.avg(column.cast("int"))
