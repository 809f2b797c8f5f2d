"""Queries of the posterior toolkit: diagnostics over deterministic draws are checked by SQL, models by tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.special import log_negbin, log_poisson
from tessera.operators import bayes as B
from tessera.operators import regression as M
from tessera.operators.contingency import counted, interval
from tessera.plans.registry import Registry
from tessera.plans.relational_queries import _SIZES, firm_sizes, r6, rate_base, yearly
from tessera.plans.text_queries import E
from tessera.session import materialize, table
from tessera.sources.events import events

REGISTRY = Registry()
Q = REGISTRY.query

# draws made of all events of the stream: two parameters, four chains, in the order of the ids
_D = """WITH d AS (SELECT CAST(event_id % 2 AS VARCHAR) AS param, CAST(event_id // 2 % 4 AS INTEGER) AS chain, CAST(event_id // 8 AS INTEGER) AS draw, value FROM events)"""


def hashed_draws(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", ["event_id", "value"])
    return e.select((F.col("event_id") % 2).cast("string").alias("param"), F.expr("event_id DIV 2 % 4").cast("int").alias("chain"), F.expr("event_id DIV 8").cast("int").alias("draw"), "value")


@Q("mc3_rhat", f"""{_D}, h AS (SELECT *, floor(count(*) OVER (PARTITION BY param, chain) / 2) AS h FROM d), g AS (SELECT param, chain, floor(draw / h) AS part, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM h WHERE floor(draw / h) < 2 GROUP BY ALL),
 s AS (SELECT param, avg(v) AS w, var_samp(m) AS b, max(n) AS n FROM g GROUP BY 1) SELECT param, round(sqrt(((n - 1) / n * w + b) / w), 6) AS rhat FROM s""")
def mc3(spark: SparkSession, d: str) -> DataFrame:
    return B.rhat(hashed_draws(spark, d)).select("param", r6("rhat", "rhat"))


@Q("mc4_ess", f"""{_D}, s AS (SELECT param, chain, count(*) AS n FROM d GROUP BY ALL), c AS (SELECT param, chain, draw, value - avg(value) OVER (PARTITION BY param, chain) AS a FROM d), g AS (SELECT param, count(DISTINCT chain) AS m, min(n) AS n FROM s GROUP BY 1),
 v AS (SELECT x.param, y.draw - x.draw AS lag, sum(x.a * y.a) AS s FROM c x JOIN c y ON x.param = y.param AND x.chain = y.chain AND y.draw >= x.draw AND y.draw - x.draw <= 60 GROUP BY ALL), r AS (SELECT param, lag, s / first_value(s) OVER (PARTITION BY param ORDER BY lag) AS rho FROM v),
 p AS (SELECT a.param, a.lag, a.rho + b.rho AS s FROM r a JOIN r b ON a.param = b.param AND b.lag = a.lag + 1 WHERE a.lag % 2 = 1), e AS (SELECT param, min(lag) AS stop FROM p WHERE s <= 0 GROUP BY 1) SELECT g.param, round(least(m * n / (1 + 2 * coalesce((SELECT sum(s) FROM p WHERE p.param = g.param AND lag < stop), 0)), m * n), 4) AS ess FROM g JOIN e USING (param)""")
def mc4(spark: SparkSession, d: str) -> DataFrame:
    """Effective draws of each parameter. The SQL beside it looks 60 lags far, beyond which these series are never read."""
    return B.ess(hashed_draws(spark, d)).select("param", F.round("ess", 4).alias("ess"))


@Q("mc5_hdi", f"""{_D}, r AS (SELECT param, value, row_number() OVER w AS i, greatest(floor(0.94 * count(*) OVER (PARTITION BY param)), 1) AS k FROM d WINDOW w AS (PARTITION BY param ORDER BY value)), s AS (SELECT a.param, a.value AS lo, b.value AS hi, a.i FROM r a JOIN r b ON a.param = b.param AND b.i = a.i + a.k)
 SELECT param, round(lo, 6) AS lo, round(hi, 6) AS hi FROM s QUALIFY row_number() OVER (PARTITION BY param ORDER BY hi - lo, i) = 1""")
def mc5(spark: SparkSession, d: str) -> DataFrame:
    return B.hdi(hashed_draws(spark, d)).select("param", r6("lo", "lo"), r6("hi", "hi"))


_LL = "WITH l AS (SELECT event_id // 50 AS draw, event_id % 50 AS obs, -1 - abs(value) / 100 AS ll FROM events)"


def hashed_ll(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", ["event_id", "value"])
    return e.select(F.expr("event_id DIV 50").alias("draw"), (F.col("event_id") % 50).alias("obs"), (-1 - F.abs("value") / 100).alias("ll"))


@Q("mc8_waic", f"{_LL}, o AS (SELECT obs, max(ll) + ln(avg(exp(ll - m))) - var_samp(ll) AS e, var_samp(ll) AS p FROM (SELECT *, max(ll) OVER (PARTITION BY obs) AS m FROM l) GROUP BY obs) SELECT round(sum(e), 6) AS elpd, round(sum(p), 6) AS p, round(-2 * sum(e), 6) AS waic, round(sqrt(count(*) * var_samp(e)), 6) AS se FROM o")
def mc8(spark: SparkSession, d: str) -> DataFrame:
    return B.waic(hashed_ll(spark, d)).select(*[r6(c, c) for c in ("elpd", "p", "waic", "se")])


@Q("mc10_compare", f"{_LL}, o AS (SELECT obs, max(ll) + ln(avg(exp(ll - m))) - var_samp(ll) AS e FROM (SELECT *, max(ll) OVER (PARTITION BY obs) AS m FROM l) GROUP BY obs), x AS (SELECT 'a' AS model, obs, e FROM o UNION ALL SELECT 'b', obs, e - 0.01 * (obs % 7) FROM o), r AS (SELECT obs, e AS b FROM x WHERE model = 'a') SELECT model, round(sum(e), 6) AS elpd, round(sum(e - b), 6) AS diff, round(sqrt(count(*) * var_samp(e - b)), 6) AS se FROM x JOIN r USING (obs) GROUP BY 1")
def mc10(spark: SparkSession, d: str) -> DataFrame:
    a = materialize(B.pointwise(hashed_ll(spark, d)).select("obs", "elpd"), "pointwise")
    b = a.withColumn("elpd", F.col("elpd") - 0.01 * (F.col("obs") % 7))
    return B.compare({"a": a, "b": b}).select("model", *[r6(c, c) for c in ("elpd", "diff", "se")])


def panel(spark: SparkSession, d: str) -> tuple[list[str], dict[str, np.ndarray]]:
    """Counts and exposure by country and year, of all countries with exposure."""
    rows = M.cells(rate_base(spark, d).where("value > 0").select("country", "year", F.col("events").alias("y"), (F.col("value") / 1e9).alias("x")).orderBy("country", "year"))
    times, names = sorted({r["year"] for r in rows}), sorted({r["country"] for r in rows})
    return names, {
        "y": np.array([float(r["y"]) for r in rows]), "exposure": np.array([r["x"] for r in rows]),
        "group": np.array([names.index(r["country"]) for r in rows]), "time": np.array([times.index(r["year"]) for r in rows]),
    }


QUICK = {"tune": 500, "draws": 400, "chains": 4}  # quick draws; the `converged` column says whether they suffice


def model_draws(spark: SparkSession, d: str, kind: str) -> tuple[DataFrame, B.HierarchicalRates, list[str]]:
    names, data = panel(spark, d)
    model = B.HierarchicalRates(kind, **data)
    return materialize(B.sample(spark, model, model.names, model.start, blocks=model.blocks(), **QUICK), "draws"), model, names


@Q("mc1_mc7_posterior_summary")
def mc7(spark: SparkSession, d: str) -> DataFrame:
    """Pooled rates by the plain chain (MC-1), with diagnostics (MC-3 to MC-5, MC-7)."""
    return B.summary(model_draws(spark, d, "pooled")[0])


@Q("mc2_mc15_hierarchical_rates")
def mc15(spark: SparkSession, d: str) -> DataFrame:
    """The negative binomial model with group effects, by blocked chains."""
    return B.summary(model_draws(spark, d, "negbin")[0])


@Q("mc15_walk_and_period")
def mc15b(spark: SparkSession, d: str) -> DataFrame:
    parts = [B.summary(model_draws(spark, d, k)[0]).withColumn("model", F.lit(k)) for k in ("walk", "period")]
    return parts[0].unionByName(parts[1])


@Q("mc9_mc10_model_ranking")
def mc9(spark: SparkSession, d: str) -> DataFrame:
    """Models by leave-one-out densities."""
    tables = {}
    for kind in ("pooled", "poisson", "negbin"):
        draws, model, _ = model_draws(spark, d, kind)
        tables[kind] = materialize(B.loo(B.log_likelihood(draws, model)), "loo")
    return B.compare(tables)


@Q("mc16_retuned_fit")
def mc16(spark: SparkSession, d: str) -> DataFrame:
    """A fit that is repeated with more tuning until it has converged."""
    rows = [r for r in M.cells(yearly(spark, d).orderBy("year")) if r["n"]]
    model = B.LogitTrend([(r["year"] - 2000) / 10 for r in rows], [r["k"] for r in rows], [r["n"] for r in rows])
    draws, done = B.fit(spark, model, model.names, model.start, attempts=2, tune=1_000, draws=1_500)
    return B.summary(draws).withColumn("accepted", F.lit(done))


@Q("mc17_shrinkage")
def mc17(spark: SparkSession, d: str) -> DataFrame:
    """Raw and posterior rate of each country with its interval, how far it moved to the grand rate, and its ratio to the mean
    country with the probability that it lies below."""
    draws, model, names = model_draws(spark, d, "negbin")
    sums = [(n, float(model.y[model.g == i].sum()), float(np.exp(model.x)[model.g == i].sum())) for i, n in enumerate(names)]
    mean = draws.where("param = 'mean'").select("chain", "draw", F.col("value").alias("m"))
    ids = spark.createDataFrame([(f"group_{i}", n) for i, n in enumerate(names)], "param string, group string")
    g = draws.where("param LIKE 'group_%'").join(mean, ["chain", "draw"]).join(F.broadcast(ids), "param").select("group", F.exp(F.col("value") + F.col("m")).alias("value"), F.exp("value").alias("ratio"))
    post = g.groupBy("group").agg(F.avg("value").alias("post"), F.avg("ratio").alias("ratio"), B.exceedance(F.col("ratio") < 1).alias("p_below"))
    grand = sum(s[1] for s in sums) / sum(s[2] for s in sums)
    table_ = B.shrinkage(spark.createDataFrame(sums, "group string, y double, x double"), post.select("group", "post"), grand)
    return table_.join(B.hdi(g, by=["group"]), "group").join(post.select("group", "ratio", "p_below"), "group")


def replicated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(chain, draw, stat, value) of tables drawn under every posterior draw, and (stat, observed) of the data: seven statistics
    and the total of each country."""
    draws, model, countries = model_draws(spark, d, "negbin")
    names = model.names

    def stats(v: np.ndarray) -> dict[str, float]:
        by = np.bincount(model.g, weights=v, minlength=model.groups)
        largest = int(np.bincount(model.g, weights=model.y, minlength=model.groups).argmax())
        out = {
            "total": v.sum(), "share_zero_cells": (v == 0).mean(), "max_cell": v.max(), "variance_by_mean": v.var(ddof=1) / max(v.mean(), 1e-12),
            "countries_with_events": (by > 0).sum(), "largest_country": by[largest], "share_of_the_first": by.max() / max(by.sum(), 1e-12),
        }
        return {k: float(x) for k, x in out.items()} | {f"country: {c}": float(x) for c, x in zip(countries, by)}

    def run(pdf):
        import pandas as pd

        p = pdf.set_index("param")["value"].reindex(names).to_numpy()
        chain, draw = int(pdf["chain"].iloc[0]), int(pdf["draw"].iloc[0])
        rng = np.random.default_rng([chain, draw])
        mu, phi = np.exp(np.clip(model.log_rate(p) + model.x, -30, 30)), math.exp(p[2 + model.groups])
        got = stats(rng.poisson(rng.gamma(phi, mu / phi)).astype(float))
        return pd.DataFrame({"chain": chain, "draw": draw, "stat": list(got), "value": list(got.values())})

    reps = materialize(draws.groupBy("chain", "draw").applyInPandas(run, "chain int, draw int, stat string, value double"), "reps")
    return reps, spark.createDataFrame(list(stats(model.y).items()), "stat string, observed double")


def checked(reps: DataFrame, seen: DataFrame) -> DataFrame:
    both = reps.join(F.broadcast(seen), "stat")  # seven statistics and one per country
    out = both.groupBy("stat", "observed").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), B.exceedance(F.col("value") >= F.col("observed")).alias("p"))
    return out.join(B.hdi(reps, by=["stat"]), "stat").withColumn("inside", F.col("observed").between(F.col("lo"), F.col("hi")))


@Q("mc18_predictive_checks")
def mc18(spark: SparkSession, d: str) -> DataFrame:
    """Seven statistics of replicated tables against the data."""
    reps, seen = replicated(spark, d)
    return checked(reps.where("NOT startswith(stat, 'country: ')"), seen)


@Q("mc18_country_coverage")
def mc18b(spark: SparkSession, d: str) -> DataFrame:
    """The total of each country against its replicates, and the share of countries inside their intervals."""
    reps, seen = replicated(spark, d)
    each = checked(reps.where("startswith(stat, 'country: ')"), seen).withColumn("country", F.expr("substring(stat, 10)")).drop("stat")
    share = each.agg(F.avg(F.col("inside").cast("int")).alias("coverage"))
    return each.join(F.broadcast(share)).select("country", "observed", "mean", "lo", "hi", "inside", "coverage")  # one row


@Q("fig9_predictive_histogram")
def fig9(spark: SparkSession, d: str) -> DataFrame:
    """Replicates of three statistics in 26 bins between their extremes."""
    reps, _ = replicated(spark, d)
    reps = reps.where(F.col("stat").isin("share_zero_cells", "variance_by_mean", "max_cell"))
    ends = reps.groupBy("stat").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo")) / 26, F.lit(1e-12))
    binned = reps.join(F.broadcast(ends), "stat").withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(25)).cast("int"))
    return binned.groupBy("stat", "bin").agg(F.min(F.col("lo") + F.col("bin") * width).alias("left"), F.count("*").alias("n"))


@Q("mc11_latent_walk")
def mc11(spark: SparkSession, d: str) -> DataFrame:
    """A share that drifts by year: evidence over a grid of step sizes, each point in a task, and the mixed estimate."""
    import pandas as pd

    rows = M.cells(yearly(spark, d).orderBy("year"))
    k, n = np.array([float(r["k"]) for r in rows]), np.array([float(r["n"]) for r in rows])
    grid = np.exp(np.linspace(math.log(0.02), math.log(1.5), 60))

    def run(batches):
        for b in batches:
            for i in b["id"]:
                e, f, v = B.latent_walk_evidence(k, n, float(grid[i]))
                yield pd.DataFrame({"i": int(i), "sd": float(grid[i]), "evidence": e, "t": np.arange(len(f)), "f": f, "v": v})

    at = spark.range(len(grid)).mapInPandas(run, "i int, sd double, evidence double, t int, f double, v double")
    at = materialize(at, "grid").withColumn("prior", -F.col("sd") * F.col("sd") / 2 + F.log("sd"))
    w = Window.partitionBy(F.lit(1))
    at = at.withColumn("w", F.exp(F.col("evidence") + F.col("prior") - F.max(F.col("evidence") + F.col("prior")).over(w)))
    m = at.groupBy("t").agg((F.sum(F.col("w") * F.col("f")) / F.sum("w")).alias("m"), (F.sum(F.col("w") * (F.col("v") + F.col("f") * F.col("f"))) / F.sum("w")).alias("q"))
    years = spark.createDataFrame([(i, r["year"]) for i, r in enumerate(rows)], "t int, year int")
    s = lambda c: 1 / (1 + F.exp(-c))
    sd = F.sqrt(F.col("q") - F.col("m") * F.col("m"))
    return m.join(years, "t").select("year", s(F.col("m")).alias("share"), s(F.col("m") - 1.88 * sd).alias("lo"), s(F.col("m") + 1.88 * sd).alias("hi"))


def hyper_walk(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list]:
    """Draws of the step and level deviations of the drifting share, the Laplace fits on their grid, and the years."""
    import pandas as pd

    rows = M.cells(yearly(spark, d).orderBy("year"))
    k, n = np.array([float(r["k"]) for r in rows]), np.array([float(r["n"]) for r in rows])
    steps, levels = np.linspace(math.log(0.02), math.log(1.5), 30), np.linspace(math.log(0.3), math.log(5.0), 8)

    def run(batches):
        for b in batches:
            for i in b["id"]:
                e, f, v = B.latent_walk_evidence(k, n, float(np.exp(steps[i // 8])), float(np.exp(levels[i % 8])))
                yield pd.DataFrame({"i": int(i), "evidence": e, "t": np.arange(len(f)), "f": f, "v": v})

    fits = materialize(spark.range(240).mapInPandas(run, "i int, evidence double, t int, f double, v double"), "grid")
    evidence = np.zeros(240)
    for r in fits.where("t = 0").select("i", "evidence").collect():  # the 240 points of the grid
        evidence[r["i"]] = r["evidence"]
    model = B.HyperWalk(steps, levels, evidence.reshape(30, 8))
    draws = materialize(B.sample(spark, model, model.names, model.start, tune=1_000, draws=1_500), "draws")
    return draws, fits, [r["year"] for r in rows]


@Q("mc11_walk_hyperparameters")
def mc11b(spark: SparkSession, d: str) -> DataFrame:
    """Chains over the deviations of step and level."""
    return B.summary(hyper_walk(spark, d)[0])


@Q("mc11_walk_by_chain")
def mc11c(spark: SparkSession, d: str) -> DataFrame:
    """The share by year, Laplace fits mixed as often as the chains visit their grid points."""
    draws, fits, years = hyper_walk(spark, d)
    near = lambda c, lo, hi, n: F.round((F.col(c) - lo) / (hi - lo) * (n - 1)).cast("int")
    visits = B.wide_draws(draws, ["log_step", "log_level"]).select((near("log_step", math.log(0.02), math.log(1.5), 30) * 8 + near("log_level", math.log(0.3), math.log(5.0), 8)).alias("i"))
    w = visits.groupBy("i").agg(F.count("*").alias("w"))
    m = fits.join(w, "i").groupBy("t").agg((F.sum(F.col("w") * F.col("f")) / F.sum("w")).alias("m"), (F.sum(F.col("w") * (F.col("v") + F.col("f") * F.col("f"))) / F.sum("w")).alias("q"))
    named = spark.createDataFrame(list(enumerate(years)), "t int, year int")
    s, sd = lambda c: 1 / (1 + F.exp(-c)), F.sqrt(F.col("q") - F.col("m") * F.col("m"))
    return m.join(named, "t").select("year", s(F.col("m")).alias("share"), s(F.col("m") - 1.88 * sd).alias("lo"), s(F.col("m") + 1.88 * sd).alias("hi"))


@Q("mc6_weighted_summary", f"""{_SIZES}, w AS (SELECT x, count(*) / sum(count(*)) OVER () AS p FROM z GROUP BY x), c AS (SELECT x, p, sum(p) OVER (ORDER BY x) AS c FROM w), s AS (SELECT a.x AS lo, min(b.x) AS hi FROM c a JOIN c b ON b.c >= a.c - a.p + 0.94 - 1e-12 GROUP BY a.x),
 m AS (SELECT sum(x * p) AS mean FROM w), i AS (SELECT lo, hi FROM s ORDER BY hi - lo, lo LIMIT 1) SELECT round(mean, 6) AS mean, round(sqrt((SELECT sum((x - mean) * (x - mean) * p) FROM w)), 6) AS sd, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM m, i""")
def mc6(spark: SparkSession, d: str) -> DataFrame:
    z = firm_sizes(spark, d).groupBy("x").agg(F.count("*").cast("double").alias("m"))
    return B.weighted_summary(z, "x", "m").select(r6("mean", "mean"), r6("sd", "sd"), "lo", "hi")


@Q("mc12_derived_quantities", f"{_D}, w AS (SELECT chain, draw, max(value) FILTER (WHERE param = '0') AS a, max(value) FILTER (WHERE param = '1') AS b FROM d GROUP BY ALL) SELECT round(avg(a - b), 6) AS gap, round(corr(a, b), 6) AS correlation, round(avg(CAST(a > b AS INTEGER)), 6) AS exceeds FROM w")
def mc12(spark: SparkSession, d: str) -> DataFrame:
    w = B.wide_draws(hashed_draws(spark, d), ["0", "1"]).select(F.col("0").alias("a"), F.col("1").alias("b"))
    return w.agg(r6(F.avg(F.col("a") - F.col("b")), "gap"), r6(F.corr("a", "b"), "correlation"), r6(B.exceedance(F.col("a") > F.col("b")), "exceeds"))


@Q("mc13_bayesian_logit")
def mc13(spark: SparkSession, d: str) -> DataFrame:
    rows = [r for r in M.cells(yearly(spark, d).orderBy("year")) if r["n"]]
    model = B.LogitTrend([(r["year"] - 2000) / 10 for r in rows], [r["k"] for r in rows], [r["n"] for r in rows])
    return B.summary(materialize(B.sample(spark, model, model.names, model.start, tune=800, draws=800), "draws"))


def sizes_array(spark: SparkSession, d: str) -> tuple[np.ndarray, np.ndarray]:
    rows = M.cells(firm_sizes(spark, d).groupBy("x").agg(F.count("*").alias("m")).orderBy("x"))
    return np.array([r["x"] for r in rows], float), np.array([r["m"] for r in rows], float)


@Q("mc14_truncated_counts")
def mc14(spark: SparkSession, d: str) -> DataFrame:
    """Events per firm: zero-truncated Poisson against negative binomial, each with its posterior."""
    v, m = sizes_array(spark, d)
    parts = []
    for kind in (False, True):
        model = B.TruncatedCounts(v, m, kind)
        s = B.summary(materialize(B.sample(spark, model, model.names, model.start, tune=600, draws=600), "draws"))
        parts.append(s.withColumn("model", F.lit("negbin" if kind else "poisson")))
    return parts[0].unionByName(parts[1])


@Q("mc14_tail_check")
def mc14b(spark: SparkSession, d: str) -> DataFrame:
    """Firms with 2, 3, 5 and 7 events or more, replicated under every posterior draw of either model, against the data.

    Of n firms the number beyond a size is binomial with the tail's probability, so no firm is drawn by itself.
    """
    import pandas as pd

    v, m = sizes_array(spark, d)
    firms, sizes, parts = int(m.sum()), (2, 3, 5, 7), []

    def tails(kind: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            p = dict(zip(pdf["param"], pdf["value"]))
            mu, x = math.exp(p["log_mean"]), np.arange(7.0)
            mass = np.exp(log_negbin(x, mu, math.exp(p["log_phi"])) if kind == "negbin" else log_poisson(x, mu))
            rng = np.random.default_rng([int(pdf["chain"].iloc[0]), int(pdf["draw"].iloc[0])])
            tail = [max(0.0, 1 - mass[:s].sum()) / (1 - mass[0]) for s in sizes]
            return pd.DataFrame({"model": kind, "at_least": sizes, "value": [float(rng.binomial(firms, min(t, 1.0))) for t in tail]})

        return run

    for kind in ("poisson", "negbin"):
        model = B.TruncatedCounts(v, m, kind == "negbin")
        draws = materialize(B.sample(spark, model, model.names, model.start, tune=600, draws=600), "draws")
        parts.append(draws.groupBy("chain", "draw").applyInPandas(tails(kind), "model string, at_least int, value double"))
    seen = spark.createDataFrame([(s, float(m[v >= s].sum())) for s in sizes], "at_least int, observed double")
    reps = materialize(parts[0].unionByName(parts[1]), "reps").join(F.broadcast(seen), "at_least")  # four rows
    out = reps.groupBy("model", "at_least", "observed").agg(F.avg("value").alias("mean"), *interval("value"), B.exceedance(F.col("value") >= F.col("observed")).alias("p"))
    return out


def year_matrix(spark: SparkSession, d: str, column: str) -> tuple[list[int], np.ndarray]:
    rows = M.cells(counted(events(spark, d, "year", column).withColumn(column, F.col(column).cast("string")), "year", column))
    years, levels = sorted({r["year"] for r in rows}), sorted({r[column] for r in rows})
    out = np.zeros((len(years), len(levels)))
    for r in rows:
        out[years.index(r["year"]), levels.index(r[column])] = r["o"]
    return years, out


def _segments_sql(most: int) -> str:
    """Tables up to r (series, k, first, second, evidence, score) of all segmentations of both series."""
    per = " UNION ALL ".join(f"SELECT '{c}' AS series, year, CAST({c} AS VARCHAR) AS level FROM e WHERE year IS NOT NULL AND {c} IS NOT NULL" for c in ("hazard_category", "sales_channel"))
    two = """ UNION ALL SELECT a.series, 2, a.j, b.j, a.v + b.v + c.v FROM v a JOIN v b ON b.series = a.series AND b.i = a.j JOIN v c ON c.series = a.series AND c.i = b.j JOIN t ON t.series = a.series
 WHERE a.i = 0 AND c.j = t.t AND a.j >= 3 AND b.j - a.j >= 3 AND t.t - b.j >= 3""" if most > 1 else ""  # fmt: skip
    return f"""{E}, s AS ({per}), o AS (SELECT series, level, year, count(*) AS o FROM s GROUP BY ALL), y AS (SELECT series, year, row_number() OVER (PARTITION BY series ORDER BY year) - 1 AS i FROM (SELECT DISTINCT series, year FROM o)),
 t AS (SELECT series, count(*) AS t FROM y GROUP BY 1), l AS (SELECT DISTINCT series, level FROM o), g AS (SELECT l.series, l.level, y.i, coalesce(o, 0) AS o FROM l JOIN y USING (series) LEFT JOIN o ON o.series = l.series AND o.level = l.level AND o.year = y.year),
 cu AS (SELECT series, level, i + 1 AS i, sum(o) OVER (PARTITION BY series, level ORDER BY i) AS c FROM g UNION ALL SELECT series, level, 0, 0 FROM l),
 v AS (SELECT series, i, j, lgamma(count(*)) - lgamma(count(*) + sum(n)) + sum(lgamma(1 + n)) AS v FROM (SELECT a.series, a.i, b.i AS j, b.c - a.c AS n FROM cu a JOIN cu b ON a.series = b.series AND a.level = b.level AND b.i > a.i) GROUP BY ALL),
 q AS (SELECT v.series, 0 AS k, CAST(NULL AS BIGINT) AS first, CAST(NULL AS BIGINT) AS second, v AS e FROM v JOIN t USING (series) WHERE i = 0 AND j = t UNION ALL
 SELECT a.series, 1, a.j, NULL, a.v + b.v FROM v a JOIN v b ON b.series = a.series AND b.i = a.j JOIN t ON t.series = a.series WHERE a.i = 0 AND b.j = t.t AND a.j >= 3 AND t.t - a.j >= 3{two}),
 r AS (SELECT *, e - ln(count(*) OVER (PARTITION BY series, k)) AS score FROM q), x AS (SELECT *, exp(score - max(score) OVER (PARTITION BY series)) AS u FROM r), w AS (SELECT *, u / sum(u) OVER (PARTITION BY series) AS posterior FROM x)"""


@Q("mc19_change_points", f"{_segments_sql(2)}, b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY posterior DESC, k, first, second) AS rank FROM w QUALIFY rank <= 10) SELECT b.series, rank, k, f.year AS first_year, s.year AS second_year, round(posterior, 6) AS posterior FROM b LEFT JOIN y f ON f.series = b.series AND f.i = first LEFT JOIN y s ON s.series = b.series AND s.i = second")
def mc19(spark: SparkSession, d: str) -> DataFrame:
    """The ten likeliest segmentations of two series."""
    series, years = {}, {}
    for c in ("hazard_category", "sales_channel"):
        years[c], series[c] = year_matrix(spark, d, c)
    got = materialize(B.change_points(spark, series), "changes")
    w = Window.partitionBy("series").orderBy(F.desc("posterior"), "k", "first", "second")
    best = got.withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    spans = spark.createDataFrame([(c, i, y) for c, ys in years.items() for i, y in enumerate(ys)], "series string, i int, year int")
    at = lambda c, n: spans.select("series", F.col("i").alias(c), F.col("year").alias(n))
    return best.join(at("first", "first_year"), ["series", "first"], "left").join(at("second", "second_year"), ["series", "second"], "left").select("series", "rank", "k", "first_year", "second_year", r6("posterior", "posterior"))


@Q("mc20_bayes_factor")
def mc20(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a trend in a share against a constant share."""
    rows = [r for r in M.cells(yearly(spark, d).orderBy("year")) if r["n"]]
    x, k, n = ((r["year"] - 2000) / 10 for r in rows), [r["k"] for r in rows], [r["n"] for r in rows]
    trend = B.LogitTrend(list(x), k, n)
    flat = B.LogitTrend(np.zeros(len(rows)), k, n)
    design = np.column_stack([np.ones(len(rows)), trend.x])
    fit = M.logistic(design, trend.k, trend.n, ridge=0.16)
    none = M.logistic(design[:, :1], trend.k, trend.n, ridge=0.16)
    with_trend = B.log_evidence_is(spark, trend, fit.beta, fit.cov, 2_000)
    # without a trend the slope keeps its prior, which integrates to one
    without = B.log_evidence_is(spark, flat, np.array([none.beta[0], 0.0]), np.diag([float(none.cov[0, 0]), 6.25]), 2_000)
    return spark.createDataFrame([(with_trend, without, with_trend - without)], "trend double, constant double, log_bayes_factor double")


@Q("mc21_coincidence", f"{_segments_sql(1)}, p AS (SELECT series, first, posterior / sum(posterior) OVER (PARTITION BY series) AS p FROM w WHERE k = 1) SELECT round(sum(a.p * b.p), 6) AS within_two_years FROM p a JOIN p b ON a.series = 'hazard_category' AND b.series = 'sales_channel' AND abs(a.first - b.first) <= 2")
def mc21(spark: SparkSession, d: str) -> DataFrame:
    """Probability that the single changes of two series lie within two years, from their posteriors."""
    series = {c: year_matrix(spark, d, c)[1] for c in ("hazard_category", "sales_channel")}
    one = materialize(B.change_points(spark, series, most=1), "changes").where("k = 1")
    p = one.withColumn("p", F.col("posterior") / F.sum("posterior").over(Window.partitionBy("series")))
    a, b = (p.where(F.col("series") == s).select(F.col("first").alias(f"t{i}"), F.col("p").alias(f"p{i}")) for i, s in enumerate(series))
    near = a.join(F.broadcast(b), F.abs(F.col("t0") - F.col("t1")) <= 2)  # a few dozen years
    return near.agg(r6(F.sum(F.col("p0") * F.col("p1")), "within_two_years"))


def group_trend(spark: SparkSession, d: str) -> tuple[DataFrame, B.TopicTrend, list[int], list[str]]:
    """Draws of the drifting shares of the segments of garments; the reference is the last in order of size."""
    years, counts = year_matrix(spark, d, "archetype")
    names = sorted({r["archetype"] for r in M.cells(counted(events(spark, d, "archetype"), "archetype"))})
    order = sorted(range(len(names)), key=lambda i: (-counts[:, i].sum(), names[i]))
    # kinds of under a twentieth of all events are one kind, so that each share is told by the data
    few = [i for i in order if counts[:, i].sum() < 0.05 * counts.sum()]
    kept = [i for i in order if i not in few]
    x = np.column_stack([counts[:, kept], counts[:, few].sum(1)]) if few else counts[:, kept]
    model = B.TopicTrend(x, np.array(years))
    draws = materialize(B.sample(spark, model, model.names, model.start, chains=2, tune=250, draws=250, blocks=model.blocks()), "draws")
    return draws, model, years, [*(names[i] for i in kept), *(["others"] if few else [])]


@Q("mc22_topic_trend")
def mc22(spark: SparkSession, d: str) -> DataFrame:
    """Drifting shares of kinds of garments with their intervals: Dirichlet-multinomial counts over projected random walks."""
    import pandas as pd

    draws, model, years, names = group_trend(spark, d)
    order = model.names

    def run(pdf):
        p = pdf.set_index("param")["value"].reindex(order).to_numpy()
        shares = model.shares(p)
        return pd.DataFrame({"t": np.repeat(np.arange(len(years)), len(names)), "k": list(range(len(names))) * len(years), "share": shares.ravel()})

    each = draws.groupBy("chain", "draw").applyInPandas(run, "t int, k int, share double")
    curves = each.groupBy("t", "k").agg(F.avg("share").alias("share"), *interval("share", 0.94))
    n = model.counts.sum(1)
    seen = [(t, k, int(y), a, float(model.counts[t, k] / n[t]), int(n[t])) for t, y in enumerate(years) for k, a in enumerate(names)]
    return curves.join(spark.createDataFrame(seen, "t int, k int, year int, kind string, observed double, n int"), ["t", "k"]).drop("t", "k")


@Q("mc22_trend_parameters")
def mc22b(spark: SparkSession, d: str) -> DataFrame:
    """Levels, trends per decade, deviations and dispersion, with the probability that each is positive."""
    draws, *_ = group_trend(spark, d)
    own = materialize(draws.where("NOT startswith(param, 'w_')"), "own")
    return B.summary(own).join(own.groupBy("param").agg(B.exceedance(F.col("value") > 0).alias("p_positive")), "param")
