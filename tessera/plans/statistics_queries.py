"""Queries of contingency statistics, distribution functions and regressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import contingency as C
from tessera.operators import regression as M
from tessera.operators.shares import gini
from tessera.plans.registry import Registry
from tessera.plans.relational_queries import _CT, _SIZES, _YEARLY, _RATE, firm_sizes, r6, rate_base, yearly
from tessera.plans.text_queries import _PERIOD, EDGES, E
from tessera.functions.text import period_of
from tessera.session import materialize, table
from tessera.sources.events import events

REGISTRY = Registry()
Q = REGISTRY.query
COLS = ["hazard_category", "sales_channel"]


def _phi_sql(z: str) -> str:
    """Upper tail of the normal distribution, by Simpson's rule over 800 steps of its density from 0."""
    h = f"(least({z}, 12.0) / 800)"
    return f"(0.5 - {h} / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 801), lambda i: CASE WHEN i = 0 OR i = 800 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(i * {h}) * (i * {h}) / 2))))"


def _chi2_sf_sql(x: str, df: str) -> str:
    """Upper tail of the chi-squared distribution, by the series of the incomplete gamma function."""
    a = f"({df} / 2.0)"
    return f"(CASE WHEN {x} <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 600), lambda i: exp(-{x} / 2.0 + ({a} + i) * ln({x} / 2.0) - lgamma({a} + i + 1)))) END)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return C.counted(events(spark, d, *COLS), *COLS)


@Q("ct1_ct2_association", f"{E}, {_CT} SELECT max(t) AS n, (count(DISTINCT hazard_category) - 1) * (count(DISTINCT sales_channel) - 1) AS df, round(sum(n * n / (r * c / t)) - max(t), 6) AS chi2, round(2 * sum(n * ln(n / (r * c / t))), 6) AS g, round(sqrt((sum(n * n / (r * c / t)) - max(t)) / (max(t) * (least(count(DISTINCT hazard_category), count(DISTINCT sales_channel)) - 1))), 6) AS v FROM t")
def ct1(spark: SparkSession, d: str) -> DataFrame:
    a = C.association(cells(spark, d), *COLS)
    return a.select("n", "df", r6("chi2", "chi2"), r6("g", "g"), r6("v", "v"))


@Q("ct1_association_p", f"""{E}, n AS (SELECT period, hazard_category AS h, sales_channel AS c, count(*) AS o FROM e WHERE period IS NOT NULL AND hazard_category IS NOT NULL AND sales_channel IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY period, h) AS r, sum(o) OVER (PARTITION BY period, c) AS k, sum(o) OVER (PARTITION BY period) AS n FROM n),
 a AS (SELECT period, max(n) AS n, (count(DISTINCT h) - 1) * (count(DISTINCT c) - 1) AS df, sum(o * o / (r * k / n)) - max(n) AS chi2, 2 * sum(o * ln(o / (r * k / n))) AS g, least(count(DISTINCT h), count(DISTINCT c)) - 1 AS d FROM m GROUP BY 1)
 SELECT period, n, df, round(chi2, 6) AS chi2, round(g, 6) AS g, round(sqrt(chi2 / (n * d)), 6) AS v, round({_chi2_sf_sql('chi2', 'df')}, 6) AS p FROM a""")
def ct1p(spark: SparkSession, d: str) -> DataFrame:
    """The same per period, with tail probabilities."""
    e = C.counted(events(spark, d, "period", *COLS), "period", *COLS)
    return C.association(e, *COLS, by=["period"], p_value=True).select("period", "n", "df", *[r6(c, c) for c in ("chi2", "g", "v", "p")])


@Q("ct3_residuals", f"""{E}, n AS (SELECT hazard_category, sales_channel, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT h.hazard_category, s.sales_channel, coalesce(n, 0) AS o FROM (SELECT DISTINCT hazard_category FROM n) h CROSS JOIN (SELECT DISTINCT sales_channel FROM n) s LEFT JOIN n ON n.hazard_category = h.hazard_category AND n.sales_channel = s.sales_channel),
 m AS (SELECT *, sum(o) OVER (PARTITION BY hazard_category) AS r, sum(o) OVER (PARTITION BY sales_channel) AS c, sum(o) OVER () AS n FROM g) SELECT hazard_category, sales_channel, o, round(r * c / n, 6) AS e, round(coalesce((o - r * c / n) / nullif(sqrt(r * c / n * (1 - r / n) * (1 - c / n)), 0), 0), 6) AS residual FROM m""")
def ct3(spark: SparkSession, d: str) -> DataFrame:
    return C.residuals(cells(spark, d), *COLS).select(*COLS, "o", r6("e", "e"), r6("residual", "residual"))


def grid(spark: SparkSession, d: str) -> np.ndarray:
    """The table of hazards by channels as a small array."""
    rows = M.cells(C.full_grid(cells(spark, d), *COLS).orderBy(*COLS))
    return np.array([r["o"] for r in rows]).reshape(len({r[0] for r in rows}), -1)


@Q("fil8_filled_margins", f"""{E}, n AS (SELECT hazard_category, sales_channel, count(*) FILTER (WHERE price_usd > 40 AND injuries_reported) AS o FROM e WHERE hazard_category IS NOT NULL AND sales_channel IS NOT NULL GROUP BY ALL) SELECT hazard_category, sales_channel, o FROM n
 WHERE hazard_category IN (SELECT hazard_category FROM n GROUP BY 1 HAVING sum(o) > 0) AND sales_channel IN (SELECT sales_channel FROM n GROUP BY 1 HAVING sum(o) > 0)""")
def fil8(spark: SparkSession, d: str) -> DataFrame:
    """The table of dear products with injuries, without the rows and columns that are all zero."""
    e = events(spark, d, *COLS, "price_usd", "injuries_reported").where("hazard_category IS NOT NULL AND sales_channel IS NOT NULL")
    return C.filled(e.groupBy(*COLS).agg(F.count_if((F.col("price_usd") > 40) & F.col("injuries_reported")).alias("o")), *COLS)


@Q("ct4_permutation")
def ct4(spark: SparkSession, d: str) -> DataFrame:
    return C.permutation_p(spark, grid(spark, d), b=1_000)


_TBT = "count(*) FILTER (WHERE x AND y) AS a, count(*) FILTER (WHERE x AND NOT y) AS b, count(*) FILTER (WHERE NOT x AND y) AS c, count(*) FILTER (WHERE NOT x AND NOT y) AS d"
_XY = f"{E}, f AS (SELECT period, is_childrens AS x, injuries_reported AS y FROM e), s AS (SELECT period, {_TBT} FROM f WHERE period IS NOT NULL GROUP BY 1)"


def strata(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "period", "is_childrens", "injuries_reported").where("period IS NOT NULL")
    return C.two_by_two(e, F.col("is_childrens"), F.col("injuries_reported"), ["period"])


@Q("ct5_fisher", f"{_XY} SELECT period, a, b, c, d, round(a * d / nullif(b * c, 0), 6) AS odds FROM s")
def ct5(spark: SparkSession, d: str) -> DataFrame:
    """Sample odds; the exact p follows in ct5_fisher_p."""
    return strata(spark, d).select("period", *"abcd", r6(F.try_divide(F.col("a") * F.col("d"), F.col("b") * F.col("c")), "odds"))


_LOG_TABLE = "(lgamma(a + c + 1) - lgamma(x + 1) - lgamma(a + c - x + 1) + lgamma(b + d + 1) - lgamma(a + b - x + 1) - lgamma(b + d - a - b + x + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1))"


@Q("ct5_fisher_p", f"""{_XY}, x AS (SELECT period, a, b, c, d, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM s), l AS (SELECT period, a, x, {_LOG_TABLE} AS l FROM x), o AS (SELECT period, l AS seen FROM l WHERE x = a)
 SELECT period, round(least(1.0, sum(exp(l)) FILTER (WHERE l <= seen + 1e-7)), 6) AS p FROM l JOIN o USING (period) GROUP BY 1""")
def ct5p(spark: SparkSession, d: str) -> DataFrame:
    p = special.column(lambda a, b, c, e: special.fisher_exact(int(a), int(b), int(c), int(e))[1], *[F.col(x) for x in "abcd"])
    return strata(spark, d).select("period", r6(p, "p"))


_HALF = "(a + .5) * (d + .5) / ((b + .5) * (c + .5))"
_SE = "sqrt(1 / (a + .5) + 1 / (b + .5) + 1 / (c + .5) + 1 / (d + .5))"


@Q("ct6_odds_ratio", f"{_XY} SELECT period, round({_HALF}, 6) AS odds_ratio, round(exp(ln({_HALF}) - 1.959964 * {_SE}), 6) AS lo, round(exp(ln({_HALF}) + 1.959964 * {_SE}), 6) AS hi FROM s")
def ct6(spark: SparkSession, d: str) -> DataFrame:
    return strata(spark, d).select("period", *C.odds_ratio()).select("period", *[r6(c, c) for c in ("odds_ratio", "lo", "hi")])


_MH = f"""{_XY}, q AS (SELECT CAST(a AS DOUBLE) a, CAST(b AS DOUBLE) b, CAST(c AS DOUBLE) c, CAST(d AS DOUBLE) d, a + b + c + d AS n FROM s WHERE a + b + c + d > 1),
 t AS (SELECT sum(a*d/n) r, sum(b*c/n) s, sum((a+d)/n*a*d/n) pr, sum((a+d)/n*b*c/n + (b+c)/n*a*d/n) psqr, sum((b+c)/n*b*c/n) qs, sum(a) a, sum((a+b)*(a+c)/n) ea, sum((a+b)*(c+d)*(a+c)*(b+d)/(n*n*(n-1))) va FROM q), m AS (SELECT *, r / s AS o, pr/(2*r*r) + psqr/(2*r*s) + qs/(2*s*s) AS v FROM t)"""


@Q("ct7_mantel_haenszel", f"{_MH} SELECT round(o, 6) AS odds_ratio, round(exp(ln(o) - 1.959964 * sqrt(v)), 6) AS lo, round(exp(ln(o) + 1.959964 * sqrt(v)), 6) AS hi, round((abs(a - ea) - .5) * (abs(a - ea) - .5) / va, 6) AS chi2 FROM m")
def ct7(spark: SparkSession, d: str) -> DataFrame:
    return C.mantel_haenszel(strata(spark, d)).select(*[r6(c, c) for c in ("odds_ratio", "lo", "hi", "chi2")])


@Q("ct8_breslow_day", f"""{_MH}, z AS (SELECT q.*, o, a + b AS n1, c + d AS n2, a + c AS k FROM (SELECT CAST(a AS DOUBLE) a, CAST(b AS DOUBLE) b, CAST(c AS DOUBLE) c, CAST(d AS DOUBLE) d FROM s) q, (SELECT o FROM m) WHERE a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0),
 y AS (SELECT *, n2 - k + o * (n1 + k) AS w FROM z), x AS (SELECT *, 2 * o * n1 * k / (w + sqrt(w * w + 4 * (1 - o) * o * n1 * k)) AS x FROM y) SELECT round(sum((a - x) * (a - x) * (1/x + 1/(n1-x) + 1/(k-x) + 1/(n2-k+x))), 6) AS chi2, count(*) - 1 AS df FROM x""")
def ct8(spark: SparkSession, d: str) -> DataFrame:
    return C.breslow_day(strata(spark, d)).select(r6("chi2", "chi2"), "df")


_CUBE = f"{E}, o AS (SELECT hazard_category AS h, sales_channel AS c, period AS p, count(*) AS o FROM e WHERE period IS NOT NULL GROUP BY ALL), w AS (SELECT *, sum(o) OVER (PARTITION BY h) AS nh, sum(o) OVER (PARTITION BY c) AS nc, sum(o) OVER (PARTITION BY p) AS np, sum(o) OVER (PARTITION BY h, p) AS hp, sum(o) OVER (PARTITION BY c, p) AS cp, sum(o) OVER () AS n FROM o)"


def cube(spark: SparkSession, d: str) -> np.ndarray:
    rows = M.cells(C.counted(events(spark, d, "period", *COLS), *COLS, "period"))
    axes = [sorted({r[i] for r in rows}) for i in range(3)]
    out = np.zeros([len(a) for a in axes])
    for r in rows:
        out[tuple(a.index(v) for a, v in zip(axes, r))] = r["o"]
    return out


@Q("ct9_loglinear_closed", f"{_CUBE} SELECT 'independence' AS model, round(2 * sum(o * ln(o * n * n / (nh * nc * np))), 4) AS g2 FROM w UNION ALL SELECT 'conditional', round(2 * sum(o * ln(o * np / (hp * cp))), 4) FROM w UNION ALL SELECT 'saturated', 0")
def ct9(spark: SparkSession, d: str) -> DataFrame:
    """Deviances of the closed models, by proportional fitting."""
    o = cube(spark, d)
    models = {"independence": [(0,), (1,), (2,)], "conditional": [(0, 2), (1, 2)], "saturated": [(0, 1, 2)]}
    return spark.createDataFrame([(m, round(C.deviance(o, C.cube_fit(o, k)), 4) + 0.0) for m, k in models.items()], "model string, g2 double")


@Q("ct9_loglinear_homogeneous")
def ct9b(spark: SparkSession, d: str) -> DataFrame:
    """The model of homogeneous association, with its information criteria."""
    o = cube(spark, d)
    g2 = C.deviance(o, C.cube_fit(o, [(0, 1), (0, 2), (1, 2)], 1e-9))
    df = int(np.prod([s - 1 for s in o.shape]))
    return spark.createDataFrame([(g2, df, special.chi2_sf(g2, df), g2 - 2 * df, g2 - df * float(np.log(o.sum())))], "g2 double, df int, p double, aic double, bic double")


@Q("ct10_parametric_bootstrap")
def ct10(spark: SparkSession, d: str) -> DataFrame:
    """How often tables drawn from the independence model deviate at least as much."""
    o = cube(spark, d)
    margins = [(0,), (1,), (2,)]
    e = C.cube_fit(o, margins)
    seen, n, p = C.deviance(o, e), int(o.sum()), (e / e.sum()).ravel()
    shape = o.shape

    def draw(rng):
        x = rng.multinomial(n, p).reshape(shape)
        return {"g2": C.deviance(x, C.cube_fit(x, margins))}

    return C.replicates(spark, 400, 3, draw, ["g2"]).agg(F.lit(seen).alias("g2"), ((F.count_if(F.col("g2") >= seen) + 1) / 401).alias("p"))


@Q("ct11_decomposition", f"""{E}, g AS (SELECT sales_channel, count(*) FILTER (WHERE year < 2005) AS n0, count(*) FILTER (WHERE year >= 2005) AS n1, count(*) FILTER (WHERE year < 2005 AND is_violation) AS k0, count(*) FILTER (WHERE year >= 2005 AND is_violation) AS k1 FROM e GROUP BY 1),
 w AS (SELECT n0 / sum(n0) OVER () AS w0, n1 / sum(n1) OVER () AS w1, coalesce(k0 / nullif(n0, 0), 0) AS r0, coalesce(k1 / nullif(n1, 0), 0) AS r1 FROM g) SELECT round(sum((w1 - w0) * (r0 + r1) / 2), 6) AS composition, round(sum((w0 + w1) / 2 * (r1 - r0)), 6) AS rate, round(sum((w1 - w0) * (r0 + r1) / 2 + (w0 + w1) / 2 * (r1 - r0)), 6) AS total FROM w""")
def ct11(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "sales_channel", "is_violation", "year")
    return C.decomposition(e, F.col("is_violation"), "sales_channel", F.col("year") >= 2005).select(*[r6(c, c) for c in ("composition", "rate", "total")])


@Q("ct11_bootstrap")
def ct11b(spark: SparkSession, d: str) -> DataFrame:
    """The decomposition with percentile intervals: resampled rows, counted, are one multinomial draw of the cells."""
    e = events(spark, d, "sales_channel", "is_violation", "year").where("year IS NOT NULL AND is_violation IS NOT NULL")
    rows = M.cells(e.groupBy("sales_channel", (F.col("year") >= 2005).cast("int").alias("late"), F.col("is_violation").cast("int").alias("k")).agg(F.count("*").alias("o")))
    groups = sorted({r["sales_channel"] or "" for r in rows})
    cube_ = np.zeros((2, len(groups), 2))
    for r in rows:
        cube_[r["late"], groups.index(r["sales_channel"] or ""), r["k"]] += r["o"]
    seen, n, shape = C.split_change(cube_), int(cube_.sum()), cube_.shape
    reps = C.replicates(spark, 2_000, 99, lambda rng: C.split_change(rng.multinomial(n, cube_.ravel() / n).reshape(shape)), list(seen))
    known = spark.createDataFrame(list(seen.items()), "part string, estimate double")
    long = reps.unpivot(["rep"], list(seen), "part", "value").groupBy("part").agg(*C.interval("value"))
    return known.join(long, "part")


def share_cells(spark: SparkSession, d: str) -> tuple[list[int], list[str], np.ndarray]:
    """Counts by year, channel and whether the event is of the flammability kind."""
    e = events(spark, d, "year", "sales_channel", "hazard_category").where("year IS NOT NULL AND sales_channel IS NOT NULL AND hazard_category IS NOT NULL")
    rows = M.cells(e.groupBy("year", "sales_channel", (F.col("hazard_category") == "flammability_burn").cast("int").alias("k")).agg(F.count("*").alias("o")))
    years, channels = sorted({r["year"] for r in rows}), sorted({r["sales_channel"] for r in rows})
    out = np.zeros((len(years), len(channels), 2))
    for r in rows:
        out[years.index(r["year"]), channels.index(r["sales_channel"]), r["k"]] = r["o"]
    return years, channels, out


@Q("ct12_bootstrap_families")
def ct12c(spark: SparkSession, d: str) -> DataFrame:
    """Shares of flammability within channels and of channels within flammability, by period and by year over seven years,
    with their change from the first period to the last: estimate, interval, denominator and the share of draws at or below 0."""
    years, channels, counts = share_cells(spark, d)
    at = lambda lo, hi: np.array([lo < y <= hi for y in years], float)
    frames = {("period", f"{a + 1}-{b}"): at(a, b) for a, b in zip(EDGES, EDGES[1:])} | {("rolling", str(y)): at(y - 4, y + 3) for y in years}
    frames = {k: w for k, w in frames.items() if w.any()}
    w = np.array(list(frames.values()))
    kinds = [(f"flammable_given_{c}", i, True) for i, c in enumerate(channels)] + [(f"{c}_given_flammable", i, False) for i, c in enumerate(channels)]

    def shares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = np.tensordot(w, x, axes=(1, 0))
        num = np.stack([t[:, i, 1] for _, i, _ in kinds], 1)
        den = np.stack([t[:, i].sum(-1) if within else t[:, :, 1].sum(-1) for _, i, within in kinds], 1)
        return np.divide(num, den, out=np.full_like(num, np.nan), where=den > 0), den

    periods = [i for i, (family, _) in enumerate(frames) if family == "period"]
    last, first = periods[-1], periods[0]
    point, den = shares(counts)
    n, shape = int(counts.sum()), counts.shape
    names = [f"v{i}" for i in range(point.size + len(kinds))]

    def draw(rng):
        s, _ = shares(rng.multinomial(n, counts.ravel() / n).reshape(shape))
        return dict(zip(names, np.concatenate([s.ravel(), s[last] - s[first]])))

    labels = [(family, x, k) for family, x in frames for k, *_ in kinds] + [("difference", "last - first", k) for k, *_ in kinds]
    values = np.concatenate([point.ravel(), point[last] - point[first]])
    dens = np.concatenate([den.ravel(), np.minimum(den[last], den[first])])
    known = [(c, *x, None if np.isnan(v) else float(v), int(m)) for c, x, v, m in zip(names, labels, values, dens)]
    known = spark.createDataFrame(known, "col string, family string, at string, quantity string, estimate double, denominator int")
    long = C.replicates(spark, 1_000, 12, draw, names).unpivot(["rep"], names, "col", "v").where("NOT isnan(v)")
    ci = long.groupBy("col").agg(*C.interval("v"), F.avg((F.col("v") <= 0).cast("int")).alias("p_not_positive"))
    return known.join(ci, "col", "left").drop("col")


@Q("ct12_bootstrap_shares")
def ct12(spark: SparkSession, d: str) -> DataFrame:
    counts = {r[0]: r[1] for r in M.cells(C.counted(events(spark, d, "sales_channel"), "sales_channel").orderBy("sales_channel"))}
    return C.bootstrap_shares(spark, counts, b=1_000)


def _wilson(k: str, n: str) -> tuple[str, str]:
    c, h = f"({k}/{n} + 1.9208/{n}) / (1 + 3.8416/{n})", f"1.96 * sqrt({k}/{n} * (1 - {k}/{n}) / {n} + 0.9604 / ({n}*{n})) / (1 + 3.8416/{n})"
    return f"CASE WHEN {n} > 0 THEN round(greatest({c} - {h}, 0), 6) END", f"CASE WHEN {n} > 0 THEN round(least({c} + {h}, 1), 6) END"


@Q("ct13_wilson", f"{_YEARLY}, z AS (SELECT year, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k FROM y) SELECT year, {_wilson('k', 'n')[0]} AS lo, {_wilson('k', 'n')[1]} AS hi FROM z")
def ct13(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = C.wilson(F.col("k"), F.col("n"))
    return yearly(spark, d).select("year", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


_POISSON_CDF = "list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: exp(-{m} + i * ln({m}) - lgamma(i + 1))))"


@Q("ct14_garwood", f"""{_RATE.replace("WITH e", "WITH RECURSIVE e", 1)}, g AS (SELECT country, CAST(sum(events) AS BIGINT) AS k, sum(value) AS x FROM p GROUP BY 1 HAVING sum(value) > 0),
 b AS (SELECT country, k, x, 0.0::DOUBLE AS l1, k + 1.0::DOUBLE AS h1, k::DOUBLE AS l2, k + 10 * sqrt(k + 1.0::DOUBLE) + 20 AS h2, 0 AS i FROM g UNION ALL
 SELECT country, k, x, CASE WHEN k > 0 AND 1 - {_POISSON_CDF.format(k='(k - 1)', m='((l1 + h1) / 2)')} < 0.025 THEN (l1 + h1) / 2 ELSE l1 END, CASE WHEN k > 0 AND 1 - {_POISSON_CDF.format(k='(k - 1)', m='((l1 + h1) / 2)')} < 0.025 THEN h1 ELSE (l1 + h1) / 2 END,
 CASE WHEN {_POISSON_CDF.format(k='k', m='((l2 + h2) / 2)')} > 0.025 THEN (l2 + h2) / 2 ELSE l2 END, CASE WHEN {_POISSON_CDF.format(k='k', m='((l2 + h2) / 2)')} > 0.025 THEN h2 ELSE (l2 + h2) / 2 END, i + 1 FROM b WHERE i < 55)
 SELECT country, k, CASE WHEN k > 0 THEN round(l1, 6) END AS lo_events, round(l2, 6) AS hi_events, CASE WHEN k > 0 THEN round(l1 / x * 1e9, 4) END AS lo, round(l2 / x * 1e9, 4) AS hi FROM b WHERE i = 55""")
def ct14(spark: SparkSession, d: str) -> DataFrame:
    """Exact Poisson intervals of events per exposure; the lower end is NULL at zero events."""
    p = rate_base(spark, d).groupBy("country").agg(F.sum("events").alias("k"), F.sum("value").alias("x")).where("x > 0")
    lo = special.column(lambda k: special.chi2_ppf(0.025, 2 * k) / 2, F.col("k"))
    hi = special.column(lambda k: special.chi2_ppf(0.975, 2 * k + 2) / 2, F.col("k"))
    ends = materialize(p.select("country", "k", "x", lo.alias("l"), hi.alias("h")), "ends")
    return ends.select("country", "k", r6("l", "lo_events"), r6("h", "hi_events"), F.round(F.col("l") / F.col("x") * 1e9, 4).alias("lo"), F.round(F.col("h") / F.col("x") * 1e9, 4).alias("hi"))


@Q("ct15_jeffreys_mean", f"{E} SELECT segment, round((count(*) FILTER (WHERE is_violation) + 0.5) / (count(*) + 1), 6) AS mean FROM e GROUP BY 1")
def ct15(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "segment", "is_violation").groupBy("segment").agg(r6((F.count_if("is_violation") + 0.5) / (F.count("*") + 1), "mean"))


def _beta_cdf_sql(x: str) -> str:
    """Beta distribution of a and b up to x, by Simpson's rule over 2,000 steps."""
    return f"({x} / 6000 * list_sum(list_transform(range(1, 2001), lambda i: CASE WHEN i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp((a - 1) * ln({x} * i / 2000) + (b - 1) * ln(1 - {x} * i / 2000) + lgamma(a + b) - lgamma(a) - lgamma(b)))))"


_BETA_MID = _beta_cdf_sql("((lo + hi) / 2)")


@Q("ct15_jeffreys_interval", f"""{E.replace("WITH e", "WITH RECURSIVE e", 1)}, g AS (SELECT segment, count(*) FILTER (WHERE is_violation) + 0.5::DOUBLE AS a, count(*) - count(*) FILTER (WHERE is_violation) + 0.5::DOUBLE AS b FROM e GROUP BY 1), q AS (SELECT segment, a, b, p FROM g, (VALUES (0.025), (0.975)) t(p)),
 z AS (SELECT segment, a, b, p, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM q UNION ALL SELECT segment, a, b, p, CASE WHEN {_BETA_MID} < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_BETA_MID} < p THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM z WHERE i < 40)
 SELECT segment, round(max(lo) FILTER (WHERE p < 0.5), 5) AS lo, round(max(lo) FILTER (WHERE p > 0.5), 5) AS hi FROM z WHERE i = 40 GROUP BY 1""")
def ct15b(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d, "segment", "is_violation").groupBy("segment").agg(F.count_if("is_violation").alias("k"), F.count("*").alias("n"))
    q = lambda p: special.column(lambda k, n: special.beta_ppf(p, k + 0.5, n - k + 0.5), F.col("k"), F.col("n"))
    return g.select("segment", F.round(q(0.025), 5).alias("lo"), F.round(q(0.975), 5).alias("hi"))


@Q("ct16_trend", f"{E}, g AS (SELECT year AS x, count(*) AS n, count(*) FILTER (WHERE is_violation) AS k FROM e WHERE year IS NOT NULL GROUP BY 1), s AS (SELECT sum(n) n, sum(k) k, sum(x*k) xk, sum(x*n) xn, sum(x*x*n) xxn FROM g) SELECT round((xk - k/n*xn) / sqrt(k/n*(1-k/n)*(xxn - xn*xn/n)), 6) AS z FROM s")
def ct16(spark: SparkSession, d: str) -> DataFrame:
    return C.trend(events(spark, d, "year", "is_violation"), "year", F.col("is_violation")).select(r6("z", "z"))


@Q("ct17_kruskal", f"""{E}, r AS (SELECT sales_channel AS g, price_usd AS v, rank() OVER (ORDER BY price_usd) + (count(*) OVER (PARTITION BY price_usd) - 1) / 2 AS r FROM e WHERE price_usd IS NOT NULL AND sales_channel IS NOT NULL), b AS (SELECT g, count(*) AS n, sum(r) AS s FROM r GROUP BY 1), t AS (SELECT sum(CAST(m AS DOUBLE)*m*m - m) AS ties FROM (SELECT count(*) AS m FROM r GROUP BY v)),
 a AS (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(s * s / n) AS q, count(*) AS k FROM b) SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h, k - 1 AS df FROM a, t""")
def ct17(spark: SparkSession, d: str) -> DataFrame:
    return C.kruskal(events(spark, d, "sales_channel", "price_usd"), "sales_channel", "price_usd").select(F.round("h", 4).alias("h"), "df")


@Q("ct18_log_odds", f"""{E}, w AS (SELECT segment, unnest(regexp_extract_all(lower(title), '[a-z][a-z\\-]+')) AS term FROM e WHERE segment IS NOT NULL), t AS (SELECT term, count(*) AS c, count(*) FILTER (WHERE segment = 'apparel') AS ya, count(*) FILTER (WHERE segment = 'home_textile') AS yb FROM w GROUP BY 1),
 s AS (SELECT *, 500.0 * c / sum(c) OVER () AS al, sum(ya) OVER () AS na, sum(yb) OVER () AS nb FROM t), x AS (SELECT term, ln((ya + al) / (na + 500 - ya - al)) - ln((yb + al) / (nb + 500 - yb - al)) AS delta, 1 / (ya + al) + 1 / (yb + al) AS v FROM s) SELECT term, round(delta, 6) AS delta, round(delta / sqrt(v), 6) AS z FROM x""")
def ct18(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "segment", "title").where("segment IS NOT NULL").select("segment", F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"[a-z][a-z\-]+"), F.lit(0))).alias("term"))
    n = e.groupBy("term", "segment").agg(F.count("*").alias("n"))
    return C.log_odds_contrast(n, "term", "segment", "apparel", "home_textile").select("term", r6("delta", "delta"), r6("z", "z"))


@Q("ct19_gini_bootstrap")
def ct19(spark: SparkSession, d: str) -> DataFrame:
    """Percentile interval of the concentration, resampling the multiplicities of the sizes."""
    rows = M.cells(firm_sizes(spark, d).groupBy("x").agg(F.count("*").alias("m")).orderBy("x"))
    x, m = np.array([r["x"] for r in rows], float), np.array([r["m"] for r in rows], float)

    n = int(m.sum())
    reps = C.replicates(spark, 500, 5, lambda rng: {"g": C.gini_of(x, rng.multinomial(n, m / n).astype(float))}, ["g"])
    return reps.agg(F.lit(C.gini_of(x, m)).alias("gini"), F.percentile("g", F.lit(0.025)).alias("lo"), F.percentile("g", F.lit(0.975)).alias("hi"))


@Q("ct19_gini_by_era")
def ct19b(spark: SparkSession, d: str) -> DataFrame:
    """Concentration before 2010 and since, the difference, their intervals, and the two-sided p of the difference."""
    sizes = events(spark, d, "firm_key", "year").where("firm_key IS NOT NULL AND year IS NOT NULL").groupBy("firm_key", (F.col("year") >= 2010).cast("int").alias("late")).agg(F.count("*").alias("x"))
    rows = M.cells(sizes.groupBy("late", "x").agg(F.count("*").alias("m")).orderBy("late", "x"))
    eras = [(np.array([r["x"] for r in rows if r["late"] == e], float), np.array([r["m"] for r in rows if r["late"] == e], float)) for e in (0, 1)]

    def draw(rng):
        g = [C.gini_of(x, rng.multinomial(int(m.sum()), m / m.sum()).astype(float)) for x, m in eras]
        return {"before_2010": g[0], "since_2010": g[1], "difference": g[1] - g[0]}

    seen = [C.gini_of(x, m) for x, m in eras]
    names = ["before_2010", "since_2010", "difference"]
    known = spark.createDataFrame(list(zip(names, [*seen, seen[1] - seen[0]])), "part string, estimate double")
    low, high = F.avg((F.col("v") <= 0).cast("int")), F.avg((F.col("v") >= 0).cast("int"))
    ci = C.replicates(spark, 2_000, 13, draw, names).unpivot(["rep"], names, "part", "v").groupBy("part").agg(*C.interval("v"), F.least(2 * F.least(low, high), F.lit(1.0)).alias("p"))
    return known.join(ci, "part").select("part", "estimate", "lo", "hi", F.when(F.col("part") == "difference", F.col("p")).alias("p"))


@Q("mth2_densities", f"""{_YEARLY} SELECT year, round(n * ln(30) - 30 - lgamma(n + 1), 6) AS poisson, round(lgamma(n + 2) - lgamma(2) - lgamma(n + 1) + 2 * ln(2 / 32.0) + n * ln(30 / 32.0), 6) AS negbin,
 round(lgamma(2.5) - lgamma(2) - 0.5 * ln(4 * pi()) - ln(10) - 2.5 * ln(1 + (n - 30) / 10.0 * (n - 30) / 10.0 / 4), 6) AS student, round(-0.5 * (n - 30) / 10.0 * (n - 30) / 10.0 - ln(10) - 0.5 * ln(2 * pi()), 6) AS normal FROM y""")
def mth2(spark: SparkSession, d: str) -> DataFrame:
    """Log densities of the yearly counts."""
    one = lambda f, name: r6(special.column(f, F.col("n")), name)
    return yearly(spark, d).select(
        "year", one(lambda n: special.log_poisson(n, 30.0), "poisson"), one(lambda n: special.log_negbin(n, 30.0, 2.0), "negbin"),
        one(lambda n: special.log_student(n - 30.0, 4.0, 10.0), "student"), one(lambda n: special.log_normal(n, 30.0, 10.0), "normal"),
    )


@Q("mth3_tails", f"""{_YEARLY} SELECT year, round({_chi2_sf_sql('x', '3')}, 6) AS chi2, round({_phi_sql('x')}, 6) AS normal, round(0.5 - (atan(x / sqrt(5)) + x / sqrt(5) / (1 + x * x / 5) * (1 + 2 / (3 * (1 + x * x / 5)))) / pi(), 6) AS student FROM (SELECT year, sqrt(n) / 4 AS x FROM y)""")
def mth3(spark: SparkSession, d: str) -> DataFrame:
    """Upper tails at the scaled roots of the yearly counts."""
    y = yearly(spark, d).select("year", (F.sqrt("n") / 4).alias("x"))
    one = lambda f, name: r6(special.column(f, F.col("x")), name)
    return y.select("year", one(lambda v: special.chi2_sf(v, 3), "chi2"), one(special.normal_sf, "normal"), one(lambda v: special.t_sf(v, 5), "student"))


# --- regressions: sufficient statistics are checked by SQL, fits by tests ---------------------------------------------
@Q("reg1_cells", f"{_RATE} SELECT country, {_PERIOD} AS period, CAST(sum(events) AS BIGINT) AS k, round(sum(value), 2) AS x FROM p WHERE value > 0 AND {_PERIOD} IS NOT NULL GROUP BY ALL")
def reg1_cells(spark: SparkSession, d: str) -> DataFrame:
    p = rate_base(spark, d).where("value > 0").groupBy("country", period_of(F.col("year"), EDGES).alias("period")).agg(F.sum("events").alias("k"), F.round(F.sum("value"), 2).alias("x"))
    return p.where("period IS NOT NULL")


@Q("reg1_quasi_poisson")
def reg1(spark: SparkSession, d: str) -> DataFrame:
    """Event rates by country and period with an exposure offset and Pearson dispersion."""
    rows = M.cells(reg1_cells(spark, d).orderBy("country", "period"))
    x, names = M.design(rows, ["country", "period"])
    return M.poisson(x, np.array([float(r["k"]) for r in rows]), np.log([r["x"] for r in rows]), names, quasi=True).table(spark, student=True)


def rounded(fit: DataFrame, *more: str) -> DataFrame:
    return fit.select("term", *[r6(c, c) for c in ("estimate", "se", "ratio", "lo", "hi", "p", *more)])


def _table_sql(b: str, se: str) -> str:
    """The columns of a coefficient table, of an estimate and its error."""
    return f"round({b}, 6) AS estimate, round({se}, 6) AS se, round(exp({b}), 6) AS ratio, round(exp({b} - 1.96 * {se}), 6) AS lo, round(exp({b} + 1.96 * {se}), 6) AS hi, round(2 * {_phi_sql(f'abs({b} / {se})')}, 6) AS p"


@Q("reg2_loglinear_poisson", f"""{E}, o AS (SELECT hazard_category AS h, sales_channel AS c, count(*) AS o FROM e WHERE hazard_category IS NOT NULL AND sales_channel IS NOT NULL GROUP BY ALL), r AS (SELECT h, sum(o) AS n, row_number() OVER (ORDER BY h) AS i FROM o GROUP BY 1), k AS (SELECT c, sum(o) AS n, row_number() OVER (ORDER BY c) AS i FROM o GROUP BY 1),
 t AS (SELECT sum(o) AS n FROM o), b AS (SELECT '(intercept)' AS term, ln(r.n * k.n / t.n) AS b, sqrt(1 / r.n + 1 / k.n - 1 / t.n) AS se FROM r, k, t WHERE r.i = 1 AND k.i = 1 UNION ALL SELECT 'hazard_category=' || x.h, ln(x.n / y.n), sqrt(1 / x.n + 1 / y.n) FROM r x, r y WHERE x.i > 1 AND y.i = 1
 UNION ALL SELECT 'sales_channel=' || x.c, ln(x.n / y.n), sqrt(1 / x.n + 1 / y.n) FROM k x, k y WHERE x.i > 1 AND y.i = 1) SELECT term, {_table_sql('b', 'se')} FROM b""")
def reg2(spark: SparkSession, d: str) -> DataFrame:
    """Independence of hazard and channel as a Poisson model of the cells."""
    rows = M.cells(C.full_grid(cells(spark, d), *COLS).orderBy(*COLS))
    x, names = M.design(rows, COLS)
    return rounded(M.poisson(x, np.array([float(r["o"]) for r in rows]), 0.0, names).table(spark))


def year_cells(spark: SparkSession, d: str) -> list:
    return M.cells(yearly(spark, d).withColumn("decade", (F.col("year") - 2000) / 10.0).orderBy("year"))


def _newton_sql(mean: str, weight: str, start: str, where: str = "true") -> str:
    """Tables up to f (a, b, va, vb, cab) of a two-parameter fit in the decade, by Newton's method."""
    return f"""{_YEARLY.replace("WITH e", "WITH RECURSIVE e", 1)}, d AS (SELECT year, (year - 2000) / 10.0 AS x, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k FROM y WHERE {where}), it AS (SELECT 0 AS i, {start}::DOUBLE AS a, 0.0::DOUBLE AS b FROM (SELECT sum(n) AS sn, sum(k) AS sk, count(*) AS m FROM d) UNION ALL
 SELECT i + 1, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (SELECT i, a, b, sum(r) AS g1, sum(x * r) AS g2, sum(w) AS h11, sum(x * w) AS h12, sum(x * x * w) AS h22 FROM (SELECT i, a, b, x, {mean} AS r, {weight} AS w FROM it, d) GROUP BY i, a, b) WHERE i < 40),
 l AS (SELECT a, b FROM it WHERE i = 40), h AS (SELECT a, b, sum(w) AS h11, sum(x * w) AS h12, sum(x * x * w) AS h22 FROM (SELECT a, b, x, {weight} AS w FROM l, d) GROUP BY a, b), f AS (SELECT a, b, h22 / (h11 * h22 - h12 * h12) AS va, h11 / (h11 * h22 - h12 * h12) AS vb, -h12 / (h11 * h22 - h12 * h12) AS cab FROM h)"""


_RATE_FIT = _newton_sql("n - exp(a + b * x)", "exp(a + b * x)", "ln(sn / m)")
_SHARE_FIT = _newton_sql("k - n / (1 + exp(-a - b * x))", "n / (1 + exp(-a - b * x)) / (1 + exp(a + b * x))", "ln(sk / (sn - sk))", "n > 0")


@Q("reg3_count_trend", f"""{_RATE_FIT}, s AS (SELECT greatest(sum((n - exp(a + b * x)) * (n - exp(a + b * x)) / exp(a + b * x)) / (count(*) - 2), 1) AS q FROM l, d), c AS (SELECT '(intercept)' AS term, a AS e, sqrt(va * q) AS se FROM f, s UNION ALL SELECT 'decade', b, sqrt(vb * q) FROM f, s)
 SELECT term, {_table_sql('e', 'se')} FROM c""")
def reg3(spark: SparkSession, d: str) -> DataFrame:
    rows = year_cells(spark, d)
    x, names = M.design(rows, [], ["decade"])
    return rounded(M.poisson(x, np.array([float(r["n"]) for r in rows]), 0.0, names, quasi=True).table(spark))


@Q("reg4_logistic_trend", f"""{_SHARE_FIT}, ll AS (SELECT sum(k * (a + b * x) - n * ln(1 + exp(a + b * x))) AS one, sum(k) * ln(sum(k) / sum(n)) + (sum(n) - sum(k)) * ln(1 - sum(k) / sum(n)) AS none FROM l, d), c AS (SELECT '(intercept)' AS term, a AS e, sqrt(va) AS se FROM f UNION ALL SELECT 'decade', b, sqrt(vb) FROM f)
 SELECT term, {_table_sql('e', 'se')}, round(2 * (one - none), 6) AS lr, round({_chi2_sf_sql('(2 * (one - none))', '1')}, 6) AS lr_p FROM c, ll""")
def reg4(spark: SparkSession, d: str) -> DataFrame:
    """Trend of a share per decade, with the likelihood-ratio test against no trend."""
    rows = [r for r in year_cells(spark, d) if r["n"]]
    x, names = M.design(rows, [], ["decade"])
    k, n = np.array([float(r["k"]) for r in rows]), np.array([float(r["n"]) for r in rows])
    fit, none = M.logistic(x, k, n, names), M.logistic(x[:, :1], k, n)
    lr = 2 * (fit.loglik - none.loglik)
    return rounded(fit.table(spark).withColumn("lr", F.lit(float(lr))).withColumn("lr_p", F.lit(special.chi2_sf(max(lr, 0.0), 1))), "lr", "lr_p")


@Q("reg4_fitted_curve", f"""{_SHARE_FIT}, c AS (SELECT year, a + b * x AS e, sqrt(va + 2 * x * cab + x * x * vb) AS s FROM f, d) SELECT year, round(1 / (1 + exp(-e)), 6) AS share, round(1 / (1 + exp(-e + 1.96 * s)), 6) AS lo, round(1 / (1 + exp(-e - 1.96 * s)), 6) AS hi FROM c""")
def reg4b(spark: SparkSession, d: str) -> DataFrame:
    """The fitted share by year with its delta-method band."""
    rows = [r for r in year_cells(spark, d) if r["n"]]
    x, names = M.design(rows, [], ["decade"])
    fit = M.logistic(x, np.array([float(r["k"]) for r in rows]), np.array([float(r["n"]) for r in rows]), names)
    eta, se = x @ fit.beta, np.sqrt(np.einsum("ij,jk,ik->i", x, fit.cov, x))
    s = lambda v: round(float(1 / (1 + np.exp(-v))), 6)
    return spark.createDataFrame([(r["year"], s(a), s(a - 1.96 * b), s(a + 1.96 * b)) for r, a, b in zip(rows, eta, se)], "year int, share double, lo double, hi double")


def hazard_logit(spark: SparkSession, d: str):
    """Hazard by online sale, period and children's product: the fits without and with online sale by period."""
    e = events(spark, d, "period", *COLS, "is_childrens").where("is_childrens IS NOT NULL")
    e = e.select("period", "hazard_category", (F.col("sales_channel") == "online_only").cast("int").alias("online"), F.col("is_childrens").cast("int").alias("children"))
    rows = M.cells(C.counted(e, "period", "online", "children", "hazard_category"))
    levels, periods = sorted({r["hazard_category"] for r in rows}), sorted({r["period"] for r in rows})
    keys = sorted({(r["period"], r["online"], r["children"]) for r in rows})
    counts = np.zeros((len(keys), len(levels)))
    for r in rows:
        counts[keys.index((r["period"], r["online"], r["children"])), levels.index(r["hazard_category"])] = r["o"]

    def design(crossed: bool):
        x, names = M.design([{"online": o, "period": p, "children": c} for p, o, c in keys], ["period"], ["online", "children"])
        if crossed:
            extra = [(f"online:{n}", x[:, names.index("online")] * x[:, names.index(n)]) for n in names if n.startswith("period=")]
            x, names = np.column_stack([x, *[v for _, v in extra]]), [*names, *[n for n, _ in extra]]
        return x, names

    out = []
    for crossed in (False, True):
        x, names = design(crossed)
        out.append((x, M.multinomial(x, counts, names, levels, ridge=1 / 2.5**2, intercept_ridge=1 / 10.0**2)))
    return keys, levels, out


@Q("reg5_multinomial")
def reg5(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of both models."""
    _, _, fits = hazard_logit(spark, d)
    parts = [f.table(spark).withColumn("model", F.lit(n)) for n, (_, f) in zip(("main", "online_by_period"), fits)]
    return parts[0].unionByName(parts[1])


@Q("reg5_likelihood_ratio")
def reg5b(spark: SparkSession, d: str) -> DataFrame:
    """Whether the effect of online sale differs by period."""
    _, _, ((_, a), (_, b)) = hazard_logit(spark, d)
    stat, df = 2 * (b.loglik - a.loglik), len(b.beta) - len(a.beta)
    return spark.createDataFrame([(stat, df, special.chi2_sf(max(stat, 0.0), df))], "statistic double, df int, p double")


@Q("reg5_scenarios")
def reg5c(spark: SparkSession, d: str) -> DataFrame:
    """Predicted hazards of each combination of period, online sale and children's product."""
    keys, levels, (_, (x, fit)) = hazard_logit(spark, d)
    p = M.multinomial_shares(x, fit.beta)
    return spark.createDataFrame([(k[0], bool(k[1]), bool(k[2]), lv, float(v)) for k, row in zip(keys, p) for lv, v in zip(levels, row)], "period string, online boolean, childrens boolean, hazard string, share double")


@Q("agg19_gini_by_segment", f"{E}, z AS (SELECT firm_key, count(*) AS x FROM e WHERE firm_key IS NOT NULL AND segment = 'apparel' GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM z) SELECT round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n), 6) AS gini FROM r")
def gini_apparel(spark: SparkSession, d: str) -> DataFrame:
    z = events(spark, d, "firm_key", "segment").where("firm_key IS NOT NULL AND segment = 'apparel'").groupBy("firm_key").agg(F.count("*").alias("x"))
    return gini(z, "x").select(r6("gini", "gini"))
