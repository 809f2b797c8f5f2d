"""Contingency tables: association, residuals, stratified odds ratios, decomposition, trend, resampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.special import chi2_sf, column
from tessera.operators.series import running


LEVELS = 10_000  # most columns of a table that is filled up


def counted(df: DataFrame, *by: str) -> DataFrame:
    """(by, o): counts of the combinations without NULL; the only step that sees rows."""
    return df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by)).groupBy(*by).agg(F.count("*").alias("o"))


def _margins(cells: DataFrame, row: str, col: str, by: Sequence[str] = ()) -> DataFrame:
    w = lambda *k: Window.partitionBy(*(list(by) + list(k) or [F.lit(1)]))
    return cells.withColumn("__r", F.sum("o").over(w(row))).withColumn("__c", F.sum("o").over(w(col))).withColumn("__n", F.sum("o").over(w()))


def association(cells: DataFrame, row: str, col: str, by: Sequence[str] = (), p_value: bool = False) -> DataFrame:
    """One row per `by`: n, df, chi2, g, v (and p) of a table of counts `o`; empty rows and columns don't count.

    Cells that don't occur need no row: chi2 is the sum of o^2/e over the others, less n. Tables with one row or column have
    df 0 and NULL v.
    """
    m = _margins(cells.where("o > 0"), row, col, by).withColumn("e", F.col("__r") * F.col("__c") / F.col("__n"))
    s = m.groupBy(*by).agg(
        F.max("__n").alias("n"), F.count_distinct(row).alias("nr"), F.count_distinct(col).alias("nc"),
        F.sum(F.col("o") * F.col("o") / F.col("e")).alias("q"), (2 * F.sum(F.col("o") * F.log(F.col("o") / F.col("e")))).alias("g"),
    )
    chi2, df = F.col("q") - F.col("n"), (F.col("nr") - 1) * (F.col("nc") - 1)
    v = F.when(df > 0, F.sqrt(F.greatest(F.try_divide(chi2, F.col("n") * (F.least("nr", "nc") - 1)), F.lit(0.0))))
    out = s.select(*by, "n", df.alias("df"), chi2.alias("chi2"), "g", v.alias("v"))
    return out.withColumn("p", F.when(F.col("df") > 0, column(chi2_sf, F.col("chi2"), F.greatest("df", F.lit(1))))) if p_value else out


def full_grid(cells: DataFrame, row: str, col: str) -> DataFrame:
    """Every combination of the levels that occur, missing counts being 0; as long as the levels' product."""
    rows, cols = cells.select(row).distinct(), cells.select(F.collect_set(col).alias("__cols"))
    levels = cols.select(F.size("__cols")).first()[0]
    if levels > LEVELS:
        raise ValueError(f"a full table takes {LEVELS} columns at most, this has {levels}")
    wide = rows.join(F.broadcast(cols)).select(row, F.explode("__cols").alias(col))  # one row of LEVELS entries at most
    return wide.join(cells, [row, col], "left").na.fill(0, ["o"])


def filled(cells: DataFrame, row: str, col: str) -> DataFrame:
    """The table without the rows and columns whose counts are all zero."""
    return _margins(cells, row, col).where("__r > 0 AND __c > 0").drop("__r", "__c", "__n")


def residuals(cells: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, o, e, residual): adjusted standardised residuals, 0 where the standard error is 0."""
    m = _margins(full_grid(cells, row, col), row, col).withColumn("e", F.col("__r") * F.col("__c") / F.col("__n"))
    se = F.sqrt(F.col("e") * (1 - F.col("__r") / F.col("__n")) * (1 - F.col("__c") / F.col("__n")))
    return m.select(row, col, "o", "e", F.coalesce(F.try_divide(F.col("o") - F.col("e"), se), F.lit(0.0)).alias("residual"))


def two_by_two(df: DataFrame, x: Column, y: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, c, d): rows with both, x only, y only and neither; NULL flags are left out."""
    rows = df.where(x.isNotNull() & y.isNotNull())
    return rows.groupBy(*by).agg(*[F.count_if(i & j).alias(n) for n, i, j in (("a", x, y), ("b", x, ~y), ("c", ~x, y), ("d", ~x, ~y))])


Z = 1.959964


def odds_ratio() -> list[Column]:
    """odds_ratio, lo, hi of a, b, c, d with half a count added to each."""
    a, b, c, d = (F.col(x) + 0.5 for x in "abcd")
    log_or, se = F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return [F.exp(log_or).alias("odds_ratio"), F.exp(log_or - Z * se).alias("lo"), F.exp(log_or + Z * se).alias("hi")]


def mantel_haenszel(strata: DataFrame) -> DataFrame:
    """One row: common odds ratio with its interval, and the continuity-corrected chi2, of strata a, b, c, d."""
    s = strata.withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d")).where("n > 1")
    a, b, c, d, n = (F.col(x).cast("double") for x in ("a", "b", "c", "d", "n"))
    r, q_ = a * d / n, b * c / n
    p, q = (a + d) / n, (b + c) / n
    t = s.agg(
        F.sum(r).alias("r"), F.sum(q_).alias("s"), F.sum(p * r).alias("pr"), F.sum(p * q_ + q * r).alias("psqr"), F.sum(q * q_).alias("qs"),
        F.sum(a).alias("a"), F.sum((a + b) * (a + c) / n).alias("ea"), F.sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).alias("va"),
    )
    ratio = F.try_divide("r", "s")
    var = F.try_divide(F.col("pr"), 2 * F.col("r") * F.col("r")) + F.try_divide(F.col("psqr"), 2 * F.col("r") * F.col("s")) + F.try_divide(F.col("qs"), 2 * F.col("s") * F.col("s"))
    off = F.abs(F.col("a") - F.col("ea")) - 0.5
    return t.select(ratio.alias("odds_ratio"), F.exp(F.log(ratio) - Z * F.sqrt(var)).alias("lo"), F.exp(F.log(ratio) + Z * F.sqrt(var)).alias("hi"), F.try_divide(off * off, F.col("va")).alias("chi2"))


def breslow_day(strata: DataFrame) -> DataFrame:
    """One row (chi2, df): homogeneity of the strata's odds ratios around the common one, with exact fitted cells."""
    common = mantel_haenszel(strata).select("odds_ratio")
    s = strata.join(F.broadcast(common)).where("a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0")  # one row
    n1, n2, m, t = F.col("a") + F.col("b"), F.col("c") + F.col("d"), F.col("a") + F.col("c"), F.col("odds_ratio")
    w = n2 - m + t * (n1 + m)
    x = 2 * t * n1 * m / (w + F.sqrt(w * w + 4 * (1 - t) * t * n1 * m))
    v = 1 / (1 / x + 1 / (n1 - x) + 1 / (m - x) + 1 / (n2 - m + x))
    return s.agg(F.sum((F.col("a") - x) * (F.col("a") - x) / v).alias("chi2"), (F.count("*") - 1).alias("df"))


def decomposition(df: DataFrame, flag: Column, group: str, later: Column) -> DataFrame:
    """One row (composition, rate, total): how a share's change splits into changed weights and changed rates of groups."""
    g = df.where(later.isNotNull()).groupBy(group).agg(*[F.count_if(later == F.lit(bool(i))).alias(f"n{i}") for i in (0, 1)], *[F.count_if((later == F.lit(bool(i))) & flag).alias(f"k{i}") for i in (0, 1)])
    every = Window.partitionBy(F.lit(1))
    w = [F.coalesce(F.try_divide(F.col(f"n{i}"), F.sum(f"n{i}").over(every)), F.lit(0.0)) for i in (0, 1)]
    r = [F.coalesce(F.try_divide(F.col(f"k{i}"), F.col(f"n{i}")), F.lit(0.0)) for i in (0, 1)]
    parts = g.select(((w[1] - w[0]) * (r[0] + r[1]) / 2).alias("c"), ((w[0] + w[1]) / 2 * (r[1] - r[0])).alias("r"))
    return parts.agg(F.sum("c").alias("composition"), F.sum("r").alias("rate"), (F.sum("c") + F.sum("r")).alias("total"))


def split_change(cube: np.ndarray) -> dict[str, float]:
    """The same from counts by (time, group, flag): composition, rate and total."""
    size = cube.sum(-1)
    n = size.sum(-1, keepdims=True)
    w, r = np.divide(size, n, out=np.zeros_like(size, float), where=n > 0), np.divide(cube[..., 1], size, out=np.zeros_like(size, float), where=size > 0)
    parts = {"composition": float(((w[1] - w[0]) * (r[0] + r[1]) / 2).sum()), "rate": float(((w[0] + w[1]) / 2 * (r[1] - r[0])).sum())}
    return parts | {"total": sum(parts.values())}


def gini_of(x: np.ndarray, m: np.ndarray) -> float:
    """Gini coefficient of ascending sizes x, m times each."""
    n, before = m.sum(), np.cumsum(m) - m
    return float(2 * (x * (m * before + m * (m + 1) / 2)).sum() / (n * (x * m).sum()) - (n + 1) / n)


def interval(value: str, p: float = 0.95) -> list[Column]:
    """lo and hi of the central percentile interval."""
    return [F.percentile(value, F.lit((1 - p) / 2)).alias("lo"), F.percentile(value, F.lit((1 + p) / 2)).alias("hi")]


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k out of n, within [0, 1]; NULL for n = 0."""
    p = F.try_divide(k, n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    c = (p + F.try_divide(F.lit(z * z), 2 * n)) / d
    h = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) / d
    return F.when(n > 0, F.greatest(c - h, F.lit(0.0))), F.when(n > 0, F.least(c + h, F.lit(1.0)))


def trend(df: DataFrame, x: str, flag: Column) -> DataFrame:
    """One row (z): Cochran-Armitage trend of a share along x, from the counts per x."""
    g = df.where(F.col(x).isNotNull() & flag.isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count("*").alias("n"), F.count_if(flag).alias("k"))
    s = g.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("x") * F.col("k")).alias("xk"), F.sum(F.col("x") * F.col("n")).alias("xn"), F.sum(F.col("x") * F.col("x") * F.col("n")).alias("xxn"))
    p = F.col("k") / F.col("n")
    return s.select(((F.col("xk") - p * F.col("xn")) / F.sqrt(p * (1 - p) * (F.col("xxn") - F.col("xn") * F.col("xn") / F.col("n")))).alias("z"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (h, df): Kruskal-Wallis statistic with tie correction, from the counts of different values per group."""
    cells = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("m"))
    ranks = cells.groupBy(value).agg(F.sum("m").alias("t"))
    ranks = running(ranks, [value], {"upto": "t"}).withColumn("rank", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2)
    by = cells.join(ranks.select(value, "rank"), value).groupBy(group).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("rank")).alias("r"))
    a = by.agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count("*").alias("k"))
    t = ranks.agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    return a.join(F.broadcast(t)).select(((12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))).alias("h"), (F.col("k") - 1).alias("df"))  # one row


def log_odds_contrast(terms: DataFrame, term: str, group: str, a: str, b: str, strength: float = 500.0) -> DataFrame:
    """(term, delta, z): log-odds of terms in group a against b with an informative Dirichlet prior from all groups.

    `terms`: (term, group, n) counts.
    """
    t = terms.groupBy(term).agg(F.sum("n").alias("all"), F.sum(F.when(F.col(group) == a, F.col("n")).otherwise(0)).alias("ya"), F.sum(F.when(F.col(group) == b, F.col("n")).otherwise(0)).alias("yb"))
    s = t.agg(F.sum("all").alias("s"), F.sum("ya").alias("na"), F.sum("yb").alias("nb"))
    t = t.join(F.broadcast(s)).withColumn("alpha", strength * F.col("all") / F.col("s"))  # one row
    ya, yb = F.col("ya") + F.col("alpha"), F.col("yb") + F.col("alpha")
    delta = F.log(ya / (F.col("na") + strength - ya)) - F.log(yb / (F.col("nb") + strength - yb))
    return t.select(term, delta.alias("delta"), (delta / F.sqrt(1 / ya + 1 / yb)).alias("z"))


def cube_fit(cube: np.ndarray, margins: Sequence[tuple[int, ...]], tolerance: float = 1e-10) -> np.ndarray:
    """Expected counts of a small table under the log-linear model with these margins, by proportional fitting."""
    e = np.full(cube.shape, cube.sum() / cube.size)
    for _ in range(10_000):
        before = e
        for keep in margins:
            axes = tuple(i for i in range(cube.ndim) if i not in keep)
            have, want = e.sum(axes, keepdims=True), cube.sum(axes, keepdims=True)
            e = e * np.divide(want, have, out=np.zeros_like(want, float), where=have > 0)
        if np.abs(e - before).max() < tolerance * max(1.0, cube.sum()):
            break
    return e


def deviance(o: np.ndarray, e: np.ndarray) -> float:
    """Likelihood-ratio statistic of observed against expected counts."""
    hit = o > 0
    return float(2 * (o[hit] * np.log(o[hit] / e[hit])).sum())


def replicates(spark, b: int, seed: int, draw: Callable[[np.random.Generator], dict[str, float]], names: Sequence[str]) -> DataFrame:
    """(rep, names): `draw` in each of b replicates, spread over the tasks; each replicate has its own seeded generator."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            rows = [(int(i), *(float(v) for v in draw(np.random.default_rng([seed, int(i)])).values())) for i in ids["id"]]
            yield pd.DataFrame(rows, columns=["rep", *names])

    return spark.range(b).mapInPandas(run, "rep bigint, " + ", ".join(f"{n} double" for n in names))


def statistic(o: np.ndarray) -> float:
    """Pearson's statistic of a table."""
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    return float(((o - e) ** 2 / np.where(e > 0, e, 1)).sum())


def fixed_margin_table(rows: np.ndarray, cols: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A random table with these margins, as permuting the rows' labels would give it."""
    left, out = cols.copy(), []
    for r in rows:
        out.append(rng.multivariate_hypergeometric(left, int(r)))
        left = left - out[-1]
    return np.array(out)


def permutation_p(spark, table: np.ndarray, b: int = 2_000, seed: int = 1) -> DataFrame:
    """One row (statistic, p) with p = (hits + 1) / (b + 1) over tables with the same margins."""
    o = table[table.sum(1) > 0][:, table.sum(0) > 0].astype(np.int64)
    rows, cols, seen = o.sum(1), o.sum(0), statistic(o)
    reps = replicates(spark, b, seed, lambda rng: {"s": statistic(fixed_margin_table(rows, cols, rng))}, ["s"])
    return reps.agg(F.lit(seen).alias("statistic"), ((F.count_if(F.col("s") >= seen - 1e-9) + 1) / (b + 1)).alias("p"))


def bootstrap_shares(spark, counts: dict[str, int], b: int = 2_000, seed: int = 1) -> DataFrame:
    """(name, estimate, lo, hi): percentile intervals of shares. Resampling n rows and counting them is one multinomial draw."""
    names, n = list(counts), np.array(list(counts.values()), float)
    total = int(n.sum())
    cols = [f"s{i}" for i in range(len(names))]
    reps = replicates(spark, b, seed, lambda rng: dict(zip(cols, rng.multinomial(total, n / total) / total)), cols)
    long = reps.unpivot(["rep"], cols, "col", "share")
    known = spark.createDataFrame([(c, x, float(v / total)) for c, x, v in zip(cols, names, n)], "col string, name string, estimate double")
    ci = long.groupBy("col").agg(F.percentile("share", F.lit(0.025)).alias("lo"), F.percentile("share", F.lit(0.975)).alias("hi"))
    return known.join(ci, "col").select("name", "estimate", "lo", "hi")
