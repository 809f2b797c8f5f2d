"""Counts, shares, concentration and calibration over groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.series import running


LEVELS = 100_000  # most levels that a spine is made for


def share(flag: Column) -> Column:
    """The share of rows where a flag holds among those where it isn't NULL."""
    return F.avg(flag.cast("int"))


def spine(df: DataFrame, on: str, lo: int, hi: int, counts: Sequence[str], levels: DataFrame | None = None) -> DataFrame:
    """`df` with a row for every whole number from lo to hi (and every row of `levels`), missing counts being 0.

    The spine is as long as the span times the levels, whatever the size of the data; `df` should be aggregated already.
    """
    base = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias(on))
    keys = [on]
    if levels is not None:
        every = levels.distinct().agg(F.collect_list(F.struct(*levels.columns)).alias("__levels"))
        if (n := every.select(F.size("__levels")).first()[0]) > LEVELS:
            raise ValueError(f"a spine takes {LEVELS} levels at most, these are {n}")
        base, keys = base.join(F.broadcast(every)).select(on, F.inline("__levels")), [on, *levels.columns]  # one row of LEVELS at most
    return base.join(df, keys, "left").na.fill(0, list(counts))


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, n, row_share, col_share, total_share, lift) of every pair of values that occurs; NULL is a value."""
    n = df.groupBy(row, col).agg(F.count("*").alias("n"))
    r, c, t = F.sum("n").over(Window.partitionBy(row)), F.sum("n").over(Window.partitionBy(col)), F.sum("n").over(Window.partitionBy(F.lit(1)))
    return n.select(row, col, "n", (F.col("n") / r).alias("row_share"), (F.col("n") / c).alias("col_share"), (F.col("n") / t).alias("total_share"), (F.col("n") * t / (r * c)).alias("lift"))


def wide(df: DataFrame, row: str, col: str, values: Sequence, agg: Column) -> DataFrame:
    """One column per listed value of `col`; the list is fixed so that the schema doesn't depend on the data."""
    return df.groupBy(row).pivot(col, list(values)).agg(agg).na.fill(0)


def mode_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mode): the most frequent value of each key, ties to the smallest; NULL values don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    first = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m"))
    return first.select(key, F.col("m.v").alias("mode"))


def ranked_sums(sizes: DataFrame, size: str) -> DataFrame:
    """(x, m, before, cumulative): multiplicity of each different size with the entities before it and the sum up to it."""
    counts = sizes.where(F.col(size).isNotNull()).groupBy(F.col(size).alias("x")).agg(F.count("*").alias("m"))
    r = running(counts, ["x"], {"upto": "m", "cumulative": F.col("x") * F.col("m")})
    return r.select("x", "m", (F.col("upto") - F.col("m")).alias("before"), "cumulative")


def gini(sizes: DataFrame, size: str) -> DataFrame:
    """One row (gini): concentration of positive sizes, 0 when all are equal; NULL for an empty table."""
    s = ranked_sums(sizes, size)
    # sum of i * x over the ranks of one size: m * before + m (m + 1) / 2
    weighted = F.sum(F.col("x") * (F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2))
    n, total = F.sum("m"), F.sum(F.col("x") * F.col("m"))
    return s.agg((2 * weighted / (n * total) - (n + 1) / n).alias("gini"))


def lorenz(sizes: DataFrame, size: str) -> DataFrame:
    """(p, l): the Lorenz curve at its corners, with the origin."""
    s = ranked_sums(sizes, size)
    t = s.agg(F.sum("m").alias("n"), F.sum(F.col("x") * F.col("m")).alias("total"))
    points = s.join(F.broadcast(t)).select(((F.col("before") + F.col("m")) / F.col("n")).alias("p"), (F.col("cumulative") / F.col("total")).alias("l"))  # one row
    return points.union(points.sparkSession.createDataFrame([(0.0, 0.0)], "p double, l double"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 8) -> DataFrame:
    """(bin, n, predicted, observed): rows in right-closed quantile bins of `p`; NULL predictions or outcomes are left out."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    edges = rows.agg(F.percentile(p, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("edges"))
    below = F.size(F.filter("edges", lambda e: e < F.col(p)))
    return rows.join(F.broadcast(edges)).groupBy(below.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))  # one row


def expected_calibration_error(table: DataFrame) -> DataFrame:
    """One row (ece) of a calibration table."""
    return table.agg((F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))) / F.sum("n")).alias("ece"))


def by_score(df: DataFrame, y: str, p: str) -> DataFrame:
    """(s, m, pos): rows and positives of each different score."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(p).alias("s")).agg(F.count("*").alias("m"), F.sum(F.col(y).cast("int")).alias("pos"))


def ranking_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row (auc, average_precision): by midranks and by steps over descending ties; NULL without both classes."""
    s = running(by_score(df, y, p), ["s"], {"m_upto": "m", "pos_upto": "pos"})
    t = s.agg(F.sum("m").alias("m_all"), F.sum("pos").alias("pos_all"))
    s = s.join(F.broadcast(t)).select(  # one row
        "*", (F.col("m_upto") - F.col("m") + (F.col("m") + 1) / 2).alias("midrank"),
        (F.col("m_all") - F.col("m_upto") + F.col("m")).alias("seen"), (F.col("pos_all") - F.col("pos_upto") + F.col("pos")).alias("hits"),
    )
    pos, n = F.sum("pos"), F.sum("m")
    auc = F.try_divide(F.sum(F.col("pos") * F.col("midrank")) - pos * (pos + 1) / 2, pos * (n - pos))
    return s.agg(auc.alias("auc"), F.try_divide(F.sum(F.col("pos") * F.col("hits") / F.col("seen")), pos).alias("average_precision"))


def midranks(df: DataFrame, value: str) -> DataFrame:
    """(value, m, midrank) of each different value; join it back by value to rank rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("m"))
    r = running(counts, [value], {"__upto": "m"})
    return r.select(value, "m", (F.col("__upto") - F.col("m") + (F.col("m") + 1) / 2).alias("midrank"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns."""
    return reduce(DataFrame.unionByName, parts)
