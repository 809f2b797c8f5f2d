"""Ordered analytics over time series and per-entity sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(order: str, by: Sequence[str] = ()):
    """A window over the series of each key; without keys it runs over one aggregated series."""
    return Window.partitionBy(*(by or [F.lit(1)])).orderBy(order)


def running(df: DataFrame, order: Sequence[str], sums: dict[str, str | Column]) -> DataFrame:
    """`df` with running totals over the whole table in `order`, spread over all tasks.

    `sums` maps new columns to what they add up. The rows are split into ranges of the order; each range is summed on its own
    and starts from the total of the ranges before it, of which there are as many as shuffle partitions. So no task sees more
    than one range, and a key that holds many rows spans several. The ranges are written once, so that a recomputation can't
    split them differently. Rows that are equal in `order` are numbered in any order.
    """
    from tessera.session import materialize

    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    valued = df.withColumns({f"__{c}": v if isinstance(v, Column) else F.col(v) for c, v in sums.items()})
    placed = materialize(valued.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("__range").agg(*[F.sum(f"__{c}").alias(f"__{c}_t") for c in sums])
    before = Window.partitionBy(F.lit(1)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *[F.coalesce(F.sum(f"__{c}_t").over(before), F.lit(0)).alias(f"__{c}_b") for c in sums])
    local = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "__range")  # one row per range
    return out.select(*df.columns, *[(F.col(f"__{c}_b") + F.sum(f"__{c}").over(local)).alias(c) for c in sums])


def centred_mean(value: str, order: str, half: int, by: Sequence[str] = ()) -> Column:
    """Mean over `half` rows on either side, NULL where the frame isn't full; rows must be dense in `order`."""
    w = ordered(order, by).rowsBetween(-half, half)
    return F.when(F.count(value).over(w) == 2 * half + 1, F.avg(value).over(w))


def centred_ratio(num: str, den: str, order: str, half: int, by: Sequence[str] = ()) -> Column:
    """Ratio of sums over a centred frame that is cut at the ends of the series."""
    w = ordered(order, by).rowsBetween(-half, half)
    return F.try_divide(F.sum(num).over(w), F.sum(den).over(w))


def suspect_repeats(df: DataFrame, year: str, value: str, tolerance: float = 0.001) -> DataFrame:
    """(year, previous, value, change): years whose value hardly differs from the year before; NULL and 0 are skipped."""
    w = ordered(year)
    before = F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag(value).over(w))
    out = df.select(year, before.alias("previous"), value).withColumn("change", F.abs(F.try_divide(F.col(value) - F.col("previous"), F.col("previous"))))
    return out.where(F.col("change") < tolerance)


def prior_events(df: DataFrame, key: str, date: str, tie: str) -> DataFrame:
    """`df` with `prior`: how many earlier rows its key has, in order of date (NULL last) and `tie`; a NULL key has none.

    Rows are numbered through in order of key, date and tie, and the first number of each key is taken off, so that a key
    with a third of all rows is spread over several tasks.
    """
    known = df.where(F.col(key).isNotNull()).withColumn("__undated", F.col(date).isNull())
    numbered = running(known, [key, "__undated", date, tie], {"__i": F.lit(1)})
    first = numbered.groupBy(key).agg(F.min("__i").alias("__first"))
    known = numbered.join(first, key).withColumn("prior", F.col("__i") - F.col("__first")).select(*df.columns, "prior")
    return known.unionByName(df.where(F.col(key).isNull()).withColumn("prior", F.lit(0)))


def elbow(gains: DataFrame, k: str, value: str, share: float = 0.1) -> DataFrame:
    """One row (k): the smallest k after which the value rises by less than `share` of its largest rise."""
    w = ordered(k)
    steps = gains.withColumn("gain", F.lead(value).over(w) - F.col(value)).withColumn("most", F.max("gain").over(Window.partitionBy(F.lit(1))))
    return steps.where(F.col("gain") < share * F.col("most")).agg(F.min(k).alias(k))


def first_peak(scores: DataFrame, k: str, value: str, tolerance: float = 0.005) -> DataFrame:
    """One row (k): the last k of the climb from the smallest one, a fall within the tolerance being no end."""
    w = ordered(k)
    stop = F.coalesce(F.col(value) < F.lag(value).over(w) - tolerance, F.lit(False)).cast("int")
    climb = scores.withColumn("stopped", stop).withColumn("stopped", F.max("stopped").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return climb.where("stopped = 0").agg(F.max_by(k, F.struct(F.col(value), -F.col(k))).alias(k))


def crossings(df: DataFrame, order: str, value: str, level: float) -> DataFrame:
    """(order, direction): where the series crosses a level, `up` or `down`."""
    side = F.signum(F.col(value) - level)
    before = F.lag(side).over(ordered(order))
    return df.select(order, F.when((before < 0) & (side >= 0), "up").when((before > 0) & (side <= 0), "down").alias("direction")).where("direction IS NOT NULL")
