"""Streaming variants of the event tables: windowed counts with late data, and per-entity prior counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n, total): events per tumbling window; events later than `late` behind the newest are dropped."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counts = timed.groupBy(F.window(time, window), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), key, "n", "total")


def prior_counts(stream: DataFrame, key: str, event: str) -> DataFrame:
    """(key, event, prior): how many events of the key came before, kept as state per key."""
    types = dict(stream.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for b in batches:
            b = b.sort_values(event)
            yield pd.DataFrame({key: b[key], event: b[event], "prior": range(seen, seen + len(b))})
            seen += len(b)
        state.update((seen,))

    return stream.select(key, event).groupBy(key).applyInPandasWithState(step, f"`{key}` {types[key]}, `{event}` {types[event]}, prior bigint", "seen bigint", "append", "NoTimeout")
