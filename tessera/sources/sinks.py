"""Writing results: parquet with an optional CSV, JSON and Markdown of small results."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LIMIT = 10_000


def write_table(df: DataFrame, path: str, csv: bool = False) -> None:
    """Write a result as parquet, and as CSV with a header beside it on request."""
    df.write.mode("overwrite").parquet(path)
    if csv:
        df.write.mode("overwrite").option("header", True).csv(path + ".csv")


def small(df: DataFrame) -> list:
    """The rows of a small result, whose number is checked."""
    rows = df.take(LIMIT + 1)
    if len(rows) > LIMIT:
        raise ValueError(f"a report holds {LIMIT} rows at most; write a table instead")
    return rows


def plain(value):
    """JSON-ready form of a value: NaN and infinities become null, dates and decimals text."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file through the session's file systems, so that a path means the same here as in any query."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_json(df: DataFrame, path: str) -> None:
    """Write a small result as one JSON array."""
    write_text(df.sparkSession, path, json.dumps([plain(r.asDict(True)) for r in small(df)], ensure_ascii=False, allow_nan=False))


def markdown(df: DataFrame, formats: dict[str, Callable] | None = None) -> str:
    """A small result as a Markdown table, values formatted by column; NULL is blank."""
    formats = formats or {}
    show = lambda c, v: "" if v is None else str(formats.get(c, str)(v)).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(c, r[c]) for c in df.columns) + " |" for r in small(df)])
