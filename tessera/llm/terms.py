"""Terms of records: how often they occur, and how distinctive they are of a record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

TERM = r"[a-z][a-z\-]+"


def record_terms(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, terms): of each record once, its distinct terms with their counts, as array<struct<term, tf>>.

    Repeated rows of a key count once; rows with a NULL key are left out, as they are no identifiable record. The rows are
    reduced by key before they are shuffled, so a key that holds many rows doesn't gather them in one task. A record of
    NULL or empty fields, or without a term, has an empty array. Other columns are not read, whatever their names.
    """
    text = F.concat_ws(" ", *[F.col(f).cast("string") for f in fields])
    one = df.where(F.col(key).isNotNull()).select(F.col(key), text.alias("__text")).dropDuplicates([key])
    terms = F.sort_array(F.regexp_extract_all(F.lower("__text"), F.lit(TERM), F.lit(0)))
    counted = one.select(key, _let(terms, lambda s: F.struct(F.size(s).alias("n"), _runs(s).alias("runs"))).alias("__c"))
    # the generator keeps the optimizer from evaluating the counts once per reference
    return counted.select(key, F.inline(F.array("__c"))).select(key, F.col("runs").alias("terms"), F.col("n").alias("n_terms"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(s: Column) -> Column:
    """Distinct terms of a sorted array with the lengths of their runs."""
    first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    return _let(
        first,
        lambda at: F.transform(
            at, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).cast("bigint").alias("tf"))
        ),
    )


def term_frequencies(df: DataFrame, key: str, fields: list[str], min_records: int = 4, max_share: float = 0.6) -> DataFrame:
    """(term, n_total, n_records, mark): every distinct term with its bounds' mark.

    mark is `rare` for terms in fewer than `min_records` records, `common` for terms in more than `max_share` of all records
    (rare wins where both hold, as in tiny collections), else NULL. Per-record counts are combined by hash on the map side,
    so that only distinct terms are shuffled, however frequent one of them is. An empty table gives no rows.
    """
    n = df.agg(F.count_distinct(key)).first()[0]
    counts = record_terms(df, key, fields).select(F.inline("terms")).groupBy("term").agg(F.sum("tf").alias("n_total"), F.count("*").alias("n_records"))
    mark = F.when(F.col("n_records") < min_records, "rare").when(F.col("n_records") > max_share * n, "common")
    return counts.select("term", "n_total", "n_records", mark.alias("mark"))


def distinctive_terms(df: DataFrame, key: str, fields: list[str], min_tf: int = 1, min_records: int = 1, max_share: float = 1.0) -> DataFrame:
    """(key, term, tf, n_records, score): tf/length times ln((1+N)/(1+df))+1 of each term of each record.

    Record counts come from distinct term-record rows, summed on the map side, and are joined back by term to the rows that
    pass `min_tf`. Terms in fewer than `min_records` records or in more than `max_share` of all give no row; with the
    defaults every term of every record has one. Ties keep equal scores. Empty tables and records without terms give none.
    """
    n = df.agg(F.count_distinct(key)).first()[0]
    terms = materialize(record_terms(df, key, fields), "terms")
    counts = terms.select(F.inline("terms")).groupBy("term").agg(F.count("*").alias("n_records"))
    counts = counts.where((F.col("n_records") >= min_records) & (F.col("n_records") <= max_share * n))
    kept = F.filter("terms", lambda t: t["tf"] >= min_tf)
    rows = terms.select(key, "n_terms", kept.alias("terms")).where(F.size("terms") > 0).select(key, "n_terms", F.inline("terms"))
    score = F.col("tf") / F.col("n_terms") * (F.log((1.0 + n) / (1.0 + F.col("n_records"))) + 1.0)
    return rows.join(counts, "term").select(key, "term", "tf", "n_records", score.alias("score"))
