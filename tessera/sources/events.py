"""The event tables: nested raw events, cleaned events, exposure, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import table

_NAMED = T.ArrayType(T.StructType([T.StructField("Name", T.StringType())]))
RAW_EVENT = T.StructType(
    [
        T.StructField("RecallID", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("RecallNumber", "RecallDate", "Title", "Description", "URL")],
        T.StructField("Products", T.ArrayType(T.StructType([T.StructField("Name", T.StringType()), T.StructField("NumberOfUnits", T.StringType())]))),
        *[T.StructField(n, _NAMED) for n in ("Hazards", "Injuries", "Retailers", "Remedies", "Importers", "Manufacturers", "Distributors")],
        T.StructField("RemedyOptions", T.ArrayType(T.StructType([T.StructField("Option", T.StringType())]))),
        T.StructField("ManufacturerCountries", T.ArrayType(T.StructType([T.StructField("Country", T.StringType())]))),
    ]
)
EXPOSURE = T.StructType([T.StructField("Country", T.StringType()), T.StructField("Year", T.IntegerType()), T.StructField("DATA_VALUE", T.DoubleType())])


def read_raw_events(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested events from a JSON array file or folder of such files (a leading byte-order mark is skipped); no inference.

    An array can only be read from its beginning, so each such file is one task. With `lines`, every line is an event, and
    files of any size are split over all tasks: large collections should come this way, or as a folder of many files.
    """
    return spark.read.schema(RAW_EVENT).option("multiLine", not lines).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header, by an explicit schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any file system that the session knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def read_first(spark: SparkSession, candidates: list[tuple[str, str]]) -> DataFrame:
    """The first existing parquet source of (version, path), with its version in `source_version`."""
    for version, path in candidates:
        if exists(spark, path):
            return spark.read.parquet(path).withColumn("source_version", F.lit(version))
    raise FileNotFoundError(f"none of {[p for _, p in candidates]} exists")


def enriched(events: DataFrame, extra: DataFrame | None, key: str, suffix: str = "_extra") -> DataFrame:
    """`events` with the columns of an optional source; clashing names get the suffix, repeated keys count once."""
    if extra is None:
        return events
    once = extra.dropDuplicates([key])
    renamed = once.select(F.col(key), *[F.col(c).alias(c + suffix if c in events.columns else c) for c in once.columns if c != key])
    return events.join(renamed, key, "left")


def _names(array: Column, field: str) -> Column:
    return F.filter(F.transform(F.coalesce(array, F.array()), lambda x: F.trim(x[field])), lambda v: F.coalesce(v != "", F.lit(False)))


def flat_events(raw: DataFrame) -> DataFrame:
    """One flat row per nested event: names joined by ` | `, distinct options and countries in order joined by `;`."""
    joined = lambda c, f, alias: F.array_join(_names(F.col(c), f), " | ").alias(alias)
    listed = lambda c, f, alias: F.array_join(F.array_sort(F.array_distinct(_names(F.col(c), f))), ";").alias(alias)
    return raw.select(
        F.col("recallid").alias("recall_id"), F.col("recallnumber").alias("recall_number"), F.substring("recalldate", 1, 10).alias("recall_date"),
        F.substring("recalldate", 1, 4).try_cast("int").alias("year"), "title", "description", "url",
        joined("products", "name", "products"), joined("hazards", "name", "hazard_text"), joined("injuries", "name", "injury_text"),
        joined("retailers", "name", "retailers"), joined("remedies", "name", "remedy_text"), joined("importers", "name", "importers"),
        joined("manufacturers", "name", "manufacturers"), joined("distributors", "name", "distributors"),
        listed("remedyoptions", "option", "remedy_options"), listed("manufacturercountries", "country", "countries"),
    )


def rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Cleaned events as sent, repeats included: for queries that reduce them to short columns before `once`."""
    return table(spark, sf_dir, "apparel_recalls_v2", list(dict.fromkeys(["recall_id", *columns])))


def once(df: DataFrame, key: str = "recall_id") -> DataFrame:
    """Each event once; events that are sent again are unchanged, and so are the columns made of them."""
    return df.dropDuplicates([key])


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Cleaned events, each once; only the given columns are read."""
    return once(rows(spark, sf_dir, *columns))


def raw_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Nested events, each once."""
    return table(spark, sf_dir, "cpsc_recalls_all", list(dict.fromkeys(["recallid", *columns]))).dropDuplicates(["recallid"])


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, year, volume, value): both exposure files summed by key and joined in full.

    NULL names and technical names (with a leading underscore) are left out; names are trimmed; a key that only one file has
    keeps NULL for the other. The `World` control rows stay.
    """

    def one(name: str, alias: str) -> DataFrame:
        rows = table(spark, sf_dir, name, ["country", "year", "data_value"]).where("country IS NOT NULL AND year IS NOT NULL")
        rows = rows.select(F.trim("country").alias("country"), "year", "data_value").where(~F.col("country").startswith("_"))
        return rows.groupBy("country", "year").agg(F.sum("data_value").alias(alias))

    return one("exposure_volume", "volume").join(one("exposure_value", "value"), ["country", "year"], "full")
