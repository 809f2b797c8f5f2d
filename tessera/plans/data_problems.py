"""Queries of the general data problems: nested records (p5) and packed cells (p6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.nested import Child, child_tables
from tessera.operators.packed import JOINED, Profile, split_values
from tessera.plans.registry import Registry
from tessera.session import table
from tessera.sources.sinks import small

REGISTRY = Registry()

RECALL_CHILDREN = [
    Child("products", ("products",), "name"),
    Child("product_sizes", ("products", "sizes"), "label"),
    Child("manufacturercountries", ("manufacturercountries",), "country"),
    Child("remedyoptions", ("remedyoptions",), "option"),
    Child("retailers", ("retailers",), "name"),
]

FIRMS = Profile(legal=True)
OPTIONS = Profile(signs=";|/,\n\r\t+", joiners=("and", "or", "&"))


def countries_profile(spark: SparkSession, sf_dir: str) -> Profile:
    """How cells of countries are cut: joining words cut too, but not those inside a name of the reference list."""
    names = table(spark, sf_dir, "country_reference", ["country_name"]).where(F.col("country_name").rlike("(?i)" + JOINED))
    return Profile(joiners=("and", "or", "&"), names=tuple(sorted(r["country_name"] for r in small(names.distinct()))))


def packed_fields(spark: SparkSession, sf_dir: str) -> dict[str, Profile]:
    return {"retailers": FIRMS, "countries_raw": countries_profile(spark, sf_dir), "remedy_options": OPTIONS, "importers": FIRMS}


def _flat_sql(child: str, path: str, field: str) -> str:
    return f"""SELECT recallid AS recall_id, '{child}' AS child, CAST(-1 AS INTEGER) AS parent_pos, CAST(i - 1 AS INTEGER) AS pos
    FROM (SELECT DISTINCT recallid, {path} FROM cpsc_recalls_all) r, range(1, len(r.{path}) + 1) t(i)
    WHERE trim(r.{path}[i].{field}) <> ''"""


@REGISTRY.query(
    "p5_found",
    " UNION ALL ".join(
        [
            *(_flat_sql(c.name, c.path[0], c.field) for c in RECALL_CHILDREN if len(c.path) == 1),
            """SELECT recallid AS recall_id, 'product_sizes' AS child, CAST(i - 1 AS INTEGER) AS parent_pos, CAST(j - 1 AS INTEGER) AS pos
    FROM (SELECT DISTINCT recallid, products FROM cpsc_recalls_all) r, range(1, len(r.products) + 1) t(i), range(1, len(r.products[i].sizes) + 1) u(j)
    WHERE trim(r.products[i].sizes[j].label) <> ''""",
        ]
    ),
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and places of every child row of a recall."""
    children = child_tables(table(spark, sf_dir, "cpsc_recalls_all"), "recallid", RECALL_CHILDREN, values=False)
    parts = [t.select(F.col("recallid").alias("recall_id"), F.lit(name).alias("child"), "parent_pos", "pos") for name, t in children.items()]
    return reduce(DataFrame.unionByName, parts)


def packed_recalls(spark: SparkSession, sf_dir: str, fields: dict[str, Profile]) -> DataFrame:
    """Values of the packed cells of each recall, repeated rows counted once."""
    cells = table(spark, sf_dir, "apparel_recalls_v2", ["recall_id", *fields]).where("recall_id IS NOT NULL").dropDuplicates(["recall_id"])
    return split_values(cells, ["recall_id"], fields)


@REGISTRY.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every cell that holds at least two."""
    values = packed_recalls(spark, sf_dir, packed_fields(spark, sf_dir))
    return values.where("n_values > 1").select("recall_id", "field", "position", "value")
