"""Flattening of deeply nested records into child tables that keep the places of all their ancestors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


@dataclass(frozen=True)
class Child:
    """One target table: the elements of the last array of `path`, of which each entry lies in the elements of the one before."""

    name: str
    path: tuple[str, ...]
    field: str


def _rows(spec: Child, values: bool) -> Column:
    """Array of (ancestors, pos[, value]) of one record, NULL objects and blank values left out."""
    if not spec.path:
        raise ValueError("a child needs the path of an array")

    def walk(array: Column, depth: int, ancestors: Column) -> Column:
        held = F.coalesce(array, F.array())
        if depth == len(spec.path) - 1:
            return F.transform(held, lambda x, i: F.struct(ancestors.alias("ancestors"), i.cast("int").alias("pos"), x[spec.field].alias("value")))
        return F.flatten(F.transform(held, lambda x, i: walk(x[spec.path[depth + 1]], depth + 1, F.concat(ancestors, F.array(i.cast("int"))))))

    named = F.filter(walk(F.col(spec.path[0]), 0, F.array().cast("array<int>")), lambda r: F.coalesce(F.trim(r["value"]) != "", F.lit(False)))
    return named if values else F.transform(named, lambda r: F.struct(r["ancestors"], r["pos"]))


def child_tables(df: DataFrame, key: str, specs: list[Child], values: bool = True) -> dict[str, DataFrame]:
    """The related flat tables of `specs` by name, each with (key, ancestors, parent_pos, pos[, value]).

    Positions are 0-based places in the array as stored. `ancestors` holds the places of all enclosing elements, the outermost
    first, for paths of any depth; parent_pos is the last of them, or -1 when the array hangs directly on the record. NULL and
    empty arrays, NULL objects, objects without the field and blank values give no row (positions of the others are
    unaffected). Records sent several times count once, by `key`; records with a NULL key have no identity to point to and
    give no rows. Columns that no path begins with are not read, whatever their names. An empty table gives empty tables.

    One projection makes the rows of all targets as arrays, beside the key; repeats are removed from these, in one shuffle
    with partial aggregation; the result is kept in the shared folder, and one `inline` per target emits its rows.
    """
    arrays = [_rows(s, values).alias(f"__rows{i}") for i, s in enumerate(specs)]
    slim = materialize(df.where(F.col(key).isNotNull()).select(F.col(key), *arrays).dropDuplicates([key]), "nested")
    parent = F.coalesce(F.get("ancestors", F.size("ancestors") - 1), F.lit(-1)).alias("parent_pos")
    out = {}
    for i, s in enumerate(specs):
        rows = slim.select(key, F.inline(f"__rows{i}"))
        out[s.name] = rows.select(key, "ancestors", parent, *[c for c in rows.columns if c not in (key, "ancestors")])
    return out
