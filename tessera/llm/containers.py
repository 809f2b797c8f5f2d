"""Filling containers of fixed capacity: dominance reduction of the sizes, then best fit of what remains."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize


@dataclass
class Plan:
    """Container contents as (sizes, times): each tuple of sizes is used for that many containers."""

    capacity: int
    patterns: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    reduced: int = 0  # how many of the containers the dominance reduction fixed

    @property
    def containers(self) -> int:
        return sum(m for _, m in self.patterns)


def _largest(sizes: list[int], at_most: int) -> int | None:
    i = bisect_right(sizes, at_most)
    return sizes[i - 1] if i else None


def _dominating(j: int, left: dict[int, int], sizes: list[int], room: int) -> tuple[int, ...] | None:
    """Sizes that may be put beside `j` with no loss, or None where no such set is proven.

    Set A dominates set B if B's sizes can be spread over A's so that none is exceeded; then some best packing holds A.
    `left` and `sizes` are what is unplaced besides one item of size `j`.
    """
    if not sizes or sizes[0] > room:
        return ()
    k = _largest(sizes, room)
    if k == room:
        return (k,)
    smallest = [s for s in sizes[:3] for _ in range(min(3, left[s]))][:3]
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (k,)  # only one more item fits, and this is the largest
    if len(smallest) > 2 and sum(smallest[:3]) <= room:
        return None
    # at most two more items fit: all maximal pairs
    best: list[tuple[int, int]] = []
    for a in reversed(sizes):
        if a > room - smallest[0]:
            continue
        b = _largest(sizes, min(a, room - a))
        if b == a and left[a] < 2:
            i = sizes.index(a)
            b = sizes[i - 1] if i else None
        if b is None:
            continue
        if a + b == room:
            return (a, b) if a >= k or _covers((a, b), best, k) else None
        if not best or b > best[-1][1]:
            best.append((a, b))
    if all(a + b <= k for a, b in best):
        return (k,)
    if len(best) == 1 and best[0][0] >= k:
        return best[0]
    return None


def _covers(pair: tuple[int, int], others: list[tuple[int, int]], single: int) -> bool:
    a, b = pair
    return single <= a and all(x <= a and y <= b for x, y in others)


def plan_containers(counts: dict[int, int], capacity: int) -> Plan:
    """A plan for `counts` items of each size from 1 to `capacity`.

    Items of one size are placed together, so that the work follows the number of different sizes, which the capacity
    bounds, and not the number of items.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    plan = Plan(capacity)

    def take(pattern: tuple[int, ...], times: int) -> None:
        for s in pattern:
            left[s] -= times
        for s in set(pattern):
            if not left[s]:
                del left[s]
        plan.patterns.append((pattern, times))

    fixed = -1
    while fixed < plan.containers:  # what one pass fixes may let the next one prove more
        fixed = plan.containers
        for j in sorted(left, reverse=True):
            while j in left:
                rest = dict(left)
                rest[j] -= 1
                if not rest[j]:
                    del rest[j]
                beside = _dominating(j, rest, sorted(rest), capacity - j)
                if beside is None:
                    break
                pattern = (j, *beside)
                take(pattern, min(left[s] // pattern.count(s) for s in pattern))
    plan.reduced = plan.containers

    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # sorted rooms with open containers

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_[room].append((pattern, times))

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            i = bisect_right(rooms, s - 1)
            if i == len(rooms):
                each = capacity // s
                if n // each:
                    put(capacity - each * s, (s,) * each, n // each)
                if n % each:
                    put(capacity - n % each * s, (s,) * (n % each), 1)
                break
            room = rooms[i]
            pattern, times = open_[room].pop()
            used = min(times, n)
            if times > used:
                open_[room].append((pattern, times - used))
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            put(room - s, (*pattern, s), used)
            n -= used
    for room in open_:
        plan.patterns += open_[room]
    return plan


def pack(items: DataFrame, keys: list[str], size: str, capacity: int) -> tuple[DataFrame, Plan]:
    """(keys, piece, size, container), where each item goes, and the plan of the containers.

    `keys` identify an item. An item larger than the capacity is cut into full containers of its own and one rest that is
    packed like an item (pieces count from 0); no other item is cut. NULL and non-positive sizes take no room: they go to
    container 0. Equal items are told apart by their keys' order, so repeated rows and ties are placed one by one. An empty
    table gives an empty result. The plan is made from the counts of the sizes, at most `capacity` numbers; items of one
    size are numbered in salted groups, so that a size which a third of all items share is spread over all tasks.
    """
    spark = items.sparkSession
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    full = F.floor(n / capacity).cast("int")
    cut = F.concat(
        F.transform(F.when(full > 0, F.sequence(F.lit(0), full - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("piece"), F.lit(capacity).cast("bigint").alias("size"))),
        F.when((n % capacity > 0) | (n == 0), F.array(F.struct(full.alias("piece"), (n % capacity).alias("size")))).otherwise(F.array().cast("array<struct<piece:int,size:bigint>>")),
    )
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = items.select(*keys, F.inline(cut)).withColumn("salt", F.pmod(F.xxhash64(*keys, "piece"), F.lit(salts)).cast("int"))
    pieces = materialize(pieces, "pieces")
    groups = pieces.groupBy("size", "salt").agg(F.count("*").alias("m"))
    plan = plan_containers({r["size"]: r["m"] for r in groups.where("size > 0").groupBy("size").agg(F.sum("m").alias("m")).toLocalIterator()}, capacity)

    slots: dict[int, list[tuple[int, int, int]]] = {}  # size -> (first rank, items per container, first container)
    base, used = 0, {}
    for pattern, times in plan.patterns:
        for s in dict.fromkeys(pattern):
            k = pattern.count(s)
            slots.setdefault(s, []).append((used.get(s, 0), k, base))
            used[s] = used.get(s, 0) + k * times
        base += times
    table = {s: np.array(v, np.int64).T for s, v in slots.items()}
    handle = spark.sparkContext.broadcast(table)  # bounded by the plan, which the capacity bounds

    before = F.coalesce(F.sum("m").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = groups.select("size", "salt", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy(*keys, "piece")) - 1
    ranked = pieces.where("size > 0").select("*", rank.alias("r")).join(offsets, ["size", "salt"]).withColumn("rank", F.col("r") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, ranks = b.column("size").to_numpy(), b.column("rank").to_numpy()
            out = np.zeros(len(sizes), np.int64)
            for s in np.unique(sizes):
                first, each, start = handle.value[int(s)]
                at = np.flatnonzero(sizes == s)
                i = np.searchsorted(first, ranks[at], side="right") - 1
                out[at] = start[i] + (ranks[at] - first[i]) // each[i]
            yield pa.RecordBatch.from_arrays([*b.select([*keys, "piece", "size"]).columns, pa.array(out)], names=[*keys, "piece", "size", "container"])

    types = dict(pieces.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "piece int, size bigint, container bigint"])
    placed = ranked.select(*keys, "piece", "size", "rank").mapInArrow(place, schema)
    return placed.unionByName(pieces.where("size = 0").select(*keys, "piece", "size", F.lit(0).cast("bigint").alias("container"))), plan
