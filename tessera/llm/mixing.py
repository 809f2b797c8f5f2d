"""Drawing records so that each source contributes its target share of the total size, by pivotal rounding."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

BLOCK = 20_000  # fractional records that one task rounds in a row


def source_key(source: Column) -> Column:
    """A source's name without case, outer blanks and the kind of its separators."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_")


def pivotal(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round the probabilities so that every expectation and the sum of size * p stay; at most one stays fractional.

    Two fractional records are paired; mass moves from one to the other, in a direction drawn so that neither's expectation
    changes, until one is 0 or 1; the other goes on to the next pair.
    """
    p = p.copy()
    draws = rng.random(len(p))
    i = -1
    for j in np.flatnonzero((p > 0) & (p < 1)):
        if i < 0:
            i = j
            continue
        up = min((1 - p[i]) * size[i], p[j] * size[j])  # mass that can move from j to i
        down = min(p[i] * size[i], (1 - p[j]) * size[j])
        if draws[j] * (up + down) < down:
            new_i, new_j = p[i] + up / size[i], p[j] - up / size[j]
        else:
            new_i, new_j = p[i] - down / size[i], p[j] + down / size[j]
        p[i], p[j] = (0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x for x in (new_i, new_j))
        if not 0 < p[i] < 1:
            i = j if 0 < p[j] < 1 else -1
    return p


def mix(docs: DataFrame, key: str, targets: DataFrame, total: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Copies per record, and the report per source.

    `docs`: key, source, tokens; `targets`: source, target_share, max_repeats (a short list, read by the driver). Sources are
    compared by `source_key`. The first result is (key, source, tokens, copies) of every record of a source with a target;
    the second (source, target_share, max_repeats, tokens_available, tokens_drawn, actual_share, most_copies) of every
    target. No record is used more than max_repeats times. Without `total`, the largest total is drawn at which every target
    whose source has tokens can be met, so the source that is smallest for its target and its cap decides how much is drawn of
    all; a larger `total` uses more of the others and leaves that source at its cap, short of its share; the shares of absent sources go to the others in proportion and are reported with 0.
    Records of other or NULL sources are left out; records without tokens get no copy. Empty tables give no copies.
    """
    spark = docs.sparkSession
    want = {}
    for r in targets.select(source_key(F.col("source")).alias("s"), "target_share", "max_repeats").collect():
        if r["s"] is not None and (r["target_share"] or 0) > 0:
            share, most = want.get(r["s"], (0.0, 0))
            want[r["s"]] = (share + r["target_share"], max(most, r["max_repeats"] or 1))
    rows = docs.select(F.col(key), source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).alias("tokens"))
    rows = rows.where(F.col("source").isin(list(want)))
    have = {r["source"]: (r["n"], r["t"]) for r in rows.groupBy("source").agg(F.count_if(F.col("tokens") > 0).alias("n"), F.sum("tokens").alias("t")).collect()}
    present = {s: want[s] for s in want if have.get(s, (0, 0))[1]}
    scale = sum(share for share, _ in present.values()) or 1.0
    if total is None:
        total = min((most * have[s][1] * scale / share for s, (share, most) in present.items()), default=0.0)
    rate = {s: min(float(most), total * share / scale / have[s][1]) for s, (share, most) in present.items()}
    blocks = {s: max(1, -(-have[s][0] // BLOCK)) for s in present}

    def of(values: dict, kind: str) -> Column:
        return reduce(lambda c, s: c.when(F.col("source") == s, F.lit(values[s])), values, F.when(F.lit(False), F.lit(None).cast(kind)))

    drawn = rows.withColumn("rate", F.when(F.col("tokens") > 0, F.coalesce(of(rate, "double"), F.lit(0.0))).otherwise(0.0))
    drawn = drawn.withColumn("base", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    drawn = drawn.withColumn("block", F.pmod(F.xxhash64(key), F.coalesce(of(blocks, "int"), F.lit(1))).cast("int"))

    types = dict(drawn.dtypes)
    schema = f"`{key}` {types[key]}, source string, tokens bigint, base int, p double, block int"

    def rounded(level: int):
        def run(block: pd.DataFrame) -> pd.DataFrame:
            # the largest first, so that what stays fractional at the end is small
            block = block.sort_values(["tokens", key], ascending=[False, True], kind="stable")
            name = f"{seed}/{level}/{block['source'].iloc[0]}/{block['block'].iloc[0]}"
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
            block["p"] = pivotal(block["tokens"].to_numpy(np.float64), block["p"].to_numpy(np.float64), rng)
            return block

        return run

    # the reduction tree: each level leaves at most one fractional record per block
    open_ = drawn.select(key, "source", "tokens", "base", "p", "block")
    whole, level, width = [], 0, max(blocks.values(), default=1)
    while True:
        done = materialize(open_.groupBy("source", "block").applyInPandas(rounded(level), schema), f"level{level}")
        if width == 1:
            whole.append(done)
            break
        whole.append(done.where("p = 0 OR p = 1"))
        open_ = done.where("p > 0 AND p < 1").withColumn("block", F.floor(F.col("block") / 1000).cast("int"))
        width, level = -(-width // 1000), level + 1
    every = reduce(DataFrame.unionByName, whole)
    # the last fractional record of a source is drawn on its own
    coin = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.col("base") + F.when(F.col("p") == 1, 1).when(F.col("p") == 0, 0).otherwise((coin < F.col("p")).cast("int"))).cast("int")
    result = materialize(every.select(key, "source", "tokens", copies.alias("copies")), "mix")

    got = result.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_drawn"), F.max("copies").alias("most_copies"), F.sum("tokens").alias("tokens_available"))
    named = spark.createDataFrame([(s, share, most) for s, (share, most) in sorted(want.items())], "source string, target_share double, max_repeats int")
    report = named.join(got, "source", "left").na.fill(0, ["tokens_drawn", "most_copies", "tokens_available"])
    sum_drawn = result.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 1
    report = report.select(
        "source", "target_share", "max_repeats", "tokens_available", "tokens_drawn", (F.col("tokens_drawn") / float(sum_drawn)).alias("actual_share"), "most_copies"
    )
    return result, report
