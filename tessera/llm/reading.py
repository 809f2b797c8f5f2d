"""Reading level of documents: graded examples propagated over the graph of documents and words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

FOLDS = 4  # held-out groups of graded documents, from which the level boundaries are read
BINS = 2_000  # score bins of the boundaries' histogram
CLAMP = 20.0  # weight of a graded document against an ungraded one


def _edges(docs: DataFrame, slots: int) -> DataFrame:
    """(doc_id, label, fold, slots, weights): each document's word nodes with edge weights that sum to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("slots")
            starts = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]].astype(np.int64)
            n = np.diff(starts)
            pair, count = np.unique(np.repeat(np.arange(len(n)), n) * slots + flat, return_counts=True)
            doc, weight = pair // slots, np.sqrt(count)
            weight /= np.maximum(np.bincount(doc, weight, len(n)), 1e-12)[doc]
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))]).astype(np.int32))
            cols = [b.column("doc_id"), b.column("label"), b.column("fold")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.ListArray.from_arrays(at, pa.array((pair % slots).astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(weight.astype(np.float32)))],
                names=["doc_id", "label", "fold", "slots", "weights"],
            )

    return docs.mapInArrow(run, "doc_id bigint, label double, fold int, slots array<int>, weights array<float>")


def _arrays(b: pa.RecordBatch):
    lists = b.column("slots")
    starts = lists.offsets.to_numpy().astype(np.int64)
    slot = lists.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    weight = b.column("weights").values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]].astype(np.float64)
    doc = np.repeat(np.arange(b.num_rows), np.diff(starts))
    label = b.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
    return doc, slot, weight, label, b.column("fold").to_numpy(zero_copy_only=False)


def _scores(b, words: np.ndarray, strength: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Document scores under each of the FOLDS + 1 word tables, and the same with graded documents clamped.

    Column f leaves fold f's grades out; the last column uses all. A document is the mean of its words by edge weight.
    """
    doc, slot, weight, label, fold = b
    n = len(label)
    free = np.full((n, FOLDS + 1), mean)
    for f in range(FOLDS + 1):
        w = weight * strength[slot, f]
        den = np.bincount(doc, w, n)
        free[:, f] = np.where(den > 0, np.bincount(doc, w * words[slot, f], n) / np.maximum(den, 1e-12), mean)
    clamped = free.copy()
    for f in range(FOLDS + 1):
        held = ~np.isnan(label) & (fold != f)
        clamped[held, f] = label[held]
    return free, clamped


def reading_levels(
    docs: DataFrame, labels: DataFrame, rounds: int = 30, tolerance: float = 2e-3, slots: int = 1 << 16, warm: int = 2
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, score, reading_level) of `docs` (doc_id, text), from `labels` (doc_id, reading_level), and a report of one row.

    Documents and words form a graph whose edges have weights of their own: how often the word occurs in the document, times
    how strongly the word tells levels apart. The latter is its distance from the mean grade after `warm` rounds (0: all words
    tell alike) and stays fixed. Then a graded document keeps its grade (the mean of its raters'), every word takes the mean
    of its documents and every other document that of its words, by edge weight, until no word moves by more than
    `tolerance`: the harmonic function of that graph between the grades, words being tied weakly to the mean grade. The report
    (documents, graded, rounds, residual, settled, agreement) says whether that was reached within `rounds`, and how many of
    the graded documents, each scored without its own grade, come out at their grade. The boundaries between levels are those
    that misplace the fewest of these. A word's node is its hash among `slots`; more slots merge fewer words.

    Each round reads the edges once; tasks send back sums per word node, `slots` rows at most. Repeated documents count once;
    texts that are NULL or without a word get a NULL level; labels without a document, a level or an id are ignored. Without
    any usable label every level is NULL; an empty table gives no rows.
    """
    spark = docs.sparkSession
    grades = labels.where("doc_id IS NOT NULL AND reading_level IS NOT NULL").groupBy("doc_id").agg(F.avg("reading_level").alias("label"))
    plain = F.regexp_replace(F.lower("text"), r"<[^>]{1,200}>", " ")
    nodes = F.transform(F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0)), lambda w: F.pmod(F.xxhash64(w), F.lit(slots)).cast("int"))
    nodes = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce(nodes, F.array().cast("array<int>")).alias("slots")).dropDuplicates(["doc_id"])
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    nodes = nodes.join(grades, "doc_id", "left").select("doc_id", "label", fold.alias("fold"), "slots")
    edges = materialize(_edges(nodes, slots), "edges")
    facts = edges.where("label IS NOT NULL").agg(F.avg("label"), F.min("label"), F.max("label"), F.count("*")).first()
    kinds = "documents bigint, graded bigint, rounds int, residual double, settled boolean, agreement double"
    if not facts[3]:
        none = edges.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("reading_level"))
        return none, spark.createDataFrame([(edges.count(), 0, 0, None, None, None)], kinds)
    mean, lowest, highest = float(facts[0]), int(round(facts[1])), int(round(facts[2]))

    def sums(words: np.ndarray | None, strength: np.ndarray | None = None):
        handle = None if words is None else spark.sparkContext.broadcast((words, strength))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            num, den = np.zeros((slots, FOLDS + 1)), np.zeros((slots, FOLDS + 1))
            for batch in batches:
                b = _arrays(batch)
                doc, slot, weight, label, fold = b
                graded = ~np.isnan(label)
                score = None if handle is None else _scores(b, *handle.value, mean)[1]
                for f in range(FOLDS + 1):
                    held = graded & (fold != f)
                    w = weight * (np.where(held, CLAMP, 1.0) if score is not None else held)[doc]
                    s = np.where(held, label, 0.0) if score is None else score[:, f]
                    num[:, f] += np.bincount(slot, w * s[doc], slots)
                    den[:, f] += np.bincount(slot, w, slots)
            at = np.flatnonzero(den.any(1))
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * (FOLDS + 1)), pa.array(m[at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), lists(num), lists(den)], names=["slot", "num", "den"])

        source = edges.where("label IS NOT NULL") if words is None else edges
        parts = source.mapInArrow(run, "slot int, num array<double>, den array<double>")
        each = [F.sum(F.get(c, F.lit(f))).alias(f"{c}{f}") for c in ("num", "den") for f in range(FOLDS + 1)]
        num, den = np.zeros((slots, FOLDS + 1)), np.zeros((slots, FOLDS + 1))
        for r in parts.groupBy("slot").agg(*each).toLocalIterator():  # `slots` rows at most
            num[r["slot"]], den[r["slot"]] = r[1 : FOLDS + 2], r[FOLDS + 2 :]
        return (num + 1e-2 * mean) / (den + 1e-2)

    words, done, moved = sums(None), 0, math.inf
    strength = np.ones_like(words)
    for _ in range(warm):
        strength = np.abs(words - mean) + 0.05
        words = sums(words, strength)
    while done < rounds and moved > tolerance:
        new = sums(words, strength)
        moved, words, done = float(np.abs(new - words).max()), new, done + 1
    handle = spark.sparkContext.broadcast((words, strength))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _arrays(batch)
            free, _ = _scores(b, *handle.value, mean)
            known = np.bincount(b[0], minlength=batch.num_rows) > 0
            own = free[np.arange(batch.num_rows), b[4]]  # without the document's own grade
            cols = [pa.array(free[:, -1], mask=~known), pa.array(own, mask=~known)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *cols], names=["doc_id", "label", "score", "own"])

    scored = materialize(edges.mapInArrow(score, "doc_id bigint, label double, score double, own double"), "scores")
    width = (highest - lowest + 1) / BINS
    bin_ = F.floor((F.col("own") - lowest + 0.5) / width).cast("int")
    graded = scored.where("label IS NOT NULL AND own IS NOT NULL").groupBy(bin_.alias("bin"), F.round("label").cast("int").alias("level")).count()
    table = np.zeros((BINS + 1, highest - lowest + 1))
    for r in graded.toLocalIterator():  # BINS times the levels at most
        table[min(max(r["bin"], 0), BINS), r["level"] - lowest] += r["count"]
    level, starts = F.lit(lowest), [-math.inf]
    for k in range(lowest + 1, highest + 1):
        above, below = table[:, k - lowest :].sum(1), table[:, : k - lowest].sum(1)
        # misplaced if the boundary lies before bin i: those of lower level from i on, of higher level before i
        wrong = np.concatenate([[0], np.cumsum(above)]) + below.sum() - np.concatenate([[0], np.cumsum(below)])
        best = np.flatnonzero(wrong == wrong.min())
        cut = int(best[len(best) // 2])
        boundary = lowest - 0.5 + width * cut
        starts.append(cut)
        level = F.when(F.col("score") >= boundary, F.greatest(level, F.lit(k))).otherwise(level)
    given = np.max([np.where(np.arange(BINS + 1) >= cut, k, 0) for k, cut in enumerate(starts)], axis=0)
    right = float(table[np.arange(BINS + 1), given].sum() / table.sum())
    report = spark.createDataFrame([(edges.count(), facts[3], done, moved if done else None, moved <= tolerance, right)], kinds)
    return scored.select("doc_id", "score", F.when(F.col("score").isNotNull(), level).cast("int").alias("reading_level")), report
