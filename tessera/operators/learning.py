"""Supervised learning over event features: preprocessing, nested validation, importance, partial dependence."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.shares import ranking_metrics
from tessera.session import materialize

THREADS = 8  # fits that run side by side; their tasks share the cluster


def side_by_side(f: Callable, items: Iterable) -> list:
    """`f` of each item, THREADS at a time: Spark runs the jobs of several threads at once."""
    with ThreadPool(THREADS) as pool:
        return pool.map(f, list(items))


def collapse_rare(df: DataFrame, columns: Sequence[str], least: int = 3) -> DataFrame:
    """Levels of fewer than `least` rows become `rare`, NULL becomes `missing`."""
    for c in columns:
        kept = df.groupBy(c).agg(F.count("*").alias("__n")).where((F.col("__n") >= least) & F.col(c).isNotNull()).select(c, F.lit(True).alias("__k"))
        df = df.join(kept, c, "left").withColumn(c, F.when(F.col(c).isNull(), "missing").when(F.col("__k"), F.col(c)).otherwise("rare")).drop("__k")
    return df


def preprocessing(numeric: Sequence[str], levels: Sequence[str]) -> tuple[Callable[[DataFrame], DataFrame], list]:
    """(indicator step, pipeline stages): median imputation with missing indicators, scaling, one-hot levels."""

    def indicators(df: DataFrame) -> DataFrame:
        return df.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in numeric])

    filled = [f"{c}_filled" for c in numeric]
    stages = [
        Imputer(inputCols=list(numeric), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        StringIndexer(inputCols=list(levels), outputCols=[f"{c}_i" for c in levels], handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"{c}_i" for c in levels], outputCols=[f"{c}_v" for c in levels], handleInvalid="keep"),
        VectorAssembler(inputCols=["scaled", *[f"{c}_missing" for c in numeric], *[f"{c}_v" for c in levels]], outputCol="features"),
    ]
    return indicators, stages


ESTIMATORS = {
    "elastic_net": lambda p: LogisticRegression(labelCol="y", regParam=p.get("reg", 0.01), elasticNetParam=p.get("mix", 0.5), maxIter=25),
    "forest": lambda p: RandomForestClassifier(labelCol="y", numTrees=p.get("trees", 10), maxDepth=p.get("depth", 5), seed=1),
    "boosting": lambda p: GBTClassifier(labelCol="y", maxIter=p.get("rounds", 4), maxDepth=p.get("depth", 3), seed=1),
}
REGRESSORS = {
    "elastic_net": lambda p: LinearRegression(labelCol="y", regParam=p.get("reg", 0.01), elasticNetParam=p.get("mix", 0.5)),
    "forest": lambda p: RandomForestRegressor(labelCol="y", numTrees=p.get("trees", 10), maxDepth=p.get("depth", 5), seed=1),
    "boosting": lambda p: GBTRegressor(labelCol="y", maxIter=p.get("rounds", 4), maxDepth=p.get("depth", 3), seed=1),
}


def with_folds(df: DataFrame, key: str, folds: int, repeat: int = 0) -> DataFrame:
    """`df` with a fold by hash of the key: independent of partitions, and new in every repeat."""
    return df.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(repeat)), F.lit(folds)).cast("int"))


def probability() -> Column:
    """The probability of class 1 of a classifier's output."""
    return F.get(vector_to_array("probability"), F.lit(1))


def drawn(space: dict[str, Callable[[np.random.Generator], object]], n: int, seed: int = 1) -> list[dict]:
    """`n` parameter sets drawn from a space of one distribution per parameter."""
    rng = np.random.default_rng(seed)
    return [{k: draw(rng) for k, draw in space.items()} for _ in range(n)]


# how the parameters of each estimator are drawn
SPACES: dict[str, dict[str, Callable]] = {
    "elastic_net": {"reg": lambda r: float(10 ** r.uniform(-4, 0)), "mix": lambda r: float(r.uniform())},
    "forest": {"trees": lambda r: int(r.integers(10, 31)), "depth": lambda r: int(r.integers(3, 9))},
    "boosting": {"rounds": lambda r: int(r.integers(5, 16)), "depth": lambda r: int(r.integers(2, 5))},
}


def search(train: DataFrame, kind: str, candidates: Sequence[dict], inner: int) -> tuple[dict, float]:
    """The candidate with the best mean AUC over inner folds, and that AUC; `train` has features, y and inner."""

    def score(job: tuple[dict, int]) -> float:
        c, f = job
        model = ESTIMATORS[kind](c).fit(train.where(F.col("inner") != f))
        held = model.transform(train.where(F.col("inner") == f)).select("y", probability().alias("p"))
        return ranking_metrics(held, "y", "p").first()["auc"] or 0.5

    each = side_by_side(score, [(c, f) for c in candidates for f in range(inner)])
    means = np.array(each).reshape(len(candidates), inner).mean(1)
    return candidates[int(means.argmax())], float(means.max())


def prepared_fold(data: DataFrame, stages: list, fold: int) -> DataFrame:
    """`data` with features by a preprocessing that is fitted without one fold, kept in the shared folder."""
    kept = [c for c in ("y", "fold", "inner") if c in data.columns]
    key = data.columns[0]
    return materialize(Pipeline(stages=stages).fit(data.where(F.col("fold") != fold)).transform(data).select(key, *kept, "features"), "prepared")


def nested_predictions(
    df: DataFrame, key: str, numeric: Sequence[str], levels: Sequence[str], candidates: dict[str, int], folds: int = 3, repeats: int = 1, inner: int = 3
) -> tuple[DataFrame, list[tuple]]:
    """(model, repeat, fold, key, y, pred) out of fold, and (model, repeat, fold, parameters, inner AUC) of the chosen ones.

    `candidates` says how many parameter sets of each estimator are drawn from its space. Preprocessing and the inner search
    see only the outer training rows; a repeat deals the rows to other folds and draws other parameters.
    """
    indicators, stages = preprocessing(numeric, levels)
    out, chosen = None, []
    for r in range(repeats):
        data = indicators(with_folds(df, key, folds, r).withColumn("inner", F.pmod(F.xxhash64(key, F.lit(f"inner{r}")), F.lit(inner)).cast("int")))
        data = data.select(key, *[c for c in data.columns if c != key])
        for f in range(folds):
            prepared = prepared_fold(data, stages, f)
            train, test = prepared.where(F.col("fold") != f), prepared.where(F.col("fold") == f)
            for kind, n in candidates.items():
                best, auc = search(train, kind, drawn(SPACES[kind], n, 100 * r + f), inner)
                chosen.append((kind, r, f, ", ".join(f"{k}={v:.4g}" for k, v in sorted(best.items())), auc))
                model = ESTIMATORS[kind](best).fit(train)
                part = model.transform(test).select(F.lit(kind).alias("model"), F.lit(r).alias("repeat"), "fold", key, "y", probability().alias("pred"))
                out = part if out is None else out.unionByName(part)
    return out, chosen


def dummy_predictions(df: DataFrame, key: str, folds: int = 3) -> DataFrame:
    """(model, repeat, fold, key, y, pred) of the training share of each fold, and of a coin with that share."""
    data = with_folds(df, key, folds)
    every = data.groupBy("fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    total = every.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    prior = every.join(F.broadcast(total)).select("fold", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("p"))  # one row
    base = data.join(F.broadcast(prior), "fold")  # one row per fold
    coin = F.pmod(F.xxhash64(key, F.lit("coin")), F.lit(1 << 20)) / float(1 << 20)
    common = lambda name, pred: base.select(F.lit(name).alias("model"), F.lit(0).alias("repeat"), "fold", key, "y", pred.cast("double").alias("pred"))
    return common("prior", F.col("p")).unionByName(common("stratified", (coin < F.col("p")).cast("double")))


BUCKET = 20_000  # rows among which the values of a permuted column move


def permuted(df: DataFrame, key: str, column: str, seed: int, rows: int) -> DataFrame:
    """`df` of so many rows with one column's values dealt to other rows: two hash orders of a bucket are joined. Buckets hold
    BUCKET random rows on average at any size, so no window grows with the data."""
    from pyspark.sql import Window

    bucket = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(max(1, math.ceil(rows / BUCKET))))
    rank = lambda salt: F.row_number().over(Window.partitionBy("__b").orderBy(F.xxhash64(key, F.lit(salt)), key))
    base = df.withColumn("__b", bucket)
    left = base.drop(column).withColumn("__r", rank(seed + 1))
    right = base.select("__b", key, column).withColumn("__r", rank(seed + 2)).select("__b", "__r", column)
    return left.join(right, ["__b", "__r"]).drop("__b", "__r")


def permutation_importance(fitted: Sequence[tuple], key: str, columns: Sequence[str], repeats: int = 3, boot: int = 1_000) -> DataFrame:
    """(feature, drop, sd, lo, hi, p_positive, base): loss of AUC when a column is permuted, over all (model, test rows) of
    `fitted` and `repeats` permutations each; the interval is that of the mean of resampled losses."""
    auc = lambda m, d: ranking_metrics(m.transform(d).select("y", probability().alias("p")), "y", "p").first()["auc"] or 0.5
    tests = [(m, t, t.count()) for m, t in fitted]
    base = side_by_side(lambda x: auc(x[0], x[1]), tests)
    jobs = [(c, i, r) for c in columns for i in range(len(tests)) for r in range(repeats)]

    def loss(job: tuple[str, int, int]) -> float:
        c, i, r = job
        model, test, n = tests[i]
        return base[i] - auc(model, permuted(test, key, c, 10 * r + 1, n))

    each, rng, rows = dict(zip(jobs, side_by_side(loss, jobs))), np.random.default_rng(1), []
    for c in columns:
        v = np.array([each[c, i, r] for i in range(len(tests)) for r in range(repeats)])
        means = rng.choice(v, (boot, len(v))).mean(1)
        rows.append((c, float(v.mean()), float(v.std(ddof=1)), *(float(x) for x in np.percentile(means, [2.5, 97.5])), float((v > 0).mean()), float(np.mean(base))))
    return fitted[0][1].sparkSession.createDataFrame(rows, "feature string, drop double, sd double, lo double, hi double, p_positive double, base double")


def grid_of(df: DataFrame, column: str, points: int = 8, levels: int = 6, support: int = 5) -> list:
    """Values at which a feature's effect is shown: equal steps between the 2.5 and 97.5 percentiles of a number, or the most
    frequent levels with enough rows."""
    if dict(df.dtypes)[column] != "string":
        lo, hi = df.agg(F.percentile(column, F.array(F.lit(0.025), F.lit(0.975))).alias("q")).first()["q"]
        return sorted({round(float(v), 6) for v in np.linspace(lo, hi, points)})
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(levels).collect()
    return [r[column] for r in counts if r["n"] >= support] or [r[column] for r in counts]


def individual_effects(model, df: DataFrame, key: str, columns: Sequence[str], points: int = 8) -> DataFrame:
    """(feature, kind, grid_index, grid_value, key, pred): predictions of every row with the feature set to each grid value."""
    out = None
    for c in columns:
        grid = grid_of(df, c, points)
        kind = "level" if isinstance(grid[0], str) else "number"
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(grid)]))
        shown = df.drop(c).withColumn("__at", at).withColumn(c, F.col("__at.v"))
        part = model.transform(shown).select(F.lit(c).alias("feature"), F.lit(kind).alias("kind"), F.col("__at.i").alias("grid_index"), F.col("__at.v").cast("string").alias("grid_value"), key, probability().alias("pred"))
        out = part if out is None else out.unionByName(part)
    return out


def partial_dependence(effects: DataFrame) -> DataFrame:
    """(feature, kind, grid_index, grid_value, mean, lo, hi): mean prediction and the middle 80 % of the rows' own."""
    return effects.groupBy("feature", "kind", "grid_index", "grid_value").agg(F.avg("pred").alias("mean"), F.percentile("pred", F.lit(0.1)).alias("lo"), F.percentile("pred", F.lit(0.9)).alias("hi"))
