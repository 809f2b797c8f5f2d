"""Queries of supervised learning and topics."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import headline_product
from tessera.operators import learning as L
from tessera.operators import regression as M
from tessera.operators import topics as T
from tessera.operators.contingency import replicates
from tessera.operators.series import first_peak, prior_events
from tessera.operators.shares import crosstab, ranking_metrics, union_all
from tessera.operators.similarity import npmi
from tessera.plans.registry import Registry
from tessera.plans.relational_queries import r6
from tessera.plans.text_queries import E, phrase_sql, quoted
from tessera.session import materialize
from tessera.sources.events import events, once, rows

REGISTRY = Registry()
Q = REGISTRY.query
FLAGS = ["is_childrens", "is_violation", "injuries_reported", "sleepwear_standard", "category_arbitrage", "is_electric_textile"]
NUMERIC = ["year", "log_price", "n_countries", "prior", *FLAGS, "title_words", "desc_chars", "n_retailers", "n_products", "sold_online", "log_units_"]
LEVELS = ["hazard_category", "sales_channel", "country", "archetype", "boundary_class", "enforcement_mode", "segment"]
# how much a run searches; the larger settings are parameters of the same functions
QUICK = {"candidates": {"elastic_net": 4, "forest": 3, "boosting": 4}, "folds": 3, "repeats": 1, "inner": 3}
PRODUCTION = {"candidates": {"elastic_net": 200, "forest": 200, "boosting": 240}, "folds": 5, "repeats": 5, "inner": 5}
RESAMPLES, PERMUTATIONS, LINES = 60, 3, 25
# Countries told apart, kinds that may stand in for sleepwear, and shops whose names tell online sales.
TOP_COUNTRIES = ["China", "Vietnam", "India", "Pakistan", "Bangladesh", "Indonesia", "United States", "Hong Kong"]
STAND_INS = ["loungewear", "robe", "wearable_blanket", "daywear", "outerwear"]
ONLINE_NAMES = r"amazon|ebay|etsy|shein|temu|walmart\.com|online"


def feature_frame(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen numbers and flags with the units, seven kinds, and whether a refund is offered (`y`, NULL where no option is given)."""
    cols = ["year", "title", "recall_date", "firm_key", "units", "price_usd", "hazard_category", "sales_channel", "segment", "primary_country", "archetype", "archetype_can_be_tight", "injuries_reported"]
    e = rows(spark, d, *cols, "is_childrens", "is_violation", "sleepwear_standard", "is_electric_textile", "enforcement_mode", "countries_raw", "description", "retailers", "products", "remedy_options")
    packed = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.regexp_count(F.col(c), F.lit(r"\|")) + 1).cast("double")
    tight = F.col("archetype_can_be_tight")
    # long texts become numbers before repeats are removed
    e = once(e.select(
        "recall_id", "recall_date", "firm_key", F.col("year").cast("double").alias("year"),
        F.when(F.col("year") >= 2010, F.lower("remedy_options").contains("refund").cast("double")).alias("y"),
        F.when(F.col("units") > 0, F.log10("units")).alias("log_units_"), F.when(F.col("price_usd") > 0, F.log10("price_usd")).alias("log_price"),
        F.size(F.filter(F.split(F.coalesce("countries_raw", F.lit("")), ";"), lambda x: F.trim(x) != "")).cast("double").alias("n_countries"),
        (F.col("sleepwear_standard") & F.col("archetype").isin(STAND_INS)).alias("category_arbitrage"), "is_childrens", "is_violation", "injuries_reported", "sleepwear_standard", "is_electric_textile",
        F.size(F.filter(F.split(F.coalesce("title", F.lit("")), r"\s+"), lambda x: x != "")).cast("double").alias("title_words"),
        F.length(F.coalesce("description", F.lit(""))).cast("double").alias("desc_chars"), packed("retailers").alias("n_retailers"), packed("products").alias("n_products"),
        F.lower(F.concat_ws(" ", "title", "description", "retailers")).rlike(ONLINE_NAMES).cast("double").alias("sold_online"),
        "hazard_category", "sales_channel", F.when(F.col("primary_country").isNull(), "missing").when(F.col("primary_country").isin(TOP_COUNTRIES), F.col("primary_country")).otherwise("other").alias("country"),
        "archetype", F.when(tight, "exemption_eligible").when(~tight, "exemption_ineligible").otherwise("not_sleepwear").alias("boundary_class"), "enforcement_mode", "segment",
    ))
    e = prior_events(e, "firm_key", "recall_date", "recall_id").withColumn("prior", F.col("prior").cast("double"))
    return e.select("recall_id", "y", *[F.coalesce(c, F.lit(False)).cast("double").alias(c) if c in FLAGS else F.col(c) for c in NUMERIC], *LEVELS)


@Q("ml1_feature_frame", f"""{E} SELECT recall_id, CASE WHEN year >= 2010 THEN CAST(contains(lower(remedy_options), 'refund') AS DOUBLE) END AS y, CAST(year AS DOUBLE) AS year, CASE WHEN price_usd > 0 THEN round(log10(price_usd), 6) END AS log_price,
 CAST(len(list_filter(string_split(coalesce(countries_raw, ''), ';'), lambda x: trim(x) <> '')) AS DOUBLE) AS n_countries, CAST(CASE WHEN firm_key IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY firm_key ORDER BY recall_date ASC NULLS LAST, recall_id) - 1 END AS DOUBLE) AS prior,
 CAST(coalesce(is_childrens, false) AS DOUBLE) AS is_childrens, CAST(coalesce(is_violation, false) AS DOUBLE) AS is_violation, CAST(coalesce(injuries_reported, false) AS DOUBLE) AS injuries_reported, CAST(coalesce(sleepwear_standard, false) AS DOUBLE) AS sleepwear_standard,
 CAST(coalesce(sleepwear_standard AND archetype IN ({", ".join(f"'{x}'" for x in STAND_INS)}), false) AS DOUBLE) AS category_arbitrage, CAST(coalesce(is_electric_textile, false) AS DOUBLE) AS is_electric_textile, CAST(len(list_filter(regexp_split_to_array(coalesce(title, ''), '\\s+'), lambda x: x <> '')) AS DOUBLE) AS title_words,
 CAST(length(coalesce(description, '')) AS DOUBLE) AS desc_chars, CAST(CASE WHEN coalesce(retailers, '') = '' THEN 0 ELSE len(string_split(retailers, '|')) END AS DOUBLE) AS n_retailers, CAST(CASE WHEN coalesce(products, '') = '' THEN 0 ELSE len(string_split(products, '|')) END AS DOUBLE) AS n_products,
 CAST(regexp_matches(lower(concat_ws(' ', title, description, retailers)), '{ONLINE_NAMES}') AS DOUBLE) AS sold_online, CASE WHEN units > 0 THEN round(log10(units), 6) END AS log_units_, hazard_category, sales_channel,
 CASE WHEN primary_country IS NULL THEN 'missing' WHEN primary_country IN ({", ".join(f"'{x}'" for x in TOP_COUNTRIES)}) THEN primary_country ELSE 'other' END AS country, archetype, CASE WHEN archetype_can_be_tight THEN 'exemption_eligible' WHEN NOT archetype_can_be_tight THEN 'exemption_ineligible' ELSE 'not_sleepwear' END AS boundary_class, enforcement_mode, segment FROM e""")
def ml1(spark: SparkSession, d: str) -> DataFrame:
    return feature_frame(spark, d).withColumns({c: F.round(c, 6) for c in ("log_units_", "log_price")})


def ready(spark: SparkSession, d: str) -> DataFrame:
    """Rows of known outcome, rare kinds collapsed."""
    return materialize(L.collapse_rare(feature_frame(spark, d).where("y IS NOT NULL"), LEVELS), "features")


@Q("ml2_preprocessing")
def ml2(spark: SparkSession, d: str) -> DataFrame:
    """Rows with their preprocessed vector's length and sum."""
    from pyspark.ml.functions import vector_to_array

    indicators, stages = L.preprocessing(NUMERIC, LEVELS)
    x = indicators(ready(spark, d))
    v = vector_to_array("features")
    return Pipeline(stages=stages).fit(x).transform(x).select("recall_id", F.size(v).alias("width"), F.aggregate(v, F.lit(0.0), lambda s, e: s + e).alias("total"))


@Q("ml3_ml4_ml5_nested_validation")
def ml5(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold predictions of the searched estimators and of the constant ones: metrics by fold, then over the folds."""
    x = ready(spark, d)
    found, _ = L.nested_predictions(x, "recall_id", NUMERIC, LEVELS, **QUICK)
    p = materialize(L.dummy_predictions(x, "recall_id", QUICK["folds"]).unionByName(found), "oof")
    each = []
    for r in p.select("model", "repeat", "fold").distinct().collect():  # a few models and folds
        part = p.where((F.col("model") == r["model"]) & (F.col("repeat") == r["repeat"]) & (F.col("fold") == r["fold"]))
        m = ranking_metrics(part.select("y", F.col("pred").alias("p")), "y", "p").select(F.lit(r["model"]).alias("model"), "auc", "average_precision")
        each.append(m)
    ranks = union_all(each).groupBy("model").agg(F.avg("auc").alias("auc"), F.stddev_samp("auc").alias("auc_sd"), F.avg("average_precision").alias("average_precision"))
    safe = F.least(F.greatest("pred", F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = -(F.col("y") * F.log(safe) + (1 - F.col("y")) * F.log(1 - safe))
    return p.groupBy("model").agg(F.count("*").alias("n"), F.avg((F.col("pred") - F.col("y")) ** 2).alias("brier"), F.avg(loss).alias("log_loss")).join(ranks, "model")


@Q("ml4_chosen_parameters")
def ml4(spark: SparkSession, d: str) -> DataFrame:
    """The parameters that the inner search chose in each outer fold."""
    _, chosen = L.nested_predictions(ready(spark, d), "recall_id", NUMERIC, LEVELS, **QUICK)
    return spark.createDataFrame(chosen, "model string, repeat int, fold int, parameters string, inner_auc double")


@Q("ml3_regression")
def ml3r(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold fit of the logarithm of the units, against the training mean and median."""
    numeric = [c for c in NUMERIC if c != "log_units_"]
    x = L.collapse_rare(feature_frame(spark, d).where("log_units_ IS NOT NULL").withColumn("y", F.col("log_units_")).drop("log_units_"), LEVELS)
    indicators, stages = L.preprocessing(numeric, LEVELS)
    data, out = materialize(indicators(L.with_folds(x, "recall_id", 3)), "folds"), None
    for f in range(3):
        prepared = L.prepared_fold(data, stages, f)
        train, test = prepared.where(F.col("fold") != f), prepared.where(F.col("fold") == f)
        mean, median = train.agg(F.avg("y"), F.median("y")).first()
        parts = [test.select(F.lit(n).alias("model"), "y", F.lit(float(v)).alias("pred")) for n, v in (("mean", mean), ("median", median))]
        fits = L.side_by_side(lambda kv: (kv[0], kv[1]({}).fit(train)), L.REGRESSORS.items())
        parts += [m.transform(test).select(F.lit(n).alias("model"), "y", F.col("prediction").alias("pred")) for n, m in fits]
        for p in parts:
            out = p if out is None else out.unionByName(p)
    e = F.col("y") - F.col("pred")
    return out.groupBy("model").agg((1 - F.sum(e * e) / (F.var_pop("y") * F.count("y"))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


@Q("ml6_temporal_rows", f"{E} SELECT year <= 2019 AS train, count(*) AS n, round(avg(CAST(contains(lower(remedy_options), 'refund') AS INTEGER)), 6) AS share FROM e WHERE year >= 2010 AND remedy_options IS NOT NULL GROUP BY 1")
def ml6(spark: SparkSession, d: str) -> DataFrame:
    return feature_frame(spark, d).where("y IS NOT NULL").groupBy((F.col("year") <= 2019).alias("train")).agg(F.count("*").alias("n"), r6(F.avg("y"), "share"))


@Q("ml6_temporal_gap")
def ml6b(spark: SparkSession, d: str) -> DataFrame:
    """AUC on later events after training on earlier ones."""
    model, test = forest(spark, d)
    return ranking_metrics(model.transform(test).select("y", L.probability().alias("p")), "y", "p")


def forest(spark: SparkSession, d: str):
    x = ready(spark, d)
    indicators, stages = L.preprocessing(NUMERIC, LEVELS)
    model = Pipeline(stages=[*stages, L.ESTIMATORS["forest"]({"depth": 5})]).fit(indicators(x.where("year <= 2019")))
    return model, indicators(x.where("year > 2019"))


@Q("ml7_permutation_importance")
def ml7(spark: SparkSession, d: str) -> DataFrame:
    """Every feature's importance, over two folds."""
    x = materialize(L.with_folds(ready(spark, d), "recall_id", 2), "folds")
    indicators, stages = L.preprocessing(NUMERIC, LEVELS)

    def fitted(f: int):
        model = Pipeline(stages=[*stages, L.ESTIMATORS["forest"]({"depth": 5})]).fit(indicators(x.where(F.col("fold") != f)))
        return model, indicators(x.where(F.col("fold") == f))

    return L.permutation_importance([fitted(0), fitted(1)], "recall_id", [*NUMERIC, *LEVELS], PERMUTATIONS)


SHOWN = ["log_price", "log_units_", "year", "hazard_category", "sales_channel", "archetype"]


@Q("ml8_partial_dependence")
def ml8(spark: SparkSession, d: str) -> DataFrame:
    """Mean prediction along numbers and levels, over all later events."""
    model, test = forest(spark, d)
    return L.partial_dependence(L.individual_effects(model, test, "recall_id", SHOWN))


@Q("ml8_individual_lines")
def ml8b(spark: SparkSession, d: str) -> DataFrame:
    """The predictions of a few events of their own, drawn by hash, along the same grids."""
    model, test = forest(spark, d)
    lines = test.select("recall_id").orderBy(F.xxhash64("recall_id", F.lit("line")), "recall_id").limit(LINES)
    return L.individual_effects(model, test, "recall_id", SHOWN).join(F.broadcast(lines), "recall_id")  # LINES rows


def resampled_coefficients(spark: SparkSession, x: DataFrame, numeric: list[str], make) -> DataFrame:
    """(feature, estimate, mean, sd, lo, hi, selected) of a linear model over RESAMPLES Poisson-weighted resamples."""
    indicators, stages = L.preprocessing(numeric, LEVELS)
    fitted = materialize(Pipeline(stages=stages).fit(indicators(x)).transform(indicators(x)).select("recall_id", "y", "features"), "prepared")

    def coefficients(b: int) -> np.ndarray:
        # Poisson(1) weights by hash: the bootstrap of rows without moving them
        u = F.pmod(F.xxhash64("recall_id", F.lit(b)), F.lit(1 << 30)) / float(1 << 30)
        w = F.when(u < 0.367879, 0.0).when(u < 0.735759, 1.0).when(u < 0.919699, 2.0).when(u < 0.981012, 3.0).when(u < 0.996340, 4.0).otherwise(5.0)
        return make(fitted.withColumn("w", F.lit(1.0) if b < 0 else w)).coefficients.toArray()

    point, *each = L.side_by_side(coefficients, [-1, *range(RESAMPLES)])
    c = np.array(each)
    lo, hi = np.percentile(c, [2.5, 97.5], axis=0)
    found = [(i, float(point[i]), float(c[:, i].mean()), float(c[:, i].std(ddof=1)), float(lo[i]), float(hi[i]), float((np.abs(c[:, i]) > 1e-8).mean())) for i in range(c.shape[1])]
    return spark.createDataFrame(found, "feature int, estimate double, mean double, sd double, lo double, hi double, selected double")


@Q("reg6_elastic_net_bootstrap")
def reg6(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of the refund model over resamples: estimate, spread, interval and how often each is kept."""
    from pyspark.ml.classification import LogisticRegression

    return resampled_coefficients(spark, ready(spark, d), NUMERIC, lambda w: LogisticRegression(labelCol="y", weightCol="w", regParam=0.02, elasticNetParam=0.5, maxIter=25).fit(w))


@Q("reg6_linear_bootstrap")
def reg6b(spark: SparkSession, d: str) -> DataFrame:
    """The same of the linear model of the units."""
    from pyspark.ml.regression import LinearRegression

    x = L.collapse_rare(feature_frame(spark, d).where("log_units_ IS NOT NULL").withColumn("y", F.col("log_units_")).drop("log_units_"), LEVELS)
    return resampled_coefficients(spark, materialize(x, "features"), [c for c in NUMERIC if c != "log_units_"], lambda w: LinearRegression(labelCol="y", weightCol="w", regParam=0.01, elasticNetParam=0.5).fit(w))


# --- topics ----------------------------------------------------------------------------------------------------------
NOISE = ["recall", "recalls", "recalled", "announce", "announces", "cpsc", "due", "hazard", "style", "imported", "consumers", "warns"]
TOPICS = 5
SWEEP = range(2, 8)  # the quick range; the full one is 2 to 16


def corpus(spark: SparkSession, d: str) -> DataFrame:
    e = once(rows(spark, d, "title", "period", "sales_channel").select("recall_id", "period", "sales_channel", F.lower(headline_product(F.col("title"), "topics")).alias("text")))
    return e.where("text <> ''")


def vectorised(spark: SparkSession, d: str) -> tuple[DataFrame, list[str], dict]:
    return T.vectors(corpus(spark, d), "text", 5, 0.6, NOISE)


def _vocabulary_sql() -> str:
    """Tables up to b (term, df, tf) within the bounds."""
    stop = ", ".join(quoted(w) for w in [*T.STOP_WORDS, *NOISE])
    return f"""{E}, {phrase_sql("topics")}, k AS (SELECT recall_id, list_filter(regexp_extract_all(lower(phrase), '[a-z][a-z\\-]+'), lambda x: x NOT IN ({stop})) AS w FROM f WHERE phrase <> ''), t AS (SELECT recall_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM k),
 c AS (SELECT term, count(DISTINCT recall_id) AS df, count(*) AS tf FROM t GROUP BY 1), b AS (SELECT * FROM c WHERE df >= 5 AND df <= 0.6 * (SELECT count(*) FROM k))"""


_VOCABULARY = _vocabulary_sql()


@Q("tx1_vocabulary", f"{_VOCABULARY} SELECT CAST(row_number() OVER (ORDER BY tf DESC, term) - 1 AS INTEGER) AS rank, term FROM b")
def tx1(spark: SparkSession, d: str) -> DataFrame:
    _, vocabulary, _ = vectorised(spark, d)
    return spark.createDataFrame([(i, t) for i, t in enumerate(vocabulary)], "rank int, term string")


@Q("tx1_vocabulary_report", f"{_VOCABULARY} SELECT count(*) AS terms, count(*) AS kept, CAST(1.0 AS DOUBLE) AS share FROM b")
def tx1b(spark: SparkSession, d: str) -> DataFrame:
    """How many terms pass the frequency bounds, how many of these are kept, and the share of occurrences that they hold."""
    _, _, report = vectorised(spark, d)
    return spark.createDataFrame([tuple(report.values())], "terms bigint, kept bigint, share double")


def nmf(spark: SparkSession, d: str, k: int = TOPICS):
    docs, vocabulary, _ = vectorised(spark, d)
    return T.factorise(T.weighted(docs, "recall_id", vocabulary), "recall_id", "term", "w", k)


@Q("tx2_nmf_topics")
def tx2(spark: SparkSession, d: str) -> DataFrame:
    _, h, terms = nmf(spark, d)
    return spark.createDataFrame([(i, r, t) for i, ts in enumerate(T.top_terms(h, terms)) for r, t in enumerate(ts)], "topic int, rank int, term string")


@Q("tx3_lda_topics")
def tx3(spark: SparkSession, d: str) -> DataFrame:
    """Topics by batch variational updates, with the perplexity of documents held out of a fit."""
    docs, vocabulary, _ = vectorised(spark, d)
    docs = materialize(docs.select("recall_id", "features"), "docs")
    held = F.pmod(F.xxhash64("recall_id", F.lit("held")), F.lit(3)) == 0
    model, _ = T.lda(docs, TOPICS)
    outside = T.lda(docs.where(~held), TOPICS)[0].logPerplexity(docs.where(held))
    names = spark.createDataFrame(list(enumerate(vocabulary)), "term_id int, term string")
    top = model.describeTopics(6).select("topic", F.posexplode("termIndices").alias("rank", "term_id"))
    return top.join(names, "term_id").select("topic", "rank", "term", F.lit(float(outside)).alias("held_out_log_perplexity"))


@Q("tx5_stability")
def tx5(spark: SparkSession, d: str) -> DataFrame:
    """Stability of the number of topics: consensus of all documents over four factorisations of four fifths of them."""
    docs, vocabulary, _ = vectorised(spark, d)
    c = materialize(T.weighted(docs, "recall_id", vocabulary), "cells")
    out = []
    for k in (3, TOPICS):
        labels = None
        for s in range(4):
            part = c.where(F.pmod(F.xxhash64("recall_id", F.lit(f"sample{s}")), F.lit(5)) < 4)
            w, _, _ = T.factorise(part, "recall_id", "term", "w", k, 8, start="random", seed=s)
            one = w.select("recall_id", (F.array_position("weights", F.array_max("weights")) - 1).cast("int").alias(f"l{s}"))
            labels = one if labels is None else labels.join(one, "recall_id", "full")
        groups = labels.groupBy(*[f"l{s}" for s in range(4)]).agg(F.count("*").alias("m"))
        got = M.cells(groups)  # (k + 1) to the power of the runs at most
        out.append((k, T.cophenetic([[r[f"l{s}"] for s in range(4)] for r in got], [r["m"] for r in got])))
    return spark.createDataFrame(out, "k int, cophenetic double")


@Q("tx6_topic_count")
def tx6(spark: SparkSession, d: str) -> DataFrame:
    """By number of topics: coherence of their terms, and the error of held-out documents; the number at the first peak."""
    docs, vocabulary, _ = vectorised(spark, d)
    c = materialize(T.weighted(docs, "recall_id", vocabulary), "cells")
    held = materialize(docs.select("recall_id", "terms"), "terms")
    outside = F.pmod(F.xxhash64("recall_id", F.lit("held")), F.lit(3)) == 0

    # the models of all numbers of topics share their passes over the documents
    whole, inside = (T.Factors(x, "recall_id", "term", "w") for x in (c, c.where(~outside)))
    beyond = T.Factors(c.where(outside), "recall_id", "term", "w", inside.terms)
    fits = T.factorise_each(whole, SWEEP, 8)
    errors = T.residuals(beyond, T.factorise_each(inside, SWEEP, 8))
    top = spark.createDataFrame([((k, i), t) for k, h in zip(SWEEP, fits) for i, ts in enumerate(T.top_terms(h, whole.terms, 10)) for t in ts], "topic struct<k int, i int>, term string")
    means = npmi(held, "recall_id", "terms", top).groupBy("topic.k").agg(F.avg("npmi").alias("npmi"))
    coherence = {r["k"]: r["npmi"] for r in means.collect()}  # a row per number of topics
    scores = spark.createDataFrame([(k, float(coherence[k]), e) for k, e in zip(SWEEP, errors)], "k int, coherence double, held_out_error double")
    best = first_peak(scores, "k", "coherence").first()["k"]
    return scores.withColumn("chosen", F.col("k") == best)


@Q("tx7_dominant_topics")
def tx7(spark: SparkSession, d: str) -> DataFrame:
    """Share and lift of each document's dominant topic by period, topics named by their terms."""
    w, h, terms = nmf(spark, d)
    names = spark.createDataFrame([(i, T.topic_name(ts)) for i, ts in enumerate(T.top_terms(h, terms))], "topic int, name string")
    best = w.select("recall_id", (F.array_position("weights", F.array_max("weights")) - 1).cast("int").alias("topic")).join(corpus(spark, d).select("recall_id", "period"), "recall_id")
    c = crosstab(best, "topic", "period")
    return c.join(F.broadcast(names), "topic").select("topic", "name", "period", "n", F.col("col_share").alias("share"), "lift")  # TOPICS rows


@Q("tx7_top_documents")
def tx7b(spark: SparkSession, d: str) -> DataFrame:
    """The three documents in which each topic weighs most."""
    w, _, _ = nmf(spark, d)
    w = materialize(w, "weights")
    top = [w.select(F.lit(k).alias("topic"), "recall_id", F.get("weights", F.lit(k)).alias("weight")).orderBy(F.desc("weight"), "recall_id").limit(3) for k in range(TOPICS)]
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "recall_id"))
    return union_all(top).select("topic", rank.alias("rank"), "recall_id")  # three rows a topic


@Q("ct12_bootstrap_difference")
def ct12b(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap of a difference of two shares, with the probability that it isn't positive."""
    g = events(spark, d, "year", "sales_channel").groupBy((F.col("year") >= 2005).alias("late")).agg(F.count_if(F.col("sales_channel") == "online_only").alias("k"), F.count("*").alias("n")).collect()
    k, n = ({bool(r["late"]): int(r[c]) for r in g if r["late"] is not None} for c in ("k", "n"))

    def draw(rng):
        return {"d": rng.binomial(n[True], k[True] / n[True]) / n[True] - rng.binomial(n[False], k[False] / n[False]) / n[False]}

    reps = replicates(spark, 500, 4, draw, ["d"])
    return reps.agg(F.avg("d").alias("difference"), F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"), F.avg((F.col("d") <= 0).cast("int")).alias("p_not_positive"))
