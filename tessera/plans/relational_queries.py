"""Queries of joins, aggregations, windows, ordering, set operations and the tables behind figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import period_of
from tessera.operators import series, shares
from tessera.plans.registry import Registry
from tessera.plans.text_queries import _EXPO, _PERIOD, EDGES, E
from tessera.session import table
from tessera.sources.events import events, exposure

REGISTRY = Registry()
Q = REGISTRY.query


def r6(c, alias: str):
    return F.round(c, 6).alias(alias)


# --- rates and joins -------------------------------------------------------------------------------------------------
_RATE = f"""{E}, {_EXPO}, n AS (SELECT primary_country AS country, year, count(DISTINCT recall_id) AS events FROM e WHERE primary_country IS NOT NULL GROUP BY ALL),
 p AS (SELECT x.country, x.year, coalesce(events, 0) AS events, volume, value FROM x LEFT JOIN n ON x.country = n.country AND x.year = n.year WHERE x.country <> 'World')"""


def rate_base(spark: SparkSession, d: str) -> DataFrame:
    """(country, year, events, volume, value): the exposure panel with event counts, 0 where there are none."""
    n = events(spark, d, "primary_country", "year").where("primary_country IS NOT NULL").groupBy(F.col("primary_country").alias("country"), "year").agg(F.count("*").alias("events"))
    return exposure(spark, d).where("country <> 'World'").join(n, ["country", "year"], "left").na.fill(0, ["events"])


@Q("rate_panel", f"""{_RATE} SELECT country, {_PERIOD} AS period, CAST(sum(events) AS BIGINT) AS events, round(sum(volume), 4) AS volume, round(sum(events) / nullif(sum(volume), 0) * 1e9, 6) AS rate FROM p GROUP BY ALL""")
def rate_panel(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15: events per unit of exposure by country and period."""
    p = rate_base(spark, d).groupBy("country", period_of(F.col("year"), EDGES).alias("period")).agg(F.sum("events").alias("events"), F.sum("volume").alias("v"))
    return p.select("country", "period", "events", F.round("v", 4).alias("volume"), r6(F.try_divide(F.col("events"), F.col("v")) * 1e9, "rate"))


@Q("jn1_left_enrichment", f"{E} SELECT e.recall_id, d.n FROM e LEFT JOIN (SELECT recall_id, count(*) AS n FROM documents GROUP BY 1) d ON e.recall_id = d.recall_id")
def jn1(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents", ["recall_id"]).groupBy("recall_id").agg(F.count("*").alias("n"))
    return events(spark, d).join(n, "recall_id", "left")


@Q("jn2_full_outer", f"WITH {_EXPO} SELECT country, year, round(volume, 4) AS volume, round(value, 4) AS value FROM x")
def jn2(spark: SparkSession, d: str) -> DataFrame:
    return exposure(spark, d).select("country", "year", F.round("volume", 4).alias("volume"), F.round("value", 4).alias("value"))


@Q("jn3_panel_zero_fill", f"{_RATE} SELECT country, year, events FROM p")
def jn3(spark: SparkSession, d: str) -> DataFrame:
    return rate_base(spark, d).select("country", "year", "events")


@Q("jn4_inner_on_period", f"""{E}, a AS (SELECT period, count(*) AS n FROM e WHERE period IS NOT NULL GROUP BY 1), b AS (SELECT period, avg(CAST(is_violation AS INTEGER)) AS share FROM e WHERE is_childrens AND period IS NOT NULL GROUP BY 1)
 SELECT period, n, round(share, 6) AS share FROM a JOIN b USING (period)""")
def jn4(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "period", "is_violation", "is_childrens").where("period IS NOT NULL")
    child = e.where("is_childrens").groupBy("period").agg(r6(shares.share(F.col("is_violation")), "share"))
    return e.groupBy("period").agg(F.count("*").alias("n")).join(child, "period")


@Q("jn5_counts_and_shares", f"{E} SELECT sales_channel, count(*) AS n_all, count(*) FILTER (WHERE is_violation) AS n_violation, round(avg(CAST(is_violation AS INTEGER)), 6) AS share_violation, round(avg(CAST(injuries_reported AS INTEGER)), 6) AS share_injury FROM e GROUP BY 1")
def jn5(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("is_violation")
    return events(spark, d, "sales_channel", "is_violation", "injuries_reported").groupBy("sales_channel").agg(
        F.count("*").alias("n_all"), F.count_if(v).alias("n_violation"), r6(shares.share(v), "share_violation"), r6(shares.share(F.col("injuries_reported")), "share_injury")
    )


@Q("jn6_calendar_spine", f"""{E} SELECT CAST(y AS INTEGER) AS year, segment, count(recall_id) AS n FROM range(1974, 2027) t(y) CROSS JOIN (SELECT DISTINCT segment FROM e WHERE segment IS NOT NULL) s
 LEFT JOIN (SELECT recall_id, year AS ey, segment AS es FROM e) f ON ey = y AND es = segment GROUP BY ALL""")
def jn6(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "year", "segment").where("segment IS NOT NULL")
    return shares.spine(e.groupBy("year", "segment").agg(F.count("*").alias("n")), "year", 1974, 2026, ["n"], e.select("segment").distinct())


@Q("jn7_sensitivity", f"""{E}, a AS (SELECT segment, avg(price_usd) AS x FROM e GROUP BY 1), b AS (SELECT segment, avg(price_usd) AS x FROM e WHERE NOT is_false_positive GROUP BY 1)
 SELECT a.segment, round(a.x, 6) AS x_all, round(b.x, 6) AS x_strict, round(100 * (b.x - a.x) / a.x, 6) AS change FROM a JOIN b ON a.segment = b.segment""")
def jn7(spark: SparkSession, d: str) -> DataFrame:
    """The same table from all and from the strict selection, side by side."""
    e = events(spark, d, "segment", "price_usd", "is_false_positive")
    a, b = (x.groupBy("segment").agg(F.avg("price_usd").alias(n)) for x, n in ((e, "a"), (e.where(~F.col("is_false_positive")), "b")))
    return a.join(b, "segment").select("segment", r6("a", "x_all"), r6("b", "x_strict"), r6(100 * (F.col("b") - F.col("a")) / F.col("a"), "change"))


@Q("jn8_lookup", f"{E} SELECT iso_alpha3, count(*) AS n FROM e JOIN country_reference ON primary_country = country_name GROUP BY 1")
def jn8(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "country_reference", ["country_name", "iso_alpha3"])
    return events(spark, d, "primary_country").join(ref, F.col("primary_country") == F.col("country_name")).groupBy("iso_alpha3").agg(F.count("*").alias("n"))


@Q("jn11_reattach", f"{E}, m AS (SELECT recall_id, avg(n_chars) AS chars FROM documents WHERE recall_id IS NOT NULL GROUP BY 1) SELECT recall_id, round(chars, 6) AS chars, year, segment FROM m LEFT JOIN e USING (recall_id)")
def jn11(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents", ["recall_id", "n_chars"]).where("recall_id IS NOT NULL").groupBy("recall_id").agg(r6(F.avg("n_chars"), "chars"))
    return m.join(events(spark, d, "year", "segment"), "recall_id", "left")


@Q("jn12_anti", f"{E} SELECT DISTINCT recallid AS recall_id FROM cpsc_recalls_all WHERE recallid NOT IN (SELECT recall_id FROM e)")
def jn12(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "cpsc_recalls_all", ["recallid"]).select(F.col("recallid").alias("recall_id")).distinct()
    return raw.join(table(spark, d, "apparel_recalls_v2", ["recall_id"]), "recall_id", "left_anti")


# --- aggregation -----------------------------------------------------------------------------------------------------
@Q("agg1_counts", f"{E} SELECT hazard_category, sales_channel, count(*) AS n FROM e GROUP BY ALL")
def agg1(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "hazard_category", "sales_channel").groupBy("hazard_category", "sales_channel").agg(F.count("*").alias("n"))


@Q("agg2_collapse_keys", "SELECT country, year, count(*) AS rows_in, round(coalesce(sum(data_value), 0), 4) AS total FROM exposure_volume GROUP BY ALL")
def agg2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "exposure_volume").groupBy("country", "year").agg(F.count("*").alias("rows_in"), F.round(F.coalesce(F.sum("data_value"), F.lit(0.0)), 4).alias("total"))


@Q("agg3_distinct", f"{E} SELECT year, count(DISTINCT firm_key) AS firms, count(DISTINCT primary_country) AS countries FROM e GROUP BY 1")
def agg3(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "year", "firm_key", "primary_country").groupBy("year").agg(F.count_distinct("firm_key").alias("firms"), F.count_distinct("primary_country").alias("countries"))


@Q("agg4_conditional_share", f"{E} SELECT period, round(avg(CAST(sales_channel = 'online_only' AS INTEGER)), 6) AS online, round(avg(CAST(injuries_reported AS INTEGER)) FILTER (WHERE is_childrens), 6) AS child_injury FROM e GROUP BY 1")
def agg4(spark: SparkSession, d: str) -> DataFrame:
    child = F.when(F.col("is_childrens"), F.col("injuries_reported"))
    return events(spark, d, "period", "sales_channel", "injuries_reported", "is_childrens").groupBy("period").agg(r6(shares.share(F.col("sales_channel") == "online_only"), "online"), r6(shares.share(child), "child_injury"))


@Q("agg5_share_in_parent", f"{E}, n AS (SELECT period, hazard_category, count(*) AS n FROM e GROUP BY ALL) SELECT period, hazard_category, n, round(n / sum(n) OVER (PARTITION BY period), 6) AS share FROM n")
def agg5(spark: SparkSession, d: str) -> DataFrame:
    n = events(spark, d, "period", "hazard_category").groupBy("period", "hazard_category").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("period")), 6))


_CT = "n AS (SELECT hazard_category, sales_channel, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY hazard_category) AS r, sum(n) OVER (PARTITION BY sales_channel) AS c, sum(n) OVER () AS t FROM n)"


@Q("agg6_crosstab_lift", f"{E}, {_CT} SELECT hazard_category, sales_channel, n, round(n / r, 6) AS row_share, round(n / c, 6) AS col_share, round(n / t, 6) AS total_share, round(n * t / (r * c), 6) AS lift FROM t")
def agg6(spark: SparkSession, d: str) -> DataFrame:
    c = shares.crosstab(events(spark, d, "hazard_category", "sales_channel"), "hazard_category", "sales_channel")
    return c.select("hazard_category", "sales_channel", "n", *[r6(x, x) for x in ("row_share", "col_share", "total_share", "lift")])


CHANNELS = ["online_only", "store_only", "mixed", "unknown"]


@Q("agg7_pivot", f"{E} SELECT hazard_category, " + ", ".join(f"count(*) FILTER (WHERE sales_channel = '{c}') AS {c}" for c in CHANNELS) + " FROM e GROUP BY 1")
def agg7(spark: SparkSession, d: str) -> DataFrame:
    return shares.wide(events(spark, d, "hazard_category", "sales_channel"), "hazard_category", "sales_channel", CHANNELS, F.count(F.lit(1)))


@Q("agg8_unpivot", "SELECT firm_id, unnest(['median_units', 'median_price', 'mean_year']) AS name, unnest([median_units, median_price, mean_year]) AS value FROM repeat_offenders")
def agg8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repeat_offenders").unpivot(["firm_id"], ["median_units", "median_price", "mean_year"], "name", "value")


@Q("agg9_entity_profile", f"{E} SELECT firm_key, count(*) AS n, min(year) AS first_year, max(year) AS last_year, round(avg(price_usd), 6) AS mean_price, round(median(units), 6) AS median_units FROM e WHERE firm_key IS NOT NULL GROUP BY 1")
def agg9(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "firm_key", "year", "price_usd", "units").where("firm_key IS NOT NULL")
    return e.groupBy("firm_key").agg(
        F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), r6(F.avg("price_usd"), "mean_price"), r6(F.median("units"), "median_units")
    )


@Q("agg10_mode", f"{E}, n AS (SELECT firm_key, primary_country AS v, count(*) AS n FROM e WHERE firm_key IS NOT NULL AND primary_country IS NOT NULL GROUP BY ALL) SELECT firm_key, v AS mode FROM n QUALIFY row_number() OVER (PARTITION BY firm_key ORDER BY n DESC, v) = 1")
def agg10(spark: SparkSession, d: str) -> DataFrame:
    return shares.mode_of(events(spark, d, "firm_key", "primary_country").where("firm_key IS NOT NULL"), "firm_key", "primary_country")


@Q("agg11_quantiles", f"{E} SELECT segment, round(quantile_cont(price_usd, 0.25), 6) AS q25, round(quantile_cont(price_usd, 0.5), 6) AS q50, round(quantile_cont(price_usd, 0.975), 6) AS q975 FROM e GROUP BY 1")
def agg11(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "segment", "price_usd").groupBy("segment").agg(*[r6(F.percentile("price_usd", F.lit(q)), n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.975, "q975"))])


@Q("agg12_weighted_share", f"{E} SELECT period, round(sum(units) FILTER (WHERE is_violation) / sum(units), 6) AS weighted, round(median(units) FILTER (WHERE is_violation), 6) AS median_violation FROM e WHERE units IS NOT NULL GROUP BY 1")
def agg12(spark: SparkSession, d: str) -> DataFrame:
    hit = F.when(F.col("is_violation"), F.col("units"))
    return events(spark, d, "period", "units", "is_violation").where("units IS NOT NULL").groupBy("period").agg(r6(F.try_divide(F.sum(hit), F.sum("units")), "weighted"), r6(F.median(hit), "median_violation"))


COVERED = ["units", "price_usd", "primary_country", "main_fiber", "firm_key", "importers", "description"]


@Q("agg13_coverage", f"{E} SELECT period, count(*) AS n, " + ", ".join(f"round(avg(CAST({c} IS NOT NULL AS INTEGER)), 6) AS {c}" for c in COVERED) + " FROM e GROUP BY 1")
def agg13(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "period", *COVERED).groupBy("period").agg(F.count("*").alias("n"), *[r6(shares.share(F.col(c).isNotNull()), c) for c in COVERED])


_CLASS = {"violation_only": "is_violation AND NOT injuries_reported", "violation_and_injury": "is_violation AND injuries_reported", "injury_only": "NOT is_violation AND injuries_reported", "neither": "NOT is_violation AND NOT injuries_reported"}


@Q("agg14_four_way", f"{E}, y AS (SELECT CAST(y AS INTEGER) AS year, " + ", ".join(f"count(*) FILTER (WHERE recall_id IS NOT NULL AND {p}) AS {c}" for c, p in _CLASS.items()) + ", count(recall_id) AS n FROM range(1974, 2027) t(y) LEFT JOIN (SELECT recall_id, year AS ey, is_violation, injuries_reported FROM e) f ON ey = y GROUP BY 1) SELECT *, round((violation_only + violation_and_injury) / nullif(n, 0), 6) AS share_violation, round((injury_only + violation_and_injury) / nullif(n, 0), 6) AS share_injury FROM y")
def agg14(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "year", "is_violation", "injuries_reported")
    y = shares.spine(e.groupBy("year").agg(*[F.count_if(F.expr(p)).alias(c) for c, p in _CLASS.items()], F.count("*").alias("n")), "year", 1974, 2026, [*_CLASS, "n"])
    return y.select("*", r6(F.try_divide(F.col("violation_only") + F.col("violation_and_injury"), F.col("n")), "share_violation"), r6(F.try_divide(F.col("injury_only") + F.col("violation_and_injury"), F.col("n")), "share_injury"))


@Q("agg16_share_vs_share", f"""{_RATE}, s AS (SELECT country, sum(events) AS ev, sum(value) AS va FROM p GROUP BY 1), t AS (SELECT country, 100 * ev / sum(ev) OVER () AS rec, 100 * va / sum(va) OVER () AS imp FROM s)
 SELECT country, round(rec, 6) AS rec, round(imp, 6) AS imp, round(rec / nullif(imp, 0), 6) AS ratio FROM t WHERE rec >= 1.5 OR imp >= 3""")
def agg16(spark: SparkSession, d: str) -> DataFrame:
    s = rate_base(spark, d).groupBy("country").agg(F.sum("events").alias("ev"), F.sum("value").alias("va"))
    every = Window.partitionBy(F.lit(1))
    t = s.select("country", (100 * F.col("ev") / F.sum("ev").over(every)).alias("rec"), (100 * F.col("va") / F.sum("va").over(every)).alias("imp")).where("rec >= 1.5 OR imp >= 3")
    return t.select("country", r6("rec", "rec"), r6("imp", "imp"), r6(F.try_divide("rec", "imp"), "ratio"))


@Q("agg17_funnel", "SELECT count(DISTINCT recallid) AS raw, count(DISTINCT recallid) FILTER (WHERE recalldate IS NOT NULL) AS dated, count(DISTINCT recallid) FILTER (WHERE len(products) > 0) AS with_products, (SELECT count(DISTINCT recall_id) FROM apparel_recalls_v2) AS textile, (SELECT count(DISTINCT recall_id) FROM apparel_recalls_v2 WHERE NOT is_false_positive) AS kept FROM cpsc_recalls_all")
def agg17(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "cpsc_recalls_all", ["recallid", "recalldate", "products"]).select("recallid", F.col("recalldate").isNotNull().alias("dated"), (F.size("products") > 0).alias("some")).dropDuplicates(["recallid"])
    a = raw.agg(F.count("*").alias("raw"), F.count_if("dated").alias("dated"), F.count_if("some").alias("with_products"))
    b = events(spark, d, "is_false_positive").agg(F.count("*").alias("textile"), F.count_if(~F.col("is_false_positive")).alias("kept"))
    return a.join(F.broadcast(b))  # one row each


_SIZES = f"{E}, z AS (SELECT firm_key, count(*) AS x FROM e WHERE firm_key IS NOT NULL GROUP BY 1)"


def firm_sizes(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "firm_key").where("firm_key IS NOT NULL").groupBy("firm_key").agg(F.count("*").alias("x"))


@Q("agg18_repeats", f"{_SIZES} SELECT x AS n_recalls, count(*) AS firms, round(sum(x) / sum(sum(x)) OVER (), 6) AS share_of_events FROM z GROUP BY 1")
def agg18(spark: SparkSession, d: str) -> DataFrame:
    g = firm_sizes(spark, d).groupBy(F.col("x").alias("n_recalls")).agg(F.count("*").alias("firms"))
    held = F.col("n_recalls") * F.col("firms")
    return g.select("n_recalls", "firms", r6(held / F.sum(held).over(Window.partitionBy(F.lit(1))), "share_of_events"))


@Q("agg19_gini", f"{_SIZES}, r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM z) SELECT round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n), 6) AS gini FROM r")
def agg19(spark: SparkSession, d: str) -> DataFrame:
    return shares.gini(firm_sizes(spark, d), "x").select(r6("gini", "gini"))


@Q("agg20_lorenz", f"{_SIZES}, g AS (SELECT x, count(*) AS m FROM z GROUP BY 1) SELECT round(sum(m) OVER w / sum(m) OVER (), 6) AS p, round(sum(x * m) OVER w / sum(x * m) OVER (), 6) AS l FROM g WINDOW w AS (ORDER BY x) UNION ALL SELECT 0, 0")
def agg20(spark: SparkSession, d: str) -> DataFrame:
    return shares.lorenz(firm_sizes(spark, d), "x").select(r6("p", "p"), r6("l", "l"))


@Q("agg21_top_share", f"{_SIZES}, r AS (SELECT x, row_number() OVER (ORDER BY x DESC) AS i, greatest(1, round_even(0.05 * count(*) OVER (), 0)) AS k FROM z) SELECT round(sum(x) FILTER (WHERE i <= k) / sum(x), 6) AS top5 FROM r")
def agg21(spark: SparkSession, d: str) -> DataFrame:
    """The share of the largest twentieth of firms, from the multiplicities of the sizes."""
    g = firm_sizes(spark, d).groupBy("x").agg(F.count("*").alias("m"))
    g = series.running(g.withColumn("down", -F.col("x")), ["down"], {"upto": "m"})
    n = g.agg(F.greatest(F.lit(1), F.bround(0.05 * F.sum("m"))).alias("k"))
    g = g.join(F.broadcast(n)).select("x", "m", (F.col("upto") - F.col("m")).alias("before"), "k")  # one row
    taken = F.greatest(F.lit(0), F.least(F.col("m"), F.col("k") - F.col("before")))
    return g.agg(r6(F.sum(taken * F.col("x")) / F.sum(F.col("m") * F.col("x")), "top5"))


@Q("agg22_histogram", f"{E} SELECT CAST(least(floor(price_usd / 4), 49) AS INTEGER) AS bin, count(*) AS n FROM e WHERE price_usd BETWEEN 0 AND 200 GROUP BY 1")
def agg22(spark: SparkSession, d: str) -> DataFrame:
    """Fifty bins of equal width, the last one closed."""
    return events(spark, d, "price_usd").where(F.col("price_usd").between(0, 200)).groupBy(F.least(F.floor(F.col("price_usd") / 4), F.lit(49)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


# --- model metrics over a deterministic score ---------------------------------------------------------------------------
_SCORE = "(recall_id * 7919 % 1000) / 1000.0 * 0.5 + CASE WHEN sales_channel = 'online_only' THEN 0.3 ELSE 0.1 END"
_SC = f"{E}, s AS (SELECT recall_id, CAST({_SCORE} AS DOUBLE) AS p, CAST(is_violation AS INTEGER) AS y, price_usd AS t FROM e WHERE is_violation IS NOT NULL)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "sales_channel", "is_violation", "price_usd").where("is_violation IS NOT NULL")
    p = (F.col("recall_id") * 7919 % 1000) / 1000.0 * 0.5 + F.when(F.col("sales_channel") == "online_only", 0.3).otherwise(0.1)
    return e.select("recall_id", p.cast("double").alias("p"), F.col("is_violation").cast("int").alias("y"), F.col("price_usd").alias("t"))


_CAL = f"{_SC}, q AS (SELECT quantile_cont(p, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS edges FROM s), b AS (SELECT len(list_filter(edges, lambda x: x < p)) AS bin, p, y FROM s, q)"


@Q("agg23_calibration", f"{_CAL} SELECT bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM b GROUP BY 1")
def agg23(spark: SparkSession, d: str) -> DataFrame:
    return shares.calibration(scored(spark, d), "y", "p").select(F.col("bin").cast("bigint").alias("bin"), "n", r6("predicted", "predicted"), r6("observed", "observed"))


@Q("agg23_ece", f"{_CAL}, c AS (SELECT bin, count(*) AS n, avg(p) AS a, avg(y) AS o FROM b GROUP BY 1) SELECT round(sum(n * abs(o - a)) / sum(n), 6) AS ece FROM c")
def agg23b(spark: SparkSession, d: str) -> DataFrame:
    return shares.expected_calibration_error(shares.calibration(scored(spark, d), "y", "p")).select(r6("ece", "ece"))


@Q("agg24_classification", f"""{_SC}, h AS (SELECT *, CAST(p >= 0.4 AS INTEGER) AS c FROM s) SELECT count(*) FILTER (WHERE c = 1 AND y = 1) AS tp, count(*) FILTER (WHERE c = 1 AND y = 0) AS fp, count(*) FILTER (WHERE c = 0 AND y = 1) AS fn, count(*) FILTER (WHERE c = 0 AND y = 0) AS tn,
 round(avg(CAST(c = y AS INTEGER)), 6) AS accuracy, round((avg(c) FILTER (WHERE y = 1) + 1 - avg(c) FILTER (WHERE y = 0)) / 2, 6) AS balanced, round(avg((p - y) * (p - y)), 6) AS brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss FROM h""")
def agg24(spark: SparkSession, d: str) -> DataFrame:
    h = scored(spark, d).withColumn("c", (F.col("p") >= 0.4).cast("int"))
    y, c, p = F.col("y"), F.col("c"), F.col("p")
    return h.agg(
        *[F.count_if((c == i) & (y == j)).alias(n) for n, i, j in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))],
        r6(F.avg((c == y).cast("int")), "accuracy"), r6((F.avg(F.when(y == 1, c)) + 1 - F.avg(F.when(y == 0, c))) / 2, "balanced"),
        r6(F.avg((p - y) * (p - y)), "brier"), r6(-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p)), "log_loss"),
    )


@Q("agg24_regression", f"{_SC}, g AS (SELECT t, 60 * p AS f FROM s WHERE t IS NOT NULL), m AS (SELECT avg(t) AS m FROM g) SELECT round(1 - sum((t - f) * (t - f)) / sum((t - m) * (t - m)), 6) AS r2, round(avg(abs(t - f)), 6) AS mae, round(sqrt(avg((t - f) * (t - f))), 6) AS rmse FROM g, m")
def agg24b(spark: SparkSession, d: str) -> DataFrame:
    g = scored(spark, d).where("t IS NOT NULL").select("t", (60 * F.col("p")).alias("f"))
    e2 = (F.col("t") - F.col("f")) * (F.col("t") - F.col("f"))
    return g.agg(r6(1 - F.sum(e2) / (F.var_pop("t") * F.count("t")), "r2"), r6(F.avg(F.abs(F.col("t") - F.col("f"))), "mae"), r6(F.sqrt(F.avg(e2)), "rmse"))


@Q("agg25_ranking", f"""{_SC}, g AS (SELECT p, count(*) AS m, sum(y) AS k FROM s GROUP BY 1), r AS (SELECT *, sum(m) OVER (ORDER BY p) - m + (m + 1) / 2 AS mid, sum(m) OVER (ORDER BY p DESC) AS seen, sum(k) OVER (ORDER BY p DESC) AS hits FROM g)
 SELECT round((sum(k * mid) - sum(k) * (sum(k) + 1) / 2) / (sum(k) * (sum(m) - sum(k))), 6) AS auc, round(sum(k * hits / seen) / sum(k), 6) AS average_precision FROM r""")
def agg25(spark: SparkSession, d: str) -> DataFrame:
    return shares.ranking_metrics(scored(spark, d), "y", "p").select(r6("auc", "auc"), r6("average_precision", "average_precision"))


@Q("agg25_spearman", f"{_SC}, r AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS a, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2 AS b FROM s WHERE t IS NOT NULL) SELECT round(corr(a, b), 6) AS spearman FROM r")
def agg25b(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).where("t IS NOT NULL")
    a, b = (shares.midranks(s, c).select(c, F.col("midrank").alias(f"r_{c}")) for c in ("p", "t"))
    return s.join(a, "p").join(b, "t").agg(r6(F.corr("r_p", "r_t"), "spearman"))


@Q("agg26_fold_summary", f"{_SC}, f AS (SELECT recall_id % 5 AS fold, avg((p - y) * (p - y)) AS b FROM s GROUP BY 1) SELECT count(*) AS folds, round(avg(b), 6) AS mean, round(stddev_samp(b), 6) AS sd, round(avg(b) - 1.96 * stddev_samp(b) / sqrt(count(*)), 6) AS lo, round(avg(b) + 1.96 * stddev_samp(b) / sqrt(count(*)), 6) AS hi FROM f")
def agg26(spark: SparkSession, d: str) -> DataFrame:
    f = scored(spark, d).groupBy((F.col("recall_id") % 5).alias("fold")).agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("b"))
    half = 1.96 * F.stddev_samp("b") / F.sqrt(F.count("b"))
    return f.agg(F.count("*").alias("folds"), r6(F.avg("b"), "mean"), r6(F.stddev_samp("b"), "sd"), r6(F.avg("b") - half, "lo"), r6(F.avg("b") + half, "hi"))


@Q("agg27_pool_predictions", f"{_SC}, r AS (SELECT recall_id, y, p + k * 0.01 AS p FROM s, range(3) t(k)) SELECT recall_id, min(y) AS y, round(avg(p), 6) AS p FROM r GROUP BY 1")
def agg27(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of three repeats pooled per row."""
    r = scored(spark, d).select("recall_id", "y", "p", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return r.groupBy("recall_id").agg(F.min("y").alias("y"), r6(F.avg(F.col("p") + F.col("k") * 0.01), "p"))


@Q("agg28_term_frequencies", f"{E}, w AS (SELECT period, recall_id, unnest(regexp_extract_all(lower(title), '[a-z][a-z\\-]+')) AS term FROM e) SELECT period, term, count(*) AS tf, count(DISTINCT recall_id) AS df FROM w GROUP BY ALL")
def agg28(spark: SparkSession, d: str) -> DataFrame:
    w = events(spark, d, "period", "title").select("period", "recall_id", F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"[a-z][a-z\-]+"), F.lit(0))).alias("term"))
    each = w.groupBy("period", "term", "recall_id").agg(F.count("*").alias("n"))
    return each.groupBy("period", "term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@Q("agg29_set_difference", f"{E}, a AS (SELECT DISTINCT trim(unnest(string_split(countries_raw, ';'))) AS v FROM e) SELECT v, v NOT IN (SELECT country_name FROM country_reference) AS only_before FROM a WHERE v <> ''")
def agg29(spark: SparkSession, d: str) -> DataFrame:
    a = events(spark, d, "countries_raw").select(F.explode(F.split("countries_raw", ";")).alias("v")).select(F.trim("v").alias("v")).where("v <> ''").distinct()
    ref = table(spark, d, "country_reference").select(F.col("country_name").alias("v"), F.lit(False).alias("only_before"))
    return a.join(ref, "v", "left").na.fill(True, ["only_before"])


# --- windows ---------------------------------------------------------------------------------------------------------
_YEARLY = f"{E}, y AS (SELECT CAST(y AS INTEGER) AS year, count(recall_id) AS n, count(*) FILTER (WHERE v) AS k FROM range(1974, 2027) t(y) LEFT JOIN (SELECT recall_id, year AS ey, is_violation AS v FROM e) f ON ey = y GROUP BY 1)"


def yearly(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "year", "is_violation").groupBy("year").agg(F.count("*").alias("n"), F.count_if("is_violation").alias("k"))
    return shares.spine(e, "year", 1974, 2026, ["n", "k"])


@Q("win1_centred_mean", f"{_YEARLY} SELECT year, n, CASE WHEN count(*) OVER w = 5 THEN round(avg(n) OVER w, 6) END AS mean5 FROM y WINDOW w AS (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def win1(spark: SparkSession, d: str) -> DataFrame:
    """FIG-1: the annual series with its five-year centred mean."""
    return yearly(spark, d).select("year", "n", r6(series.centred_mean("n", "year", 2), "mean5"))


@Q("win2_rolling_ratio", f"{_YEARLY} SELECT year, round(sum(k) OVER w / nullif(sum(n) OVER w, 0), 6) AS ratio, sum(n) OVER w >= 8 AS plotted FROM y WINDOW w AS (ORDER BY year ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def win2(spark: SparkSession, d: str) -> DataFrame:
    enough = F.sum("n").over(series.ordered("year").rowsBetween(-3, 3)) >= 8
    return yearly(spark, d).select("year", r6(series.centred_ratio("k", "n", "year", 3), "ratio"), enough.alias("plotted"))


@Q("win3_suspect_years", f"WITH {_EXPO}, w AS (SELECT year, value FROM x WHERE country = 'World') SELECT a.year, round(abs(a.value - b.value) / b.value, 9) AS change FROM w a JOIN w b ON b.year = a.year - 1 WHERE abs(a.value - b.value) / b.value < 0.001")
def win3(spark: SparkSession, d: str) -> DataFrame:
    return series.suspect_repeats(exposure(spark, d).where("country = 'World'"), "year", "value").select("year", F.round("change", 9).alias("change"))


@Q("win4_prior_events", f"{E} SELECT recall_id, CASE WHEN firm_key IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY firm_key ORDER BY recall_date ASC NULLS LAST, recall_id) - 1 END AS prior FROM e")
def win4(spark: SparkSession, d: str) -> DataFrame:
    return series.prior_events(events(spark, d, "firm_key", "recall_date"), "firm_key", "recall_date", "recall_id").select("recall_id", F.col("prior").cast("bigint").alias("prior"))


@Q("win5_running_sum", f"{_YEARLY} SELECT year, CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS total FROM y")
def win5(spark: SparkSession, d: str) -> DataFrame:
    return yearly(spark, d).select("year", F.sum("n").over(series.ordered("year").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


@Q("win6_differences", f"{_YEARLY} SELECT year, n - lag(n) OVER (ORDER BY year) AS change FROM y")
def win6(spark: SparkSession, d: str) -> DataFrame:
    return yearly(spark, d).select("year", (F.col("n") - F.lag("n").over(series.ordered("year"))).alias("change"))


@Q("win7_ranked_terms", f"{E}, n AS (SELECT hazard_category, primary_country AS c, count(*) AS n FROM e WHERE primary_country IS NOT NULL GROUP BY ALL) SELECT hazard_category, c, n, row_number() OVER (PARTITION BY hazard_category ORDER BY n DESC, c) AS rank FROM n QUALIFY rank <= 5")
def win7(spark: SparkSession, d: str) -> DataFrame:
    n = events(spark, d, "hazard_category", "primary_country").where("primary_country IS NOT NULL").groupBy("hazard_category", F.col("primary_country").alias("c")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("hazard_category").orderBy(F.desc("n"), "c"))).where("rank <= 5")


@Q("win8_crossings", f"{_YEARLY}, s AS (SELECT year, sign(n - 20) AS s, lag(sign(n - 20)) OVER (ORDER BY year) AS b FROM y) SELECT year, CASE WHEN b < 0 AND s >= 0 THEN 'up' ELSE 'down' END AS direction FROM s WHERE (b < 0 AND s >= 0) OR (b > 0 AND s <= 0)")
def win8(spark: SparkSession, d: str) -> DataFrame:
    return series.crossings(yearly(spark, d), "year", "n", 20)


_CUM = f"{_YEARLY}, c AS (SELECT year, CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS v FROM y)"


@Q("win9_elbow", f"{_CUM}, g AS (SELECT year, lead(v) OVER (ORDER BY year) - v AS g FROM c) SELECT min(year) AS year FROM g WHERE g < 0.1 * (SELECT max(g) FROM g)")
def win9(spark: SparkSession, d: str) -> DataFrame:
    total = yearly(spark, d).select("year", F.sum("n").over(series.ordered("year").rowsBetween(Window.unboundedPreceding, 0)).alias("v"))
    return series.elbow(total, "year", "v")


@Q("win10_first_peak", f"{_YEARLY}, s AS (SELECT year, n, max(CASE WHEN n < b - 0.005 THEN 1 ELSE 0 END) OVER (ORDER BY year) AS stopped FROM (SELECT *, lag(n) OVER (ORDER BY year) AS b FROM y)) SELECT year FROM s WHERE stopped = 0 ORDER BY n DESC, year LIMIT 1")
def win10(spark: SparkSession, d: str) -> DataFrame:
    return series.first_peak(yearly(spark, d), "year", "n")


@Q("win11_midranks", f"{E} SELECT recall_id, rank() OVER (ORDER BY price_usd) + (count(*) OVER (PARTITION BY price_usd) - 1) / 2 AS midrank FROM e WHERE price_usd IS NOT NULL")
def win11(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "price_usd").where("price_usd IS NOT NULL")
    return e.join(shares.midranks(e, "price_usd"), "price_usd").select("recall_id", "midrank")


# --- order, sets, figures --------------------------------------------------------------------------------------------
@Q("srt1_sorted", "SELECT country_name, iso_alpha3 FROM country_reference ORDER BY iso_alpha3 NULLS LAST, country_name")
def srt1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "country_reference", ["country_name", "iso_alpha3"]).orderBy(F.asc_nulls_last("iso_alpha3"), "country_name")


@Q("srt2_top_k", f"{_SIZES} SELECT firm_key, x FROM z ORDER BY x DESC, firm_key LIMIT 20")
def srt2(spark: SparkSession, d: str) -> DataFrame:
    return firm_sizes(spark, d).orderBy(F.desc("x"), "firm_key").limit(20)


@Q("srt3_arg_max", f"{E} SELECT segment, arg_max(recall_id, (price_usd, recall_id)) AS dearest, arg_min(recall_id, (price_usd, recall_id)) AS cheapest FROM e WHERE price_usd IS NOT NULL GROUP BY 1")
def srt3(spark: SparkSession, d: str) -> DataFrame:
    by = F.struct("price_usd", "recall_id")
    return events(spark, d, "segment", "price_usd").where("price_usd IS NOT NULL").groupBy("segment").agg(F.max_by("recall_id", by).alias("dearest"), F.min_by("recall_id", by).alias("cheapest"))


@Q("srt4_seeded_sample")
def srt4(spark: SparkSession, d: str) -> DataFrame:
    """Sixty rows without replacement, the same for the same seed: the smallest keyed hashes."""
    return events(spark, d, "title").orderBy(F.xxhash64("recall_id", F.lit(11))).limit(60)


@Q("set1_union_tagged", f"{E} SELECT year, 'early' AS era FROM e WHERE year < 2005 UNION ALL SELECT year, 'late' FROM e WHERE year >= 2005")
def set1(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "year")
    return shares.union_all([e.where("year < 2005").select("year", F.lit("early").alias("era")), e.where("year >= 2005").select("year", F.lit("late").alias("era"))])


_AB = f"{E}, a AS (SELECT DISTINCT firm_key AS k FROM e WHERE is_violation AND firm_key IS NOT NULL), b AS (SELECT DISTINCT firm_key AS k FROM e WHERE injuries_reported AND firm_key IS NOT NULL)"


@Q("set2_key_sets", f"{_AB} SELECT 'both' AS part, k FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'only_a', k FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'any', k FROM (FROM a UNION FROM b)")
def set2(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "firm_key", "is_violation", "injuries_reported").where("firm_key IS NOT NULL")
    a, b = (e.where(c).select(F.col("firm_key").alias("k")) for c in ("is_violation", "injuries_reported"))
    parts = {"both": a.intersect(b), "only_a": a.subtract(b), "any": a.union(b).distinct()}
    return shares.union_all([v.select(F.lit(n).alias("part"), "k") for n, v in parts.items()])


@Q("set3_first_per_key", f"{E} SELECT firm_key, arg_min(title, recall_id) AS title FROM e WHERE firm_key IS NOT NULL GROUP BY 1")
def set3(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "firm_key", "title").where("firm_key IS NOT NULL").groupBy("firm_key").agg(F.min_by("title", "recall_id").alias("title"))


@Q("fig1_annual_by_segment", f"""{E}, y AS (SELECT CAST(y AS INTEGER) AS year, segment, count(recall_id) AS n FROM range(1974, 2027) t(y) CROSS JOIN (SELECT DISTINCT segment FROM e WHERE segment IS NOT NULL) s LEFT JOIN (SELECT recall_id, year AS ey, segment AS es FROM e) f ON ey = y AND es = segment GROUP BY ALL)
 SELECT year, segment, n, CASE WHEN count(*) OVER w = 5 THEN round(avg(n) OVER w, 6) END AS mean5 FROM y WINDOW w AS (PARTITION BY segment ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def fig1(spark: SparkSession, d: str) -> DataFrame:
    """Every year of every segment with its five-year centred mean."""
    return jn6(spark, d).select("year", "segment", "n", r6(series.centred_mean("n", "year", 2, ["segment"]), "mean5"))


@Q("fig5_share_matrix", f"""{E}, n AS (SELECT hazard_category AS h, sales_channel AS c, count(*) AS n FROM e WHERE hazard_category IS NOT NULL AND sales_channel IS NOT NULL GROUP BY ALL), t AS (SELECT h, sum(n) AS t FROM n GROUP BY 1)
 SELECT h AS hazard_category, {", ".join(f"round(coalesce(sum(n) FILTER (WHERE c = '{c}'), 0) / max(t), 6) AS {c}" for c in CHANNELS)} FROM n JOIN t USING (h) GROUP BY 1""")
def fig5(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of channel shares within each hazard, absent pairs being 0."""
    e = events(spark, d, "hazard_category", "sales_channel").where("hazard_category IS NOT NULL AND sales_channel IS NOT NULL")
    c = shares.wide(shares.crosstab(e, "hazard_category", "sales_channel"), "hazard_category", "sales_channel", CHANNELS, F.first("row_share"))
    return c.select("hazard_category", *[F.coalesce(F.round(x, 6), F.lit(0.0)).alias(x) for x in CHANNELS])


@Q("fig2_first_pivot", f"{E} SELECT archetype, " + ", ".join(f"min(recall_id) FILTER (WHERE segment = '{s}') AS {s}" for s in ("apparel", "home_textile")) + ", count(*) AS total FROM e GROUP BY 1")
def fig2(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "archetype", "segment")
    first = e.groupBy("archetype").pivot("segment", ["apparel", "home_textile"]).agg(F.min("recall_id"))
    return first.join(e.groupBy("archetype").agg(F.count("*").alias("total")), "archetype")


@Q("fig3_density", f"""{E}, h AS (SELECT CAST(b AS INTEGER) AS bin, count(x) AS n FROM range(0, 60) t(b) LEFT JOIN (SELECT least(floor((log10(price_usd) - 0) * 20), 59) AS x FROM e WHERE price_usd >= 1) f ON x = b GROUP BY 1)
 SELECT bin, n, CASE WHEN count(*) OVER w = 9 THEN round(avg(n) OVER w, 6) END AS smooth FROM h WINDOW w AS (ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def fig3(spark: SparkSession, d: str) -> DataFrame:
    """Histogram on a log scale with a nine-point moving average."""
    n = events(spark, d, "price_usd").where("price_usd >= 1").groupBy(F.least(F.floor(F.log10("price_usd") * 20), F.lit(59)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return shares.spine(n, "bin", 0, 59, ["n"]).select("bin", "n", r6(series.centred_mean("n", "bin", 4), "smooth"))


@Q("fig6_display_filter", f"{_RATE} SELECT country, CAST(sum(events) AS BIGINT) AS events FROM p GROUP BY 1 HAVING sum(events) >= 2 OR sum(value) >= 2e9")
def fig6(spark: SparkSession, d: str) -> DataFrame:
    return rate_base(spark, d).groupBy("country").agg(F.sum("events").alias("events"), F.sum("value").alias("v")).where("events >= 2 OR v >= 2e9").select("country", "events")


@Q("fig7_residual_group", f"{E} SELECT period, count(*) FILTER (WHERE archetype IN ('robe', 'nightgown')) AS listed, count(*) FILTER (WHERE coalesce(archetype, '') NOT IN ('robe', 'nightgown')) AS other, round(avg(CAST(archetype_can_be_tight = false AS INTEGER)), 6) AS ineligible FROM e GROUP BY 1")
def fig7(spark: SparkSession, d: str) -> DataFrame:
    listed = F.coalesce("archetype", F.lit("")).isin("robe", "nightgown")
    return events(spark, d, "period", "archetype", "archetype_can_be_tight").groupBy("period").agg(
        F.count_if(listed).alias("listed"), F.count_if(~listed).alias("other"), r6(shares.share(F.col("archetype_can_be_tight") == F.lit(False)), "ineligible")
    )


@Q("fig8_regime_spans", f"{E}, s AS (SELECT period, min(year) AS first_year FROM e WHERE period IS NOT NULL GROUP BY 1) SELECT period, first_year, coalesce(lead(first_year) OVER (ORDER BY first_year) - 1, 2026) AS last_year FROM s")
def fig8(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d, "period", "year").where("period IS NOT NULL").groupBy("period").agg(F.min("year").alias("first_year"))
    return s.withColumn("last_year", F.coalesce(F.lead("first_year").over(series.ordered("first_year")) - 1, F.lit(2026)))


@Q("str12_keys_per_spelling", f"{E} SELECT firm_key, count(DISTINCT firm) AS spellings FROM e WHERE firm_key IS NOT NULL GROUP BY 1")
def spellings(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "firm_key", "firm").where("firm_key IS NOT NULL")
    return e.groupBy("firm_key").agg(F.count_distinct("firm").alias("spellings"))
