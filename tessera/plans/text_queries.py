"""Queries of sources, predicates, projections and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.registry import Registry
from tessera.session import table
from tessera.sources.events import events, exposure, flat_events, once, raw_events, rows

REGISTRY = Registry()
Q = REGISTRY.query

E = "WITH e AS (SELECT * FROM apparel_recalls_v2 QUALIFY row_number() OVER (PARTITION BY recall_id ORDER BY loaded_at) = 1)"
R = "WITH r AS (SELECT * FROM cpsc_recalls_all QUALIFY row_number() OVER (PARTITION BY recallid) = 1)"


def quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def case_sql(expr: str, rules: list[tuple], default: str = "NULL") -> str:
    """The CASE expression of ordered rules."""
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, {quoted(p)}) THEN '{label}'" for label, p, *_ in rules) + f" ELSE {default} END"


# --- sources ---------------------------------------------------------------------------------------------------------
def _list_sql(col: str, field: str) -> str:
    return f"list_filter(list_transform(coalesce({col}, []), lambda x: trim(x.{field})), lambda v: v <> '')"


@Q(
    "src2_flat_events",
    f"""{R} SELECT recallid AS recall_id, substr(recalldate, 1, 10) AS recall_date, try_cast(substr(recalldate, 1, 4) AS INTEGER) AS year,
 coalesce(array_to_string({_list_sql('products', 'name')}, ' | '), '') AS products, coalesce(array_to_string({_list_sql('retailers', 'name')}, ' | '), '') AS retailers,
 coalesce(array_to_string(list_sort(list_distinct({_list_sql('remedyoptions', 'option')})), ';'), '') AS remedy_options,
 coalesce(array_to_string(list_sort(list_distinct({_list_sql('manufacturercountries', 'country')})), ';'), '') AS countries FROM r""",
)
def src2(spark: SparkSession, d: str) -> DataFrame:
    raw = raw_events(spark, d, *[c for c in table(spark, d, "cpsc_recalls_all").columns])
    return flat_events(raw).select("recall_id", "recall_date", "year", "products", "retailers", "remedy_options", "countries")


@Q("src7_dependent_result", f"""{E}, y AS (SELECT year, count(*) AS n FROM e GROUP BY year) SELECT year, n, n / sum(n) OVER () AS share FROM y""")
def src7(spark: SparkSession, d: str) -> DataFrame:
    """One step's table as the input of the next."""
    yearly = events(spark, d, "year").groupBy("year").agg(F.count("*").alias("n"))
    total = yearly.agg(F.sum("n").alias("all"))
    return yearly.join(F.broadcast(total)).select("year", "n", (F.col("n") / F.col("all")).alias("share"))  # one row


# --- filters ---------------------------------------------------------------------------------------------------------
_RULES = [("excluded", X.EXCLUDED), ("apparel", X.APPAREL), ("home_textile", X.HOME_TEXTILE)]
_RULE_SQL = case_sql("t", _RULES, "'unmatched'")


@Q("fil1_ordered_rules", f"""{R}, t AS (SELECT lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(array_to_string(list_transform(coalesce(products, []), lambda x: coalesce(x.name, '')), ' '), '')) AS t FROM r)
 SELECT {_RULE_SQL} AS rule, count(*) AS n FROM t GROUP BY 1""")
def fil1(spark: SparkSession, d: str) -> DataFrame:
    """Exclusion before inclusion over title, description and product names, with a counter per rule."""
    names = F.array_join(F.transform(F.coalesce("products", F.array()), lambda p: F.coalesce(p["name"], F.lit(""))), " ")
    t = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")), F.lit(" "), names))
    ruled = table(spark, d, "cpsc_recalls_all", ["recallid", "title", "description", "products"]).select("recallid", X.first_match([t], _RULES, "unmatched").alias("rule"))
    return ruled.dropDuplicates(["recallid"]).groupBy("rule").agg(F.count("*").alias("n"))


@Q("fil2_pattern_flags", f"""{E} SELECT recall_id, regexp_matches(lower(title), '{X.HEATED}') AS heated, regexp_matches(lower(coalesce(description, '')), '1610|1615|1616') AS cites,
 regexp_matches(lower(title), {quoted(X.WARNS)}) AS warning FROM e""")
def fil2(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("title")
    cites = F.lower(F.coalesce("description", F.lit(""))).rlike("1610|1615|1616")
    return events(spark, d, "title", "description").select("recall_id", t.rlike(X.HEATED).alias("heated"), cites.alias("cites"), t.rlike(X.WARNS).alias("warning"))


@Q("fil3_range", f"{E} SELECT year, count(*) AS n FROM e WHERE year BETWEEN 1999 AND 2019 GROUP BY year")
def fil3(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "year").where(F.col("year").between(1999, 2019)).groupBy("year").agg(F.count("*").alias("n"))


@Q("fil4_membership", f"{E} SELECT segment, count(*) FILTER (WHERE hazard_category IN ('chemical', 'flammability_burn')) AS inside, count(*) FILTER (WHERE hazard_category NOT IN ('chemical', 'flammability_burn')) AS outside FROM e GROUP BY segment")
def fil4(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("hazard_category").isin("chemical", "flammability_burn")
    return events(spark, d, "segment", "hazard_category").groupBy("segment").agg(F.count_if(hit).alias("inside"), F.count_if(~hit).alias("outside"))


@Q("fil5_semi_join", f"{E} SELECT recall_id, year FROM e WHERE recall_id IN (SELECT recall_id FROM documents)")
def fil5(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "year").join(table(spark, d, "documents", ["recall_id"]), "recall_id", "left_semi").select("recall_id", "year")


@Q("fil6_min_support", f"{E} SELECT firm_key, count(*) AS n FROM e WHERE firm_key IS NOT NULL GROUP BY firm_key HAVING count(*) >= 3")
def fil6(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "firm_key").where("firm_key IS NOT NULL").groupBy("firm_key").agg(F.count("*").alias("n")).where("n >= 3")


_EXPO = """x AS (SELECT coalesce(a.country, b.country) AS country, coalesce(a.year, b.year) AS year, volume, value FROM
 (SELECT trim(country) AS country, year, sum(data_value) AS volume FROM exposure_volume WHERE country IS NOT NULL AND year IS NOT NULL AND NOT starts_with(trim(country), '_') GROUP BY ALL) a
 FULL JOIN (SELECT trim(country) AS country, year, sum(data_value) AS value FROM exposure_value WHERE country IS NOT NULL AND year IS NOT NULL AND NOT starts_with(trim(country), '_') GROUP BY ALL) b
 ON a.country = b.country AND a.year = b.year)"""


@Q("fil7_data_driven_keep", f"""{E}, {_EXPO} SELECT country, round(sum(volume), 4) AS volume FROM x WHERE country IN (SELECT primary_country FROM e WHERE primary_country IS NOT NULL)
 OR country IN (SELECT country FROM x GROUP BY country HAVING sum(value) >= 5e8) GROUP BY country""")
def fil7(spark: SparkSession, d: str) -> DataFrame:
    """Countries that events name, or with enough exposure."""
    x = exposure(spark, d)
    keep = events(spark, d, "primary_country").select(F.col("primary_country").alias("country")).union(
        x.groupBy("country").agg(F.sum("value").alias("s")).where("s >= 5e8").select("country")
    )
    return x.join(keep.distinct(), "country", "left_semi").groupBy("country").agg(F.round(F.sum("volume"), 4).alias("volume"))


# --- projections -----------------------------------------------------------------------------------------------------
@Q("prj1_prioritised_label", f"{E} SELECT CASE WHEN is_violation AND injuries_reported THEN 'both' WHEN is_violation THEN 'violation_only' WHEN injuries_reported THEN 'injury_only' ELSE 'neither' END AS class, count(*) AS n FROM e GROUP BY 1")
def prj1(spark: SparkSession, d: str) -> DataFrame:
    v, i = F.col("is_violation"), F.col("injuries_reported")
    label = F.when(v & i, "both").when(v, "violation_only").when(i, "injury_only").otherwise("neither")
    return events(spark, d, "is_violation", "injuries_reported").groupBy(label.alias("class")).agg(F.count("*").alias("n"))


@Q("prj2_collapse_levels", f"""{E}, t AS (SELECT primary_country FROM e WHERE primary_country IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
 SELECT CASE WHEN primary_country IS NULL THEN 'missing' WHEN primary_country IN (FROM t) THEN primary_country ELSE 'Other' END AS level, count(*) AS n FROM e GROUP BY 1""")
def prj2(spark: SparkSession, d: str) -> DataFrame:
    """The five largest levels, the others as one."""
    counts = events(spark, d, "primary_country").groupBy("primary_country").agg(F.count("*").alias("c"))
    top = counts.where("primary_country IS NOT NULL").orderBy(F.desc("c"), "primary_country").limit(5).select("primary_country", F.lit(True).alias("top"))
    level = F.when(F.col("primary_country").isNull(), "missing").when(F.col("top"), F.col("primary_country")).otherwise("Other")
    return counts.join(F.broadcast(top), "primary_country", "left").groupBy(level.alias("level")).agg(F.sum("c").alias("n"))  # five rows


EDGES = [1973, 1989, 1999, 2009, 2019, 2025]
_PERIOD = "CASE " + " ".join(f"WHEN year > {a} AND year <= {b} THEN '{a + 1}-{b}'" for a, b in zip(EDGES, EDGES[1:])) + " END"


@Q("prj3_period_bins", f"{E} SELECT {_PERIOD} AS period, count(*) AS n, min(year) AS first_year, max(year) AS last_year FROM e GROUP BY 1")
def prj3(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "year").groupBy(X.period_of(F.col("year"), EDGES).alias("period")).agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@Q("prj4_flag_algebra", f"""{E} SELECT recall_id, (sleepwear_standard AND coalesce(archetype_can_be_tight = false, false)) AS arbitrage, trim(coalesce(remedy_options, '')) = '' AS no_remedy,
 (is_childrens AND NOT is_electric_textile) AS child_textile FROM e""")
def prj4(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "sleepwear_standard", "archetype_can_be_tight", "remedy_options", "is_childrens", "is_electric_textile")
    loose = F.coalesce(F.col("archetype_can_be_tight") == F.lit(False), F.lit(False))
    return e.select("recall_id", (F.col("sleepwear_standard") & loose).alias("arbitrage"), (F.trim(F.coalesce("remedy_options", F.lit(""))) == "").alias("no_remedy"), (F.col("is_childrens") & ~F.col("is_electric_textile")).alias("child_textile"))


FIXES = {"Korea": "South Korea", "TUR": "Turkey", "RUS": "Russia", "Hong Kong SAR": "Hong Kong", "Viet Nam": "Vietnam", "USA": "United States", "U.S.": "United States"}
_FIX = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FIXES.items()) + " ELSE {0} END"


@Q("prj5_replacement_map", f"{E} SELECT {_FIX.format('primary_country')} AS country, count(*) AS n FROM e GROUP BY 1")
def prj5(spark: SparkSession, d: str) -> DataFrame:
    table_ = F.create_map(*[F.lit(v) for kv in FIXES.items() for v in kv])
    fixed = F.coalesce(F.try_element_at(table_, F.col("primary_country")), F.col("primary_country"))
    return events(spark, d, "primary_country").groupBy(F.when(F.col("primary_country").isNotNull(), fixed).alias("country")).agg(F.count("*").alias("n"))


@Q("prj6_prune", f"{E} SELECT recall_id, is_childrens, is_violation, is_false_positive, is_electric_textile FROM e")
def prj6(spark: SparkSession, d: str) -> DataFrame:
    """All columns of a prefix."""
    flags = [c for c in table(spark, d, "apparel_recalls_v2").columns if c.startswith("is_")]
    return events(spark, d, *flags).select("recall_id", *flags)


@Q("prj7_null_policies", f"""{E}, m AS (SELECT median(price_usd) AS price FROM e) SELECT recall_id, coalesce(e.price_usd, m.price) AS price, coalesce(main_fiber, 'missing') AS fibre,
 coalesce(archetype_can_be_tight, false) AS tight, try_cast(substr(units, 1, 9) AS DOUBLE) AS units_number FROM (SELECT * REPLACE (CAST(units AS VARCHAR) AS units) FROM e) e, m""")
def prj7(spark: SparkSession, d: str) -> DataFrame:
    """Median, constant, false and NULL where a value is missing or unreadable."""
    e = events(spark, d, "price_usd", "main_fiber", "archetype_can_be_tight", "units")
    m = e.agg(F.median("price_usd").alias("m"))
    return e.join(F.broadcast(m)).select(  # one row
        "recall_id", F.coalesce("price_usd", "m").alias("price"), F.coalesce("main_fiber", F.lit("missing")).alias("fibre"),
        F.coalesce("archetype_can_be_tight", F.lit(False)).alias("tight"), F.substring(F.col("units").cast("string"), 1, 9).try_cast("double").alias("units_number"),
    )


@Q("prj8_log10", f"{E} SELECT recall_id, CASE WHEN price_usd > 0 THEN round(log10(price_usd), 6) END AS log_price FROM e")
def prj8(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "price_usd").select("recall_id", F.round(X.log10_or_null(F.col("price_usd")), 6).alias("log_price"))


# --- text ------------------------------------------------------------------------------------------------------------
@Q("str1_search_text", f"{E} SELECT recall_id, lower(concat_ws(' ', title, description, products)) AS t FROM e")
def str1(spark: SparkSession, d: str) -> DataFrame:
    return once(rows(spark, d, "title", "description", "products").select("recall_id", X.search_text(F.col("title"), F.col("description"), F.col("products")).alias("t")))


_H = case_sql("lower(hazard_text)", X.HAZARDS)
_T = case_sql("lower(concat_ws(' ', title, description))", X.HAZARDS)


@Q("str2_taxonomy", f"{E} SELECT recall_id, coalesce(CASE WHEN trim(coalesce(hazard_text, '')) <> '' THEN {_H} END, {_T}, 'other') AS hazard FROM e")
def str2(spark: SparkSession, d: str) -> DataFrame:
    t = [F.lower("hazard_text"), X.search_text(F.col("title"), F.col("description"))]
    return once(rows(spark, d, "hazard_text", "title", "description").select("recall_id", X.first_match(t, X.HAZARDS).alias("hazard")))


_G = case_sql("lower(title)", X.GARMENTS, "'unclassified'")
_TIGHT = "CASE " + " ".join(f"WHEN g = '{n}' THEN {str(f).lower()}" for n, _, f in X.GARMENTS if f is not None) + " END"


@Q("str3_labelled_attribute", f"{E}, g AS (SELECT recall_id, {_G} AS g FROM e) SELECT recall_id, g AS garment, {_TIGHT} AS tight FROM g")
def str3(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "title").select("recall_id", X.first_match([F.lower("title")], X.GARMENTS, "unclassified").alias("garment"))
    return e.select("recall_id", "garment", X.attribute_of(F.col("garment"), X.GARMENTS).alias("tight"))


_HITS = " UNION ALL ".join(
    f"SELECT recall_id, strpos(t, regexp_extract(t, {quoted('(' + p + ')')}, 0)) AS pos, -length(regexp_extract(t, {quoted('(' + p + ')')}, 0)) AS len, {i} AS rank, '{n}' AS label FROM t WHERE regexp_matches(t, {quoted(p)})"
    for i, (n, p) in enumerate((n, p.replace(r"\b", "")) for n, p, _ in X.GARMENTS)
)
LEXICON = [(n, p.replace(r"\b", ""), f) for n, p, f in X.GARMENTS]


@Q("str4_earliest_longest", f"""{E}, t AS (SELECT recall_id, lower(title) AS t FROM e), h AS ({_HITS}), b AS (SELECT recall_id, first(label ORDER BY pos, len, rank) AS label, string_agg(label, ',' ORDER BY pos, len, rank) AS every FROM h GROUP BY 1)
 SELECT recall_id, coalesce(label, 'unclassified') AS label, coalesce(every, '') AS every FROM t LEFT JOIN b USING (recall_id)""")
def str4(spark: SparkSession, d: str) -> DataFrame:
    hits = once(rows(spark, d, "title").select("recall_id", X.lexicon_hits(F.lower("title"), LEXICON).alias("hits")))
    return hits.select("recall_id", X.earliest_label(F.col("hits")).alias("label"), F.array_join(X.labels_in_order(F.col("hits")), ",").alias("every"))


@Q("str5_units", f"""{R}, p AS (SELECT recallid, replace(lower(unnest(products).numberofunits), ',', '') AS t FROM r),
 n AS (SELECT recallid, coalesce(try_cast(nullif(rtrim(regexp_extract(t, '([\\d.]+)\\s*million', 1), '.'), '') AS DOUBLE) * 1000000, try_cast(nullif(regexp_extract(t, '(\\d+)', 1), '') AS DOUBLE)) AS u FROM p)
 SELECT recallid AS recall_id, round(sum(u), 3) AS units FROM r LEFT JOIN n USING (recallid) GROUP BY 1""")
def str5(spark: SparkSession, d: str) -> DataFrame:
    """Units summed over the products of an event; NULL if none states any."""
    each = F.filter(F.transform(F.coalesce("products", F.array()), lambda p: X.units_of(p["numberofunits"])), lambda u: u.isNotNull())
    total = F.when(F.size(each) > 0, F.aggregate(each, F.lit(0.0), lambda s, u: s + u))
    return raw_events(spark, d, "products").select(F.col("recallid").alias("recall_id"), F.round(total, 3).alias("units"))


_MONEY = "try_cast(nullif(rtrim(regexp_extract(t, {p}, {g}), '.'), '') AS DOUBLE)"
_SPAN = quoted(r"between \$([\d.]+) and \$([\d.]+)")
_ONE = quoted(r"\$([\d.]+)")


@Q("str6_price", f"""{E}, t AS (SELECT recall_id, concat('Sold for ', CASE recall_id % 3 WHEN 0 THEN 'between $' || CAST(CAST(coalesce(price_usd, 5) AS INTEGER) AS VARCHAR) || ' and $' || CAST(CAST(coalesce(price_usd, 5) AS INTEGER) + 10 AS VARCHAR)
 WHEN 1 THEN 'about $' || CAST(CAST(coalesce(price_usd, 7) AS INTEGER) AS VARCHAR) || '.' ELSE 'cash' END) AS t FROM (SELECT recall_id, floor(price_usd) AS price_usd FROM e))
 SELECT recall_id, coalesce(({_MONEY.format(p=_SPAN, g=1)} + {_MONEY.format(p=_SPAN, g=2)}) / 2, {_MONEY.format(p=_ONE, g=1)}) AS price FROM t""")
def str6(spark: SparkSession, d: str) -> DataFrame:
    """Prices read back from sentences in three wordings."""
    p = lambda other: F.floor(F.coalesce("price_usd", F.lit(other))).cast("int")
    text = F.when(F.col("recall_id") % 3 == 0, F.concat(F.lit("between $"), p(5), F.lit(" and $"), p(5) + 10))
    text = text.when(F.col("recall_id") % 3 == 1, F.concat(F.lit("about $"), p(7), F.lit("."))).otherwise("cash")
    return once(rows(spark, d, "price_usd").select("recall_id", X.price_of(F.concat(F.lit("Sold for "), text)).alias("price")))


@Q("str7_channel", f"""{R}, t AS (SELECT recallid, lower(array_to_string({_list_sql('retailers', 'name')}, ' ')) AS t FROM r), f AS (SELECT recallid, regexp_matches(coalesce(t, ''), {quoted(X.ONLINE)}) AS o, regexp_matches(coalesce(t, ''), {quoted(X.STORE)}) AS s FROM t)
 SELECT recallid AS recall_id, CASE WHEN o AND s THEN 'mixed' WHEN o THEN 'online_only' WHEN s THEN 'store_only' ELSE 'unknown' END AS channel FROM f""")
def str7(spark: SparkSession, d: str) -> DataFrame:
    flat = flat_events(table(spark, d, "cpsc_recalls_all"))
    return once(flat.select("recall_id", X.sales_channel(F.regexp_replace("retailers", r" \| ", " ")).alias("channel")))


@Q("str8_flags", f"""{E} SELECT recall_id, contains(t, 'violat') OR contains(t, 'flammable fabrics') AS violation, trim(h) <> '' AND NOT contains(h, 'none report') AND NOT contains(h, 'no injuries') AS injuries
 FROM (SELECT recall_id, lower(concat_ws(' ', title, hazard_text)) AS t, lower(coalesce(description, '')) AS h FROM e)""")
def str8(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "title", "hazard_text", "description")
    return e.select("recall_id", X.is_violation(F.concat_ws(" ", "title", "hazard_text")).alias("violation"), X.reports_injury(F.col("description")).alias("injuries"))


@Q("str9_fibre", f"{E} SELECT recall_id, nullif(regexp_extract(lower(description), {quoted(rf'(\d{{1,3}})\s*%\s*({X.FIBRES})')}, 2), '') AS fibre FROM e")
def str9(spark: SparkSession, d: str) -> DataFrame:
    return once(rows(spark, d, "description").select("recall_id", X.main_fibre(F.col("description")).alias("fibre")))


def _subject_sql() -> str:
    tries = ", ".join(f"trim(regexp_extract(coalesce(title, ''), {quoted('(?i)' + p)}, 1), ' .,-–—')" for p in X.SUBJECT_PATTERNS)
    return f"{E} SELECT recall_id, list_filter([{tries}], lambda x: length(x) BETWEEN 2 AND 70)[1] AS name FROM e"


@Q("str10_subject", _subject_sql())
def str10(spark: SparkSession, d: str) -> DataFrame:
    """Whom a headline names, by the first pattern that gives a name."""
    return once(rows(spark, d, "title").select("recall_id", X.subject_of(F.col("title")).alias("name")))


def _fit_subject_sql() -> str:
    """`recall of` and `recall to`, which the pattern excludes by looking ahead, are marked in the text instead."""
    mark = "chr(1)"
    text = f"regexp_replace(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')), '(?i)(\\srecal)(l\\s*(?:of|to))', '\\1' || {mark} || '\\2', 'g')"
    plain = lambda x: f"replace({x}, {mark}, '')"
    tries = []
    for rule, p in X.FIT_SUBJECT_PATTERNS:
        source = "t" if "(?!" in p else plain("t")
        junk = f"regexp_replace({plain(f'regexp_extract({source}, {quoted("(?i)" + p.replace("(?!" + chr(92) + "s*(?:of|to))", ""))}, 1)')}, {quoted('(?i)' + X.SUBJECT_JUNK)}, ' ', 'g')"
        name = f"trim(trim(regexp_replace(regexp_split_to_array({junk}, {quoted('(?i)' + X.SUBJECT_TAIL)})[1], '\\s+', ' ', 'g')), ' .,-–—:;&')"
        tries.append(f"struct_pack(name := {name}, rule := '{rule}')")
    fit = f"list_filter([{', '.join(tries)}], lambda x: length(x.name) BETWEEN 2 AND 70 AND NOT regexp_matches(x.name, {quoted('(?i)' + X.NOT_A_SUBJECT)}))[1]"
    return f"{E}, t AS (SELECT recall_id, {text} AS t FROM e), s AS (SELECT recall_id, {fit} AS s FROM t) SELECT recall_id, s.name AS name, coalesce(s.rule, 'none') AS rule FROM s"


@Q("str11_fit_subject", _fit_subject_sql())
def str11(spark: SparkSession, d: str) -> DataFrame:
    """Whom a headline is about, and by which pattern; unfit names fall through to the next pattern."""
    return once(rows(spark, d, "title").select("recall_id", X.fit_subject_of(F.col("title")).alias("s"))).select("recall_id", "s.name", "s.rule")


_KEY = "nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(firm), {0}, ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '')".format(quoted(rf"\b({X.NAME_NOISE})\b\.?"))


@Q("str12_name_key", f"{E} SELECT recall_id, {_KEY} AS key FROM e")
def str12(spark: SparkSession, d: str) -> DataFrame:
    return once(rows(spark, d, "firm").select("recall_id", X.name_key(F.col("firm")).alias("key")))


@Q("str13_enforcement", f"""{E} SELECT recall_id, CASE WHEN regexp_matches(lower(title), {quoted(X.WARNS)}) THEN 'unilateral_warning' WHEN regexp_matches(lower(title), '\\brecalls\\b|\\bannounce (the )?recall\\b') THEN 'firm_led'
 WHEN regexp_matches(lower(title), '\\brecalled\\b') THEN 'passive_announced' ELSE 'other_action' END AS mode FROM e""")
def str13(spark: SparkSession, d: str) -> DataFrame:
    return once(rows(spark, d, "title").select("recall_id", X.enforcement_mode(F.col("title")).alias("mode")))


def phrase_sql(reading: str) -> str:
    """Tables up to f (recall_id, phrase), from e."""
    r = {k: quoted(f"(?i){p}") for k, p in X.PHRASES[reading].items()}
    text = "trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))"
    text = f"regexp_replace({text}, {r['opening']}, '')" if "opening" in r else text
    signs = quoted(X.EDGE_SIGNS)
    last = f"regexp_split_to_array(p, {r['tail']})[1]"
    last = f"regexp_replace({last}, {r['quantity']}, '')" if "quantity" in r else last
    return f"""ph AS (SELECT recall_id, {text} AS t FROM e), pv AS (SELECT recall_id, t, regexp_extract(t, {r['verb']}, 0) AS verb, regexp_split_to_array(t, {r['verb']})[1] AS before FROM ph),
 pa AS (SELECT *, regexp_replace(trim(substr(t, length(before) + length(verb) + 1)), {r['dropped']}, '') AS after FROM pv),
 ps AS (SELECT recall_id, CASE WHEN verb <> '' AND after <> '' AND NOT regexp_matches(after, {r['passive']}) THEN after ELSE regexp_replace(before, {quoted('(?i)' + X.ANNOUNCES)}, '') END AS p FROM pa),
 f AS (SELECT recall_id, trim(trim(regexp_replace({last}, '\\s+', ' ', 'g')), {signs}) AS phrase FROM ps)"""


_PHRASE = phrase_sql("boundary")


@Q("str14_product_phrase", f"{E}, {_PHRASE} SELECT * FROM f")
def str14(spark: SparkSession, d: str) -> DataFrame:
    """The reading that archetypes are told by."""
    return once(rows(spark, d, "title").select("recall_id", X.headline_product(F.col("title")).alias("phrase")))


@Q("str14_phrase_for_similarity", f"{E}, {phrase_sql('similarity')} SELECT * FROM f")
def str14b(spark: SparkSession, d: str) -> DataFrame:
    return once(rows(spark, d, "title").select("recall_id", X.headline_product(F.col("title"), "similarity").alias("phrase")))


@Q("str14_phrase_for_topics", f"{E}, {phrase_sql('topics')} SELECT * FROM f")
def str14c(spark: SparkSession, d: str) -> DataFrame:
    return once(rows(spark, d, "title").select("recall_id", X.headline_product(F.col("title"), "topics").alias("phrase")))


@Q("str15_cut_title", f"{E} SELECT recall_id, regexp_split_to_array(lower(title), '\\b(violat|federal|standard)')[1] AS short FROM e")
def str15(spark: SparkSession, d: str) -> DataFrame:
    return once(rows(spark, d, "title").select("recall_id", X.cut_at(F.lower("title"), r"\b(violat|federal|standard)").alias("short")))


_P1, _P2 = case_sql("lower(phrase)", X.GARMENTS), case_sql("lower(title)", X.GARMENTS)


@Q("str16_two_passes", f"{E}, {_PHRASE} SELECT recall_id, coalesce({_P1}, {_P2}, 'unclassified') AS label, CASE WHEN {_P1} IS NOT NULL THEN 'phrase' WHEN {_P2} IS NOT NULL THEN 'title' ELSE 'none' END AS pass FROM f JOIN e USING (recall_id)")
def str16(spark: SparkSession, d: str) -> DataFrame:
    """The phrase first, the title for what stays unclassified."""
    e = rows(spark, d, "title").select("recall_id", F.lower(X.headline_product(F.col("title"))).alias("phrase"), F.lower("title").alias("title"))
    e = once(e.select("recall_id", X.first_match([F.col("phrase")], X.GARMENTS, None).alias("a"), X.first_match([F.col("title")], X.GARMENTS, None).alias("b")))
    return e.select("recall_id", F.coalesce("a", "b", F.lit("unclassified")).alias("label"), F.when(F.col("a").isNotNull(), "phrase").when(F.col("b").isNotNull(), "title").otherwise("none").alias("pass"))


@Q("str17_clean_document", f"""{E}, w AS (SELECT recall_id, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(regexp_replace(title, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[''’]s\\b', '', 'g'), '[^a-z\\s\\-]', ' ', 'g')), '\\s+'), lambda x: x <> '') AS w,
 list_filter(regexp_split_to_array(lower(coalesce(firm, '')), '\\s+'), lambda x: length(x) > 3) AS g FROM e) SELECT recall_id, coalesce(array_to_string(list_filter(w, lambda x: NOT list_contains(g, x)), ' '), '') AS t FROM w""")
def str17(spark: SparkSession, d: str) -> DataFrame:
    return once(rows(spark, d, "title", "firm").select("recall_id", X.cleaned_document(F.col("title"), F.col("firm")).alias("t")))


@Q("str18_counts", f"""{E} SELECT recall_id, length(title) AS chars, len(regexp_extract_all(lower(title), '[a-z][a-z\\-]+')) AS tokens, len(regexp_split_to_array(trim(title), '\\s+')) AS words,
 len(regexp_extract_all(coalesce(products, ''), '\\|')) + 1 AS entries FROM e""")
def str18(spark: SparkSession, d: str) -> DataFrame:
    return once(rows(spark, d, "title", "products").select(
        "recall_id", F.length("title").cast("bigint").alias("chars"), F.size(F.regexp_extract_all(F.lower("title"), F.lit(r"[a-z][a-z\-]+"), F.lit(0))).alias("tokens"),
        F.size(F.split(F.trim("title"), r"\s+")).alias("words"), (F.regexp_count(F.coalesce("products", F.lit("")), F.lit(r"\|")) + 1).alias("entries"),
    ))


@Q("str19_tidy_list", f"""{E}, s AS (SELECT recall_id, i, x FROM (SELECT recall_id, string_split(coalesce(countries_raw, ''), ';') AS l FROM e), unnest(list_transform(l, lambda v: trim(v))) WITH ORDINALITY AS t(x, i) WHERE x <> ''),
 f AS (SELECT recall_id, min(i) AS i, {_FIX.format('x')} AS c FROM s GROUP BY recall_id, c) SELECT recall_id, string_agg(c, ';' ORDER BY i) AS countries FROM f GROUP BY 1""")
def str19(spark: SparkSession, d: str) -> DataFrame:
    listed = events(spark, d, "countries_raw").select("recall_id", X.tidy_list(F.col("countries_raw"), ";", FIXES).alias("l"))
    return listed.where(F.size("l") > 0).select("recall_id", F.array_join("l", ";").alias("countries"))


@Q("str20_any_pattern", f"{E} SELECT recall_id, regexp_matches(concat_ws(' ', title, description, products), '(?i)(zipper|snap|button|drawstring)') AS hit FROM e")
def str20(spark: SparkSession, d: str) -> DataFrame:
    pooled = F.concat_ws(" ", "title", "description", "products")
    return once(rows(spark, d, "title", "description", "products").select("recall_id", pooled.rlike("(?i)(zipper|snap|button|drawstring)").alias("hit")))


@Q("str21_option_flags", f"{E} SELECT recall_id, contains(o, 'refund') AS refund, contains(o, 'repair') AS repair, contains(o, 'replace') AS replace, trim(o) <> '' AS any_option FROM (SELECT recall_id, lower(coalesce(remedy_options, '')) AS o FROM e)")
def str21(spark: SparkSession, d: str) -> DataFrame:
    o = F.lower(F.coalesce("remedy_options", F.lit("")))
    return once(rows(spark, d, "remedy_options").select("recall_id", *[o.contains(w).alias(w) for w in ("refund", "repair", "replace")], (F.trim(o) != "").alias("any_option")))


@Q("str22_joint_names", f"{E} SELECT recall_id, regexp_matches(lower(coalesce(firm, '')), '\\s+and\\s+|&|,') AS joint FROM e")
def str22(spark: SparkSession, d: str) -> DataFrame:
    return once(rows(spark, d, "firm").select("recall_id", X.is_joint_name(F.col("firm")).alias("joint")))


@Q("str23_ratio")
def str23(spark: SparkSession, d: str) -> DataFrame:
    """How alike the firm in the headline and the manufacturer are."""
    return once(rows(spark, d, "firm", "manufacturers").select("recall_id", F.round(X.similarity_ratio(F.lower("firm"), F.lower("manufacturers")), 6).alias("ratio")))


@Q("str24_token_overlap", f"""{E}, t AS (SELECT recall_id, list_distinct(string_split(lower(coalesce(firm, '')), ' ')) AS a, list_distinct(string_split(lower(coalesce(manufacturers, '')), ' ')) AS b FROM e),
 n AS (SELECT recall_id, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb FROM t) SELECT recall_id, round(i / (na + nb - i), 6) AS jaccard, round(i / least(na, nb), 6) AS containment FROM n""")
def str24(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), " ")
    a, b = words("firm"), words("manufacturers")
    return once(rows(spark, d, "firm", "manufacturers").select("recall_id", F.round(X.token_jaccard(a, b), 6).alias("jaccard"), F.round(X.token_containment(a, b), 6).alias("containment")))


@Q("dat1_dates", f"""{E} SELECT recall_id, try_cast(substr(recall_date, 1, 4) AS INTEGER) AS year_of_date, abs(date_diff('day', try_cast(substr(recall_date, 1, 10) AS DATE), CAST(loaded_at AS DATE))) AS days FROM e""")
def dat1(spark: SparkSession, d: str) -> DataFrame:
    """The row loaded first stands for a recall, so that the distance doesn't depend on repeats."""
    e = table(spark, d, "apparel_recalls_v2", ["recall_id", "recall_date", "loaded_at"]).groupBy("recall_id").agg(F.min_by("recall_date", "loaded_at").alias("recall_date"), F.min("loaded_at").alias("loaded_at"))
    day = F.to_date(F.try_to_timestamp(F.substring("recall_date", 1, 10)))
    return e.select("recall_id", F.substring("recall_date", 1, 4).try_cast("int").alias("year_of_date"), F.abs(F.datediff(F.to_date("loaded_at"), day)).cast("bigint").alias("days"))


@Q("mth1_elementary", f"{E} SELECT recall_id, round(ln(1 + p), 6) AS log1p, round(exp(-p / 100), 6) AS decay, round(sqrt(p), 6) AS root, round(least(greatest(p, 10), 50), 6) AS clipped, round(ln(s / (1 - s)), 6) AS logit FROM (SELECT recall_id, price_usd AS p, least(greatest(price_usd / 100, 0.01), 0.99) AS s FROM e WHERE price_usd IS NOT NULL)")
def mth1(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("price_usd")
    s = F.least(F.greatest(p / 100, F.lit(0.01)), F.lit(0.99))
    return events(spark, d, "price_usd").where(p.isNotNull()).select(
        "recall_id", F.round(F.log1p(p), 6).alias("log1p"), F.round(F.exp(-p / 100), 6).alias("decay"), F.round(F.sqrt(p), 6).alias("root"),
        F.round(F.least(F.greatest(p, F.lit(10)), F.lit(50)), 6).alias("clipped"), F.round(F.log(s / (1 - s)), 6).alias("logit"),
    )


@Q("exp1_explode_list", f"{E} SELECT {_FIX.format('x')} AS country, count(*) AS n FROM (SELECT trim(unnest(string_split(countries_raw, ';'))) AS x FROM e) WHERE x <> '' GROUP BY 1")
def exp1(spark: SparkSession, d: str) -> DataFrame:
    table_ = F.create_map(*[F.lit(v) for kv in FIXES.items() for v in kv])
    one = events(spark, d, "countries_raw").select(F.explode(F.split("countries_raw", ";")).alias("x")).select(F.trim("x").alias("x")).where("x <> ''")
    return one.groupBy(F.coalesce(F.try_element_at(table_, F.col("x")), F.col("x")).alias("country")).agg(F.count("*").alias("n"))
