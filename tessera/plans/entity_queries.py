"""Queries of entity resolution, text similarity and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import headline_product, is_joint_name, name_key
from tessera.operators import clusters as K
from tessera.operators import similarity as S
from tessera.operators.graph import components
from tessera.operators.learning import side_by_side
from tessera.operators.shares import mode_of
from tessera.plans.registry import Registry
from tessera.plans.relational_queries import r6
from tessera.plans.text_queries import E, phrase_sql
from tessera.session import materialize, table
from tessera.sources.events import events, once, rows

REGISTRY = Registry()
Q = REGISTRY.query
GENERIC = ["store", "shop", "brands", "global", "sales", "products", "retail", "holdings", "the", "and", "of", "for", "home", "goods", "garments", "textiles", "footwear"]


# --- similar product phrases: phrases are compared once, however many events carry one ---------------------------------
def phrases(spark: SparkSession, d: str) -> DataFrame:
    """(recall_id, phrase, class, firm, day, country, online) of events with a phrase of more than three letters; the class is
    the smallest event of the same phrase, the day counts from 1970."""
    raw = rows(spark, d, "title", "firm_key", "recall_date", "primary_country", "sales_channel")
    day = F.datediff(F.to_date(F.try_to_timestamp(F.substring("recall_date", 1, 10))), F.lit("1970-01-01").cast("date"))
    e = once(raw.select("recall_id", F.lower(headline_product(F.col("title"), "similarity")).alias("phrase"), F.col("firm_key").alias("firm"), day.alias("day"), F.col("primary_country").alias("country"), (F.col("sales_channel") == "online_only").alias("online")))
    e = materialize(e.where(F.length("phrase") > 3), "events")
    return materialize(e.join(e.groupBy("phrase").agg(F.min("recall_id").alias("class")), "phrase"), "phrases")


def phrase_vectors(p: DataFrame, terms, min_records: int = 1) -> DataFrame:
    """Weights of the terms of each class of equal phrases, record counts being over all events."""
    classes = p.groupBy("class").agg(F.first("phrase").alias("phrase"), F.count("*").alias("copies"))
    return S.tfidf(S.term_counts(classes, "class", terms), "class", min_records, classes.select("class", "copies"))


def phrase_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The events with their phrases' classes, and (a, b, similarity) of classes that are alike and have events near in time."""
    p = phrases(spark, d)
    spans = p.groupBy("class").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    near = f"lo_a - hi_b <= {DAYS} AND lo_b - hi_a <= {DAYS}"
    return p, materialize(S.similar_pairs(phrase_vectors(p, S.word_ngrams(F.col("phrase"))), "class", ALIKE, spans, near), "links")


ALIKE, DAYS = 0.6, 730
_WORDS = "regexp_extract_all(phrase, '\\w\\w+')"
_PH = f"""{E}, {phrase_sql("similarity")}, g AS (SELECT recall_id, lower(phrase) AS phrase, firm_key AS firm, date_diff('day', DATE '1970-01-01', try_cast(substr(recall_date, 1, 10) AS DATE)) AS day, primary_country AS country, sales_channel = 'online_only' AS online
 FROM f JOIN e USING (recall_id) WHERE length(phrase) > 3), p AS (SELECT *, min(recall_id) OVER (PARTITION BY phrase) AS class FROM g)"""
_TF = f"""{_PH}, w AS (SELECT recall_id, {_WORDS} AS w FROM p), l AS (SELECT recall_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), c AS (SELECT recall_id, term, count(*) AS tf FROM l GROUP BY ALL), n AS (SELECT count(*) AS n FROM p),
 df AS (SELECT term, count(*) AS df FROM c GROUP BY 1), x AS (SELECT recall_id, term, df, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM c JOIN df USING (term), n), v AS (SELECT recall_id, term, df, x / sqrt(sum(x * x) OVER (PARTITION BY recall_id)) AS w FROM x)"""
_SIM = f"""{_TF}, z AS (SELECT x.recall_id AS a, y.recall_id AS b, sum(x.w * y.w) AS s FROM v x JOIN v y ON x.term = y.term AND x.recall_id <> y.recall_id GROUP BY ALL),
 k AS (SELECT z.a, z.b, z.s, x.country = y.country AS same_country, x.online AND y.online AS online, x.phrase AS pa, y.phrase AS pb FROM z JOIN p x ON x.recall_id = a JOIN p y ON y.recall_id = b WHERE s >= {ALIKE} - 1e-9 AND x.firm <> y.firm AND abs(x.day - y.day) <= {DAYS})"""


@Q("er4_tfidf", f"{_TF} SELECT p.class, term, round(any_value(w), 6) AS w FROM v JOIN p USING (recall_id) GROUP BY ALL")
def er4(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the words and word pairs of each phrase."""
    p = phrases(spark, d)
    return phrase_vectors(p, S.word_ngrams(F.col("phrase"))).select("class", "term", r6("w", "w"))


@Q("er4_char_tfidf", f"""{_PH}, w AS (SELECT class, ' ' || unnest(list_filter(regexp_split_to_array(any_value(phrase), '\\s+'), lambda x: x <> '')) || ' ' AS w, count(*) AS m FROM p GROUP BY class), s AS (SELECT class, m, w, unnest([3, 4, 5]) AS k FROM w),
 l AS (SELECT class, m, substr(w, i, k) AS term FROM (SELECT *, unnest(range(1, greatest(length(w) - k + 1, 1) + 1)) AS i FROM s) WHERE k = 3 OR length(w) >= k), c AS (SELECT class, m, term, count(*) AS tf FROM l GROUP BY ALL), n AS (SELECT count(*) AS n FROM p), df AS (SELECT term, sum(m) AS df FROM c GROUP BY 1 HAVING sum(m) >= 2),
 x AS (SELECT class, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM c JOIN df USING (term), n) SELECT class, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY class)), 6) AS w FROM x""")
def er4c(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the pieces of three to five letters of each phrase's words that two events have."""
    p = phrases(spark, d)
    return phrase_vectors(p, S.char_ngrams(F.col("phrase"), 3, 5), 2).select("class", "term", r6("w", "w"))


@Q("jn9_similar_links", f"{_SIM}, ln AS (SELECT a AS recall_id, count(*) AS links FROM k GROUP BY 1) SELECT recall_id, class, coalesce(links, 0) AS links FROM p LEFT JOIN ln USING (recall_id)")
def jn9(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the class of its phrase and the number of events of other firms within two years whose phrases are alike."""
    p, links = phrase_links(spark, d)
    n = S.counted_matches(p, links, "class", "firm", "day", DAYS).groupBy(F.col("a").alias("class"), "firm", "day").agg(F.sum("n").alias("links"))
    return p.join(n, ["class", "firm", "day"], "left").select("recall_id", "class", F.coalesce("links", F.lit(0)).alias("links"))


@Q("er4_char_ngrams")
def er4b(spark: SparkSession, d: str) -> DataFrame:
    """Each firm key with the number of keys that are alike by their pieces of three to five letters."""
    e = once(rows(spark, d, "firm_key").where("firm_key IS NOT NULL").select("firm_key"), "firm_key").withColumn("id", F.xxhash64("firm_key"))
    grams = S.term_counts(e, "id", S.char_ngrams(F.col("firm_key"), 3, 5)).withColumn("term", F.xxhash64("term"))
    pairs = S.similar_pairs(S.tfidf(grams, "id", 2), "id", 0.8, depth=1)
    n = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("links"))
    return e.join(n, "id", "left").select("firm_key", F.coalesce("links", F.lit(0)).alias("links"))


# Words of products, which tell no maker, however few phrases hold them.
PRODUCT_WORDS = """toddlers toddler youth women womens woman men mens man baby babies unisex junior infant infants kids children childrens boys girls
cotton fleece flannel knit knitted woven denim velour terry organic bamboo hooded drawstring drawstrings zip zippered footed printed print holiday winter
summer spring fall christmas halloween two piece three long short sleeve sleeves style styles assorted various models model number numbers heated electric
weighted infrared cordless rechargeable chenille velvet wool silk satin polyester nylon leather suede metal plastic wooden waist hood hoods neck cuff cuffs
collar zipper zippers snap snaps button buttons pocket pockets garment garments apparel clothing outfit outfits teddy bear bears doll dolls toy toys
necklace necklaces jewellery athletic safety water sport sports novelty decorative""".split()


def rare_words(p: DataFrame) -> DataFrame:
    """(class, term) of the words that at most 3 events, or 2 % of all, have, but for PRODUCT_WORDS."""
    words = p.groupBy("class").agg(F.first("phrase").alias("phrase"), F.count("*").alias("m"))
    words = words.select("class", "m", F.explode(F.array_distinct(F.regexp_extract_all("phrase", F.lit("[a-z0-9']{3,}"), F.lit(0)))).alias("term"))
    df = words.groupBy("term").agg(F.sum("m").alias("df")).where(F.col("df") <= max(3, round(RARE * p.count()))).where(~F.col("term").isin(PRODUCT_WORDS))
    return words.join(df, "term").select("class", "term", "df")


RARE = 0.02
_LISTED = ", ".join(f"'{w}'" for w in PRODUCT_WORDS)
_RARE_SQL = f"""t AS (SELECT DISTINCT recall_id, class, unnest(regexp_extract_all(phrase, '[a-z0-9'']{{3,}}')) AS term FROM p), rt AS (SELECT term, count(*) AS df FROM t GROUP BY 1 HAVING count(*) <= greatest(3, round({RARE} * (SELECT count(*) FROM p))) AND term NOT IN ({_LISTED})),
 rw AS (SELECT DISTINCT recall_id, class, term, df FROM t JOIN rt USING (term))"""


@Q("er5_rare_tokens", f"{_PH}, {_RARE_SQL} SELECT DISTINCT term, df FROM rw")
def er5(spark: SparkSession, d: str) -> DataFrame:
    return rare_words(phrases(spark, d)).select("term", "df").distinct()


@Q("er6_tiers", f"""{_SIM}, {_RARE_SQL}, sh AS (SELECT DISTINCT k.a, k.b FROM k JOIN rw x ON x.recall_id = k.a JOIN rw y ON y.recall_id = k.b AND y.term = x.term)
 SELECT CASE WHEN same_country AND sh.a IS NOT NULL THEN 'brand_match' WHEN same_country AND s >= 0.8 - 1e-9 AND online THEN 'category_match_online' ELSE 'other_high_similarity' END AS tier, count(*) AS n FROM k LEFT JOIN sh ON sh.a = k.a AND sh.b = k.b WHERE k.a < k.b GROUP BY 1""")
def er6(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of alike events of different firms within two years by tier, counted from the classes of their phrases."""
    p, links = phrase_links(spark, d)
    rare = materialize(rare_words(p).select("class", "term"), "rare")
    own = rare.select(F.col("class").alias("a"), F.col("class").alias("b")).distinct()
    shared = links.select("a", "b").join(rare.withColumnRenamed("class", "a"), "a").join(rare.withColumnRenamed("class", "b"), ["b", "term"]).select("a", "b").distinct()
    marks = links.join(shared.withColumn("rare", F.lit(True)), ["a", "b"], "left").select("a", "b", F.coalesce("rare", F.lit(False)).alias("rare"), (F.col("similarity") >= 0.8 - 1e-9).alias("close"))
    itself = p.select(F.col("class").alias("a"), F.col("class").alias("b")).distinct().join(own.withColumn("rare", F.lit(True)), ["a", "b"], "left")
    marks = marks.unionByName(marks.select(F.col("b").alias("a"), F.col("a").alias("b"), "rare", "close")).unionByName(itself.select("a", "b", F.coalesce("rare", F.lit(False)).alias("rare"), F.lit(True).alias("close")))
    marks = materialize(marks, "marks")

    def pairs(same: list[str], only: str) -> DataFrame:
        hits = S.counted_matches(p, links, "class", "firm", "day", DAYS, same).join(marks, ["a", "b"]).where(only)
        return hits.agg((F.coalesce(F.sum(F.col("q") * F.col("n")), F.lit(0)) / 2).cast("bigint").alias("n"))

    brand = pairs(["country"], "rare").select("n", F.lit("brand_match").alias("tier"))
    online = pairs(["country", "online"], "NOT rare AND close AND online").select("n", F.lit("category_match_online").alias("tier"))
    both = materialize(brand.unionByName(online), "tiers")
    rest = pairs([], "true").unionByName(both.select((-F.col("n")).alias("n"))).agg(F.sum("n").alias("n"))
    return both.unionByName(rest.select("n", F.lit("other_high_similarity").alias("tier"))).where("n > 0").select("tier", "n")


def keyed_names(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "firm").where("firm IS NOT NULL").select("firm", name_key(F.col("firm")).alias("key"), is_joint_name(F.col("firm")).alias("joint"))
    return e.where("key IS NOT NULL")


@Q("er1_jn10_name_matches")
def er1(spark: SparkSession, d: str) -> DataFrame:
    return S.name_matches(keyed_names(spark, d), "key", "n", GENERIC)


@Q("er2_merged_entities")
def er2(spark: SparkSession, d: str) -> DataFrame:
    """Name keys with the entity that their matches connect them to."""
    keys = keyed_names(spark, d).select("key").distinct()
    linked = components(er1(spark, d), "key_a", "key_b")
    return keys.join(linked, keys["key"] == linked["node"], "left").select("key", F.coalesce("component", "key").alias("entity"))


@Q("er2_components", """WITH RECURSIVE ed AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey || '/' || l_suppkey AS b FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity >= 45),
 bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), walk AS (SELECT a AS node, a AS seen FROM bo UNION SELECT w.node, bo.b FROM walk w JOIN bo ON bo.a = w.seen) SELECT node, min(seen) AS component FROM walk GROUP BY 1""")
def er2b(spark: SparkSession, d: str) -> DataFrame:
    """Orders connected by large returned lines of the same part and supplier."""
    o = table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_quantity"])
    o = o.where("l_returnflag = 'R' AND l_shipdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00' AND l_quantity >= 45")
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string"))
    return components(o.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a"), part.alias("b")))


@Q("er3_display_names", f"{E}, n AS (SELECT firm_key, firm AS v, count(*) AS n FROM e WHERE firm_key IS NOT NULL AND firm IS NOT NULL GROUP BY ALL) SELECT firm_key, v AS mode FROM n QUALIFY row_number() OVER (PARTITION BY firm_key ORDER BY n DESC, v) = 1")
def er3(spark: SparkSession, d: str) -> DataFrame:
    return mode_of(events(spark, d, "firm_key", "firm").where("firm_key IS NOT NULL"), "firm_key", "firm")


TRAITS = ["n_recalls", "median_units", "median_price", "share_online_only", "share_childrens", "share_violation"]
_MED = ", ".join(f"median({c}) AS m_{c}" for c in TRAITS)
_FULL = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in TRAITS)


@Q("cl1_standardised", f"WITH m AS (SELECT {_MED} FROM repeat_offenders), f AS (SELECT firm_id, {_FULL} FROM repeat_offenders, m) SELECT firm_id, " + ", ".join(f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 6) AS {c}" for c in TRAITS) + " FROM f")
def cl1(spark: SparkSession, d: str) -> DataFrame:
    return S.standardised(table(spark, d, "repeat_offenders", ["firm_id", *TRAITS]), "firm_id", TRAITS).select("firm_id", *[r6(c, c) for c in TRAITS])


def traits(spark: SparkSession, d: str) -> DataFrame:
    """Firms with their standardised traits as columns and as one vector."""
    return K.features(materialize(S.standardised(table(spark, d, "repeat_offenders", ["firm_id", *TRAITS]), "firm_id", TRAITS), "traits"), TRAITS)


CLUSTERS = range(2, 13)


@Q("cl2_kmeans_bic")
def cl2(spark: SparkSession, d: str) -> DataFrame:
    """Information criterion by number of clusters, each the best of ten starts."""
    best = K.kmeans(traits(spark, d), CLUSTERS)
    return spark.createDataFrame([(k, float(m.summary.trainingCost), K.kmeans_bic(m, len(TRAITS))) for k, m in best.items()], "k int, cost double, bic double")


@Q("cl3_mixtures")
def cl3(spark: SparkSession, d: str) -> DataFrame:
    """Full and diagonal covariances side by side."""
    x = traits(spark, d)
    found = side_by_side(lambda k: (k, float(K.mixture(x, k)[1]), float(K.diagonal_mixture(x.select(*TRAITS), TRAITS, k, 20)[3])), CLUSTERS)
    return spark.createDataFrame(found, "k int, bic_full double, bic_diagonal double")


REPORTED = 4


@Q("cl4_kmeans_and_mixture")
def cl4b(spark: SparkSession, d: str) -> DataFrame:
    """How far the clusters of k-means and of the mixture of normals agree."""
    x = traits(spark, d)
    a = K.kmeans(x, [REPORTED])[REPORTED].transform(x).withColumnRenamed("prediction", "a").select("firm_id", "features", "a")
    both = K.mixture(x, REPORTED)[0].transform(a).withColumnRenamed("prediction", "b")
    return S.agreement(both, "a", "b")


@Q("cl5_named_clusters")
def cl5b(spark: SparkSession, d: str) -> DataFrame:
    """The clusters of k-means with their size and a name by rule, numbered where several get the same one."""
    x = traits(spark, d)
    own = K.kmeans(x, [REPORTED])[REPORTED].transform(x).select("firm_id", F.col("prediction").alias("cluster"))
    g = own.join(table(spark, d, "repeat_offenders", ["firm_id", "share_online_only", "share_violation"]), "firm_id").groupBy("cluster").agg(F.count("*").alias("firms"), F.avg("share_online_only").alias("o"), F.avg("share_violation").alias("v"))
    g = g.select("cluster", "firms", F.when(F.col("v") > 0.35, "violators").when(F.col("o") > 0.2, "online sellers").otherwise("general").alias("base"))
    i = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("firms"), "cluster"))
    return g.select("cluster", "firms", F.concat("base", F.when(i > 1, F.concat(F.lit(" "), i.cast("string"))).otherwise("")).alias("name"))


@Q("cl4_agreement", "WITH c AS (SELECT firm_id % 3 AS a, CASE WHEN share_violation > 0.5 THEN 1 ELSE 0 END AS b, count(*) AS n FROM repeat_offenders GROUP BY ALL), m AS (SELECT a, max(n) AS m, sum(n) AS n FROM c GROUP BY 1) SELECT round(sum(m) / sum(n), 6) AS agreement FROM m")
def cl4(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "repeat_offenders", ["firm_id", "share_violation"]).select((F.col("firm_id") % 3).alias("a"), F.when(F.col("share_violation") > 0.5, 1).otherwise(0).alias("b"))
    return S.agreement(t, "a", "b").select(r6("agreement", "agreement"))


@Q("cl5_cluster_names", """WITH g AS (SELECT firm_id % 4 AS cluster, avg(share_online_only) AS o, avg(share_violation) AS v FROM repeat_offenders GROUP BY 1), b AS (SELECT cluster, CASE WHEN v > 0.35 THEN 'violators' WHEN o > 0.2 THEN 'online sellers' ELSE 'general' END AS base FROM g)
 SELECT cluster, base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY cluster) > 1 THEN ' ' || row_number() OVER (PARTITION BY base ORDER BY cluster) ELSE '' END AS name FROM b""")
def cl5(spark: SparkSession, d: str) -> DataFrame:
    """Names by rule, numbered where several clusters get the same one."""
    g = table(spark, d, "repeat_offenders", ["firm_id", "share_online_only", "share_violation"]).groupBy((F.col("firm_id") % 4).alias("cluster")).agg(F.avg("share_online_only").alias("o"), F.avg("share_violation").alias("v"))
    g = g.select("cluster", F.when(F.col("v") > 0.35, "violators").when(F.col("o") > 0.2, "online sellers").otherwise("general").alias("base"))
    i = F.row_number().over(Window.partitionBy("base").orderBy("cluster"))
    return g.select("cluster", F.concat("base", F.when(i > 1, F.concat(F.lit(" "), i.cast("string"))).otherwise("")).alias("name"))


TOPICS = {0: ["jacket", "hoodie", "sweatshirt", "coat"], 1: ["blanket", "towel", "curtain", "comforter"]}
_TOP = " UNION ALL ".join(f"SELECT {k} AS topic, '{t}' AS term" for k, ts in TOPICS.items() for t in ts)


@Q("tx4_npmi", f"""{E}, t AS ({_TOP}), h AS (SELECT DISTINCT recall_id, term FROM (SELECT recall_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, products)), '[a-z][a-z\\-]+')) AS term FROM e) WHERE term IN (SELECT term FROM t)), n AS (SELECT count(*) AS n FROM e),
 df AS (SELECT term, count(*) AS df FROM h GROUP BY 1), co AS (SELECT a.term AS x, b.term AS y, count(*) AS co FROM h a JOIN h b ON a.recall_id = b.recall_id AND a.term < b.term GROUP BY ALL),
 p AS (SELECT a.topic, a.term AS x, b.term AS y FROM t a JOIN t b ON a.topic = b.topic AND a.term < b.term), q AS (SELECT topic, (coalesce(co, 0) + 1) / (n + 1) AS c, (coalesce(dx.df, 0) + 1) / (n + 1) AS px, (coalesce(dy.df, 0) + 1) / (n + 1) AS py FROM p CROSS JOIN n LEFT JOIN co ON co.x = p.x AND co.y = p.y LEFT JOIN df dx ON dx.term = p.x LEFT JOIN df dy ON dy.term = p.y)
 SELECT topic, round(avg(ln(c / (px * py)) / -ln(c)), 6) AS npmi FROM q GROUP BY 1""")
def tx4(spark: SparkSession, d: str) -> DataFrame:
    top = spark.createDataFrame([(k, t) for k, ts in TOPICS.items() for t in ts], "topic int, term string")
    docs = events(spark, d, "title", "products").select("recall_id", F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "products")), F.lit(r"[a-z][a-z\-]+"), F.lit(0)).alias("terms"))
    return S.npmi(docs, "recall_id", "terms", top).select("topic", r6("npmi", "npmi"))
