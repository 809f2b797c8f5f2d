"""Queries of the training-data problems."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.canonical import map_to_reference
from tessera.llm.containers import pack
from tessera.llm.mixing import mix, source_key
from tessera.llm.names import Lexicon, link_names
from tessera.llm.neighbours import expanded, grouped, near_duplicates
from tessera.llm.reading import reading_levels
from tessera.llm.terms import distinctive_terms, term_frequencies
from tessera.llm.tokens import token_counts
from tessera.operators.packed import LEGAL_FORMS, split_values
from tessera.plans.data_problems import FIRMS, countries_profile
from tessera.plans.registry import Registry
from tessera.session import materialize, table

REGISTRY = Registry()

_TERMS_SQL = r"""r AS (SELECT DISTINCT recall_id, coalesce(title, '') || ' ' || coalesce(description, '') AS text FROM apparel_recalls_v2),
 w AS (SELECT recall_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z\-]+')) AS term FROM r),
 c AS (SELECT recall_id, term, count(*) AS tf FROM w GROUP BY ALL),
 d AS (SELECT term, count(*) AS n_records FROM c GROUP BY term), n AS (SELECT count(*) AS n FROM r)"""


@REGISTRY.query(
    "p1_found",
    f"WITH {_TERMS_SQL} SELECT recall_id, term FROM c JOIN d USING (term), n WHERE tf >= 3 AND n_records >= 2 AND n_records <= 0.02 * n",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that mark a recall: used three times or more, shared by another recall, in at most 2 % of all."""
    recalls = table(spark, sf_dir, "apparel_recalls_v2", ["recall_id", "title", "description"])
    rows = distinctive_terms(recalls, "recall_id", ["title", "description"], min_tf=3, min_records=2, max_share=0.02)
    return rows.select("recall_id", "term")


@REGISTRY.query(
    "p1_scores",
    f"""WITH {_TERMS_SQL}, l AS (SELECT recall_id, sum(tf) AS n_terms FROM c GROUP BY 1)
 SELECT recall_id, term, tf, n_records, round(tf / n_terms * (ln((1 + n) / (1 + n_records)) + 1), 6) AS score FROM c JOIN d USING (term) JOIN l USING (recall_id), n""",
)
def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How distinctive every term of every recall is."""
    recalls = table(spark, sf_dir, "apparel_recalls_v2", ["recall_id", "title", "description"])
    return distinctive_terms(recalls, "recall_id", ["title", "description"]).withColumn("score", F.round("score", 6))


@REGISTRY.query(
    "p2_found",
    f"""WITH {_TERMS_SQL} SELECT term, CASE WHEN n_records < 4 THEN 'rare' ELSE 'common' END AS mark
 FROM d, n WHERE n_records < 4 OR n_records > 0.6 * n""",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to be of use."""
    recalls = table(spark, sf_dir, "apparel_recalls_v2", ["recall_id", "title", "description"])
    return term_frequencies(recalls, "recall_id", ["title", "description"]).where("mark IS NOT NULL").select("term", "mark")


# Other names under which people write the listed countries, by ISO alpha-3 code. Official forms such as
# "Republic of ..." need no entry, as their wrapping words are removed by rule.
COUNTRY_ALIASES = {
    "CHN": "prc, pr china, zhongguo, cn",
    "VNM": "viet nam, vn",
    "BGD": "bangla desh, bd",
    "IND": "bharat, hindustan, in",
    "IDN": "id",
    "PAK": "pk",
    "KHM": "kampuchea, kh",
    "MEX": "estados unidos mexicanos, united mexican states, mx",
    "KOR": "korea, south korea, s korea, korea south, rok, kr",
    "TWN": "republic of china, taiwan roc, chinese taipei, roc, formosa, tw",
    "HKG": "hong kong sar, hong kong china, hk",
    "USA": "united states of america, us, america, u s of a, estados unidos",
    "TUR": "turkiye, tr",
    "THA": "siam, prathet thai, th",
    "PHL": "pilipinas, filipinas, ph",
    "LKA": "ceylon, lk",
    "HND": "hn",
    "SLV": "salvador el, salvador, sv",
    "GTM": "gt",
    "NIC": "ni",
    "DOM": "republica dominicana, dominican rep, do",
    "HTI": "ayiti, ht",
    "ITA": "italia, italian, it",
    "PRT": "portuguese, pt",
    "ESP": "espana, es",
    "FRA": "french, fr",
    "DEU": "deutschland, bundesrepublik deutschland, frg, de",
    "GBR": "great britain, britain, uk, gb, united kingdom of great britain and northern ireland, england",
    "POL": "polska, pl",
    "ROU": "rumania, roumania, ro",
    "BGR": "bg",
    "CAN": "ca",
    "COL": "co",
    "PER": "pe",
    "BRA": "brasil, br",
    "EGY": "misr, eg",
    "JOR": "jo",
    "MAR": "maroc, marruecos, ma",
    "TUN": "tunisie, tunisian, tn",
    "KEN": "ke",
    "ETH": "et",
    "MDG": "madagasikara, malagasy, mg",
    "MUS": "ile maurice, maurice, mu",
    "LSO": "ls",
    "MYS": "my",
    "SGP": "sg",
    "JPN": "nippon, nihon, jp",
    "NPL": "np",
    "MMR": "burma, mm",
    "LAO": "lao, lao pdr, la",
    "MAC": "macao, macau sar, macao sar, mo",
    "RUS": "russian, rossiya, ru",
    "UKR": "ukraina, ua",
    "ISR": "il",
    "NLD": "holland, nederland, nl",
    "LTU": "lietuva, lt",
    "GRC": "hellas, hellenic, gr",
    "BIH": "bosnia, bosnia herzegovina, bosna i hercegovina, ba",
    "CZE": "czechia, ceska republika, czech, cz",
    "NZL": "aotearoa, n zealand, nz",
}
# Names that look like a listed country's and are none.
NOT_LISTED = ("north korea", "korea north", "dprk", "democratic peoples republic of korea", "africa", "asia", "north america", "south america")
# Words that wrap a country's own name in its official forms.
WRAPPING = (
    "the", "republic", "republica", "rep", "of", "peoples", "people", "democratic", "socialist", "islamic", "kingdom", "federation",
    "federal", "federative", "fed", "arab", "hashemite", "state", "mainland", "sar", "pr", "sr", "union",
)
MADE_IN = r"(?:made|mfd|mfg|manufactured|produced|product|assembled|sewn|origin|imported|fabric)(?: (?:in|of|from))?"


def country_aliases(spark: SparkSession, reference: DataFrame) -> DataFrame:
    """(country_id, alias): other names and codes of the listed countries, and names of places that are none of them (-1)."""
    rows = [(c, a) for c, names in COUNTRY_ALIASES.items() for a in names.split(", ")]
    named = reference.join(spark.createDataFrame(rows, "iso_alpha3 string, alias string"), "iso_alpha3").select("country_id", "alias")
    none = spark.createDataFrame([(-1, n) for n in NOT_LISTED], "country_id int, alias string")
    return named.unionByName(reference.select("country_id", F.col("iso_alpha3").alias("alias"))).unionByName(none)


def typed_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recall_id, field, value) of the countries as typed, cells of countries_raw cut by the parser of packed cells."""
    cells = table(spark, sf_dir, "apparel_recalls_v2", ["recall_id", "countries_raw", "primary_country"]).where("recall_id IS NOT NULL").dropDuplicates(["recall_id"])
    packed = cells.select("recall_id", "countries_raw").where("countries_raw IS NOT NULL")
    raw = split_values(packed, ["recall_id"], {"countries_raw": countries_profile(spark, sf_dir)}).select("recall_id", "field", "value")
    one = cells.select("recall_id", F.lit("primary_country").alias("field"), F.col("primary_country").alias("value"))
    trimmed = F.regexp_replace("value", r"^[\s\"“”]+|[\s\"“”]+$", "")
    return raw.unionByName(one).select("recall_id", "field", trimmed.alias("value")).where("value <> ''")


def mapped_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recall_id, field, value, country_id, stage) of the typed values that aren't a listed name letter for letter."""
    reference = table(spark, sf_dir, "country_reference", ["country_id", "country_name", "iso_alpha3"])
    odd = typed_countries(spark, sf_dir).join(reference.select(F.col("country_name").alias("value")), "value", "left_anti")
    return map_to_reference(odd, reference, "country_id", "country_name", country_aliases(spark, reference), WRAPPING, MADE_IN)


@REGISTRY.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed country each typed value stands for, -1 where it stands for none."""
    return mapped_countries(spark, sf_dir).select("recall_id", "field", "country_id").distinct()


@REGISTRY.query("p4_stages")
def p4_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many typed values each stage resolved, by field, and how many none did."""
    counts = mapped_countries(spark, sf_dir).groupBy("field", "stage").agg(F.count("*").alias("n"))
    return counts.select("field", "stage", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("field"))).alias("share"))


_SETS_SQL = r"""s AS (SELECT recall_id, list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(products, '')), '[a-z][a-z\-]+')) AS t
 FROM (SELECT DISTINCT recall_id, title, description, products FROM apparel_recalls_v2 WHERE description IS NOT NULL))"""


_PAIRS_SQL = f"""{_SETS_SQL}, p AS (SELECT a.recall_id AS recall_id_a, b.recall_id AS recall_id_b, len(a.t) + len(b.t) AS n, len(list_intersect(a.t, b.t)) AS i
 FROM s a JOIN s b ON a.recall_id < b.recall_id AND len(a.t) >= 0.7 * len(b.t) AND len(b.t) >= 0.7 * len(a.t)),
 q AS (SELECT recall_id_a, recall_id_b FROM p WHERE i >= 0.7 * (n - i))"""


def alike_recalls(spark: SparkSession, sf_dir: str, miss: float = 0) -> tuple[DataFrame, DataFrame]:
    recalls = table(spark, sf_dir, "apparel_recalls_v2", ["recall_id", "title", "description", "products"]).where("description IS NOT NULL")
    return near_duplicates(recalls, "recall_id", ["title", "description", "products"], 0.7, miss)


@REGISTRY.query("p7_found", f"WITH {_PAIRS_SQL} FROM q")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of recalls whose title, description and products have 70 % of their terms in common."""
    pairs = expanded(*alike_recalls(spark, sf_dir))
    return pairs.select(F.col("a").alias("recall_id_a"), F.col("b").alias("recall_id_b"))


@REGISTRY.query("p7_groups", f"""WITH RECURSIVE {_PAIRS_SQL}, e AS (SELECT recall_id_a AS a, recall_id_b AS b FROM q UNION SELECT recall_id_b, recall_id_a FROM q),
 w AS (SELECT recall_id AS node, recall_id AS seen FROM s UNION SELECT w.node, e.b FROM w JOIN e ON e.a = w.seen) SELECT node AS recall_id, min(seen) AS "group" FROM w GROUP BY 1""")
def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recall with the smallest one that a chain of near-duplicates connects it to."""
    return grouped(*alike_recalls(spark, sf_dir)).select(F.col("id").alias("recall_id"), "group")


# Words for a line of business and their usual short forms.
TRADES = {
    "sleepwear": "slpwr", "international": "intl", "textiles": "txtls textile", "knitwear": "knitwr", "distribution": "distr dist distributors",
    "associates": "assoc assocs", "apparel": "appl apprl", "clothing": "clthg", "outfitters": "outf", "brothers": "bros",
    "manufacturing": "mfg mfr manufacturers", "garments": "garmts gmts garment", "footwear": "ftwr", "industries": "ind inds industry",
    "trading": "trdg traders", "goods": "gds home", "enterprises": "ent", "products": "prods", "imports": "import", "exports": "export", "group": "grp",
}
# Given names with their nicknames.
GIVEN = {
    "katherine": "kathy kate katie kat kay kitty", "theodora": "dora thea teddy", "michael": "mike mick mickey", "josephine": "josie jo",
    "elizabeth": "beth liz lizzie betty eliza", "margaret": "peggy maggie meg marge greta", "robert": "rob bob bobby robbie bert",
    "susannah": "sue susie suzy susan", "frederick": "fred fritz freddy rick", "anthony": "tony ant", "edward": "ted ned ed eddie",
    "alexander": "alex sandy al xander", "patricia": "trish pat patty tricia", "richard": "rick dick rich richie", "william": "will bill billy liam",
    "james": "jim jimmy jamie", "john": "jack johnny", "charles": "charlie chuck", "thomas": "tom tommy", "joseph": "joe joey",
}
NOISE = frozenset(w for w in ("the", "designs", "by", "usa", "us", "studio", "and", "of", *re.sub(r"\W", " ", " ".join(LEGAL_FORMS)).split(), "liability") if len(w) > 1)
FIRM_WORDS = Lexicon(TRADES, GIVEN, NOISE)


def typed_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of firms as typed, each single value of a packed cell on its own."""
    recalls = table(spark, sf_dir, "apparel_recalls_v2", ["manufacturers", "importers"])
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "").alias("name")
    packed = split_values(recalls.select("importers").distinct(), [], {"importers": FIRMS}).select(F.col("value").alias("name"))
    offenders = table(spark, sf_dir, "repeat_offenders", ["firm_name"]).select(trimmed("firm_name"))
    return recalls.select(trimmed("manufacturers")).union(packed).union(offenders).where("name <> ''").distinct()


@REGISTRY.query("p3_members")
def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name with the firm it belongs to and how many other names that firm has."""
    linked = materialize(link_names(typed_firms(spark, sf_dir), lexicon=FIRM_WORDS), "linked")
    return linked.join(linked.groupBy("entity").agg((F.count("*") - 1).alias("links")), "entity").select("name", "entity", "links")


@REGISTRY.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different spellings of the same firm."""
    linked = materialize(link_names(typed_firms(spark, sf_dir), lexicon=FIRM_WORDS), "linked")
    left, right = linked.select("entity", F.col("name").alias("name_a")), linked.select("entity", F.col("name").alias("name_b"))
    return left.join(right, "entity").where("name_a < name_b").select("name_a", "name_b")


def document_tokens(spark: SparkSession, sf_dir: str, targets: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every document, or of those with a target; counted once and kept in the shared folder."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    if targets is not None:
        docs = docs.join(targets.select(source_key(F.col("source")).alias("wanted")).distinct(), source_key(F.col("source")) == F.col("wanted"), "left_semi")
    return materialize(token_counts(docs, ["doc_id", "source"], "text"), "tokens")


CONTAINER = 2_048


@REGISTRY.query("p8_pack")
def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or of each piece of a document that exceeds a container."""
    return pack(document_tokens(spark, sf_dir), ["doc_id"], "tokens", CONTAINER)[0].withColumnRenamed("size", "tokens")


@REGISTRY.query("p8_fill")
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, how many the reduction fixed, the least number that could hold the tokens, and how full they are."""
    placed, plan = pack(document_tokens(spark, sf_dir), ["doc_id"], "tokens", CONTAINER)
    one = placed.groupBy("container").agg(F.sum("size").alias("used"))
    every = one.agg(F.count("*").alias("containers"), F.ceil(F.sum("used") / CONTAINER).alias("least_containers"), F.max("used").alias("most_used"), F.avg("used").alias("mean_used"))
    return every.select("containers", F.lit(plan.reduced).alias("reduced"), "least_containers", "most_used", F.round(F.col("mean_used") / CONTAINER, 6).alias("fill"))


def mixed_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return mix(document_tokens(spark, sf_dir, targets), "doc_id", targets)


@REGISTRY.query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is drawn."""
    return mixed_documents(spark, sf_dir)[0]


@REGISTRY.query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixed_documents(spark, sf_dir)[1]


def read_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]).where(F.col("lang") == "en").where(words >= 20)
    return reading_levels(docs.select("doc_id", "text"), table(spark, sf_dir, "reading_labels", ["doc_id", "reading_level"]))


@REGISTRY.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of every English document of at least 20 words."""
    return read_documents(spark, sf_dir)[0].select("doc_id", "reading_level").where("reading_level IS NOT NULL")


@REGISTRY.query("p10_report")
def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds, residual and held-out agreement of the propagation."""
    return read_documents(spark, sf_dir)[1]
