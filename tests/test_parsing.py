"""Text functions, packed cells and nested records on literals."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.nested import Child, child_tables
from tessera.operators.packed import Profile, parse_cell, split_values
from tessera.plans.data_problems import FIRMS, OPTIONS
from tessera.sources.events import EXPOSURE, enriched, read_csv, read_first, read_raw_events
from tessera.sources.sinks import markdown, write_json, write_table

COUNTRIES = Profile(joiners=("and", "or", "&"), names=("Bosnia and Herzegovina",))


def values(profile, cell):
    return [v for _, v, _ in parse_cell(cell, *profile.compiled())]


@pytest.mark.parametrize(
    "profile, cell, want",
    [
        (FIRMS, "Cool Garments, Corp., Blue Socks; “Red, Co., Ltd.”", ["Cool Garments, Corp.", "Blue Socks", "Red, Co., Ltd."]),
        (FIRMS, "Oak Mills d/b/a Oak Studio / Elm Trading", ["Oak Mills d/b/a Oak Studio", "Elm Trading"]),
        (FIRMS, '"The ""Fir"" Shop";\tAsh and Birch Co. | ; ', ['The "Fir" Shop', "Ash and Birch Co."]),
        (COUNTRIES, "China (A, B);Turkey;;Bosnia and Herzegovina & Peru, and India.", ["China (A, B)", "Turkey", "Bosnia and Herzegovina", "Peru", "India."]),
        (COUNTRIES, "bosnia & Herzegovnia and N/A", ["bosnia & Herzegovnia", "N/A"]),
        (COUNTRIES, "Bosnia-Herzegovina and Peru", ["Bosnia-Herzegovina", "Peru"]),
        (OPTIONS, "Refund or Replace, and Inspect+New Instructions", ["Refund", "Replace", "Inspect", "New Instructions"]),
        (FIRMS, None, []),
        (FIRMS, "  ", []),
        (FIRMS, " ; | ", []),
    ],
)
def test_cells(profile, cell, want):
    assert values(profile, cell) == want


def test_malformed_quotes_are_flagged():
    got = parse_cell('"abc; def (x', *FIRMS.compiled())
    assert got == [(1, '"abc', True), (2, "def (x", True)]


def test_long_cell_is_read_whole():
    cell = "; ".join(f"Firm {i}, Inc." for i in range(20_000))
    assert len(values(FIRMS, cell)) == 20_000


def test_split_values(spark):
    df = spark.createDataFrame([(1, "A; B", None, "x"), (2, "Solo", "", "y"), (3, None, "C / D", "z")], "id int, f string, g string, value string")
    got = {tuple(r) for r in split_values(df, ["id"], {"f": FIRMS, "g": FIRMS}).select("id", "field", "position", "value", "n_values").collect()}
    assert got == {(1, "f", 1, "A", 2), (1, "f", 2, "B", 2), (2, "f", 1, "Solo", 1), (3, "g", 1, "C", 2), (3, "g", 2, "D", 2)}
    assert split_values(df.limit(0), ["id"], {"f": FIRMS}).count() == 0


def test_signs_come_from_the_profile(spark):
    df = spark.createDataFrame([(1, "a#b#c"), (2, 'a#"b"#c'), (3, "a;b"), (4, "a plus b plus c"), (5, "a^b]c")], "id int, f string")
    got = {}
    for p in (Profile(signs="#"), Profile(signs="#", joiners=("plus",)), Profile(signs="^]")):
        got[p] = {k: [r["value"] for r in sorted(v, key=lambda r: r["position"])] for k, v in ((i, split_values(df.where(F.col("id") == i), ["id"], {"f": p}).collect()) for i in range(1, 6))}
    assert got[Profile(signs="#")] == {1: ["a", "b", "c"], 2: ["a", "b", "c"], 3: ["a;b"], 4: ["a plus b plus c"], 5: ["a^b]c"]}
    assert got[Profile(signs="#", joiners=("plus",))][4] == ["a", "b", "c"]
    assert got[Profile(signs="^]")][5] == ["a", "b", "c"]


def test_children(spark):
    schema = "id bigint, pos int, p array<struct<name:string,sizes:array<struct<label:string>>>>"
    size = lambda x: Row(label=x)
    rows = [(1, 9, [Row(name="a", sizes=[size("S"), None, size(" ")]), None, Row(name=None, sizes=[size("M")])])] * 2 + [(2, 9, None), (3, 9, []), (None, 9, [Row(name="b", sizes=None)])]
    df = spark.createDataFrame(rows, schema)
    got = child_tables(df, "id", [Child("p", ("p",), "name"), Child("s", ("p", "sizes"), "label")])
    assert [tuple(r) for r in got["p"].collect()] == [(1, [], -1, 0, "a")]
    assert sorted(map(tuple, got["s"].collect())) == [(1, [0], 0, 0, "S"), (1, [2], 2, 0, "M")]
    assert child_tables(df, "id", [Child("p", ("p",), "name")], values=False)["p"].columns == ["id", "ancestors", "parent_pos", "pos"]
    assert child_tables(df.limit(0), "id", [Child("p", ("p",), "name")])["p"].count() == 0


def test_children_of_three_levels(spark):
    df = spark.createDataFrame([(1, [([([("x",), (None,)],), None],), None, ([([],), ([("y",), ("z",)],)],)])], "id int, ps array<struct<a:array<struct<b:array<struct<v:string>>>>>>")
    got = child_tables(df, "id", [Child("b", ("ps", "a", "b"), "v")])["b"]
    assert sorted(map(tuple, got.collect())) == [(1, [0, 0], 0, 0, "x"), (1, [2, 1], 1, 0, "y"), (1, [2, 1], 1, 1, "z")]
    with pytest.raises(ValueError):
        child_tables(df, "id", [Child("b", (), "v")])


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("c")).first()["c"]


@pytest.mark.parametrize("text, want", [("About 1.2 million", 1_200_000.0), ("About 1,200 (150 in Canada)", 1200.0), ("none", None), (None, None), ("", None)])
def test_units(spark, text, want):
    assert one(spark, X.units_of(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [("between $10 and $30.", 20.0), ("for about $25", 25.0), ("for $1,250.50.", 1250.5), ("cash", None), (None, None)])
def test_price(spark, text, want):
    assert one(spark, X.price_of(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [("online at example.com", "online_only"), ("stores nationwide and online", "mixed"), ("outlet", "store_only"), ("", "unknown"), (None, "unknown")])
def test_channel(spark, text, want):
    assert one(spark, X.sales_channel(F.col("t")), t=text) == want


def test_labels(spark):
    assert one(spark, X.first_match([F.col("a"), F.col("b")], X.HAZARDS), a="choking", b="fire") == "choking_small_parts"
    assert one(spark, X.first_match([F.col("a"), F.col("b")], X.HAZARDS), a=" ", b="fire") == "flammability_burn"
    assert one(spark, X.earliest_label(X.lexicon_hits(F.col("t"), X.GARMENTS)), t="robe and nightgown") == "robe"
    assert one(spark, F.array_join(X.labels_in_order(X.lexicon_hits(F.col("t"), X.GARMENTS)), ","), t="robe and nightgown") == "robe,nightgown"
    assert one(spark, X.first_match([F.col("t")], X.GARMENTS), t="robe and nightgown") == "nightgown"
    assert one(spark, X.main_fibre(F.col("t")), t="60% Cotton, 40% polyester") == "cotton"
    assert one(spark, X.subject_of(F.col("t")), t="Oak Mills Recalls Robes Due to Burn Hazard") == "Oak Mills"
    assert one(spark, X.name_key(F.col("t")), t="Oak & Elm Apparel, Inc.") == "oak elm"
    assert one(spark, X.similarity_ratio(F.col("a"), F.col("b")), a="abcd", b="bcde") == pytest.approx(0.75)
    assert one(spark, F.array_join(X.tidy_list(F.col("t"), ";", {"Korea": "South Korea"}), ";"), t="Korea; China;Korea") == "South Korea;China"


@pytest.mark.parametrize("year, want", [(1973, None), (1989, "1974-1989"), (1990, "1990-1999"), (2025, "2020-2025"), (2026, None)])
def test_periods(spark, year, want):
    df = spark.createDataFrame([(year,)], "y int")
    assert df.select(X.period_of(F.col("y"), [1973, 1989, 1999, 2009, 2019, 2025])).first()[0] == want


def test_sources_and_sinks(spark, tmp_path):
    raw = [{"RecallID": 1, "Title": "Töys", "Products": [{"Name": "x", "NumberOfUnits": "About 5"}], "Hazards": None}, {"RecallID": 2}]
    (tmp_path / "raw.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(raw).encode())
    got = read_raw_events(spark, str(tmp_path / "raw.json")).orderBy("RecallID").collect()
    assert [r["RecallID"] for r in got] == [1, 2] and got[0]["Products"][0]["Name"] == "x" and got[1]["Products"] is None
    (tmp_path / "x.csv").write_text("Country,Year,DATA_VALUE\nPeru,2001,3.5\n,2002,\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "x.csv"), EXPOSURE).collect()] == [("Peru", 2001, 3.5), (None, 2002, None)]
    df = spark.createDataFrame([(1, "a|b", float("nan"))], "id int, t string, v double")
    write_table(df, str(tmp_path / "t"), csv=True)
    assert read_first(spark, [("v2", str(tmp_path / "none")), ("v1", str(tmp_path / "t"))]).first()["source_version"] == "v1"
    with pytest.raises(FileNotFoundError):
        read_first(spark, [("v2", str(tmp_path / "none"))])
    write_json(df, str(tmp_path / "t.json"))
    assert json.loads((tmp_path / "t.json").read_text()) == [{"id": 1, "t": "a|b", "v": None}]
    assert markdown(df.select("id", "t"), {"id": lambda v: f"#{v}"}) == "| id | t |\n| --- | --- |\n| #1 | a\\|b |"
    assert enriched(df, None, "id") is df
    assert enriched(df, df, "id").columns == ["id", "t", "v", "t_extra", "v_extra"]


@pytest.mark.parametrize(
    "title, want",
    [
        ("CPSC, Oak Mills Announce Recall of Robes", ("Oak Mills", "cpsc_joint")),
        ("Oak Mills and CPSC Announce Robe Recall", ("Oak Mills", "cpsc_joint")),
        ("Oak Mills.com Expands Recall of Robes", ("Oak Mills", "active")),
        ("Children's Robes Recalled by Elm Co. Due to Burn Hazard", ("Elm Co", "recalled_by")),
        ("Burn Hazard Prompts Recall of Robes Sold Exclusively by Fir Shop; Style 2", ("Fir Shop", "sold_by")),
        ("Robes Manufactured by Ash Ltd. for Children", ("Ash Ltd", "manufactured_by")),
        ("Warning: Robes may burn", (None, "none")),
        (None, (None, "none")),
    ],
)
def test_fit_subject(spark, title, want):
    assert tuple(one(spark, X.fit_subject_of(F.col("t")), t=title)) == want


@pytest.mark.parametrize(
    "title, want",
    [
        ("Oak Mills Recalls Two Styles of Robes Due to Burn Hazard", ("Styles of Robes", "Two Styles of Robes", "Styles of Robes")),
        ("Children's Robes Recalled by Elm Co. Due to Burn Hazard", ("Children's Robes",) * 3),
        ("CPSC Warns Consumers: Stop Using Certain Robes", ("Robes", "CPSC Warns Consumers", "CPSC Warns Consumers")),
        ("Oak Mills Stops Selling Robes Sold at Stores", ("Oak Mills Stops Selling Robes", "Oak Mills Stops Selling Robes", "Robes")),
        (None, ("",) * 3),
    ],
)
def test_headline_products(spark, title, want):
    assert tuple(one(spark, X.headline_product(F.col("t"), r), t=title) for r in ("boundary", "similarity", "topics")) == want


def test_channel_by_store_names(spark):
    assert one(spark, X.sales_channel(F.col("t")), t="Sold at Walmart") == "store_only"
    assert one(spark, X.first_match([F.lower("t")], [("excluded", X.EXCLUDED), ("apparel", X.APPAREL)], "unmatched"), t="Robe for a water pump") == "excluded"
