"""The driver's contract, and a sample of queries against their SQL."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["country", "period", "events", "volume", "rate"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p5_found", "agg6_crosstab_lift", "win4_prior_events", "str4_earliest_longest", "ct7_mantel_haenszel", "agg19_gini"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    import verify

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert verify.rows_of(df.columns, [tuple(r) for r in df.collect()]) == verify.rows_of([d[0] for d in cur.description], cur.fetchall())


def test_core_does_not_import_the_training_subpackage():
    code = "import sys; from tessera.plans import catalogue; assert not [m for m in sys.modules if m.startswith('tessera.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
