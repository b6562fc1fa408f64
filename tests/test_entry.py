"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from sluice.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["span_positions", "span_containment", "hit_cap", "html_links", "kb_nearest", "soft404"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = own.QUERIES[name](spark, SF)
    columns = ", ".join(sorted(df.columns))
    got = sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))
    want = sorted(map(str, (tuple(r) for r in con.execute(f"SELECT {columns} FROM ({own.ORACLES[name]})").fetchall())))
    assert got == want
