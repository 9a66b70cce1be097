"""Tables in other formats: the same answers as SQL over Parquet, odd rows kept, filters and columns at the scan."""

import duckdb
import pytest

from lodestar.plans import formats, relational
from lodestar.sources import tables

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, "a,b"), (2, 'say "so"'), (3, ""), (4, None), (5, "  both ends "), (None, "é \\ ü"), (1, "a,b"), (6, "x" * 100_000)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", ["format_csv", "format_json", "format_orc", "format_text"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "conversations", "lineitem", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = relational.queries()[name](spark, FOLDER)
    want = con.execute(relational.oracle_sql()[name])
    assert got.columns == [c[0] for c in want.description]
    found = rows(got)
    assert found == sorted(want.fetchall(), key=repr)
    assert found


@pytest.mark.parametrize("kind", ["csv", "json", "orc", "parquet"])
def test_odd_rows_come_back(spark, kind):
    df = spark.createDataFrame(ODD, "id long, text string")
    options = formats.CSV if kind == "csv" else {}
    assert rows(formats.stored(df, kind, **options)) == rows(df)
    assert rows(formats.stored(df.limit(0), kind, **options)) == []


def test_json_keeps_line_feeds(spark):
    df = spark.createDataFrame([(1, "a\nb\r\nc"), (2, " ")], "id long, text string")
    assert rows(formats.stored(df, "json")) == rows(df)


def test_orc_prunes(spark):
    lines = formats.stored(tables.table(spark, FOLDER, "lineitem"), "orc").where("l_quantity > 45").select("l_linenumber")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan
    assert "ReadSchema: struct<l_linenumber:int,l_quantity:double>" in plan
