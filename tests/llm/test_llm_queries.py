import glob
import os

import duckdb
import pytest

from placeweave.llm.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name, columns", [("p4_found", ["uid_a", "uid_b"]), ("p6_found", ["uid_a", "uid_b"]), ("p9_found", ["doc_id", "subject"])])
def test_found_rows_are_distinct(spark, name, columns):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == columns and (rows or name == "p9_found") and len(rows) == len(set(rows))
    if columns[0] == "uid_a":
        assert all(a < b for a, b in rows)


@pytest.mark.parametrize("name", ["p4_found", "p6_found"])
def test_features_of_one_venue_are_linked(spark, name):
    """The venue ids that some features carry are withheld from the operators: most pairs of one venue must be found."""
    found = {tuple(r) for r in QUERIES[name](spark, SF).collect()}
    con = duckdb.connect()
    known = con.sql(f"""WITH f AS (SELECT uid, any_value(properties['lieu:guid']) AS g, any_value(properties['addr:housenumber']) AS n, any_value(properties['addr:street']) AS s, any_value(properties['addr:city']) AS c, any_value(properties['wof:name']) AS w
      FROM '{SF}/features.parquet' GROUP BY uid) SELECT a.uid, b.uid FROM f a JOIN f b ON a.g = b.g AND a.uid < b.uid WHERE a.n IS NOT NULL AND b.n IS NOT NULL AND a.s IS NOT NULL AND b.s IS NOT NULL AND a.c IS NOT NULL AND b.c IS NOT NULL AND ('{name}' = 'p4_found' OR (a.w IS NOT NULL AND b.w IS NOT NULL))""").fetchall()
    assert len(known) > 10 and sum(p in found for p in known) >= 0.9 * len(known)
