"""Every registered query with SQL gives the same rows as DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from ledgerloom.plans import layout_queries, report_queries, search_queries, topology_queries  # noqa: F401  (each registers its queries)
from ledgerloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(x) for x in r) for r in df.select(*columns).collect())
    rel = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert sorted(names) == columns
    assert got == want


def test_dates_branch_the_search(spark):
    """Two dates a row: of three rows the search opens every date that isn't earlier than the one before."""
    import datetime
    from decimal import Decimal

    from ledgerloom.operators import search

    day = lambda n: datetime.date(2027, 1, n)
    rows = spark.createDataFrame([(1, i, [day(i), day(i + 1)], Decimal(1), None) for i in (1, 2, 3)], "doc_id long, doc_order int, dates array<date>, left_amount decimal(38,2), right_amount decimal(38,2)")
    bounds = spark.createDataFrame([(1, Decimal(0), Decimal(3))], "doc_id long, opening decimal(38,2), closing decimal(38,2)")
    found = search.bounded_status(search.bounded_search(rows, bounds)).first()
    # Ascending: 1 + 2 + 4 + 8 states, all 8 ways hold. Descending: the root, two dates of the third row, four of the second, of
    # which one isn't too early, and two of the first, which both are.
    assert (found["visited"], found["survivors"], found["exhausted"], found["status"]) == (15 + 9, 8, False, "ambiguous")
    assert found["pruned"] == {"chronology_dates": 5}
    assert [t["state"] for t in found["trace"]] == list(range(24))
    assert sum(t["outcome"] == "survived" for t in found["trace"]) == 8
    assert all(t["parent"] is None or found["trace"][t["parent"]]["outcome"] == "expanded" for t in found["trace"])
    assert search.bounded_search(rows, bounds, max_states=5).first()["exhausted"]


def test_without_subpackage():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_conversion_by_small_plans(spark, db):
    """No plan of convert_documents joins all tables of documents at once: its tasks would hold memory for all of their sorts."""
    ran = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = ran().size()
    QUERIES["convert_documents"](spark, SF).collect()
    plans = [ran().apply(i).physicalPlanDescription() for i in range(before, ran().size())]
    trees = [p.split("\n\n\n")[0].split("== Initial Plan ==")[-1] for p in plans]
    assert len(trees) > 5
    assert max(t.count("Join") for t in trees) <= 10
    assert max(t.count("Window") for t in trees) <= 10
