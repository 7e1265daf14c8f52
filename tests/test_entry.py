"""The driver's contract, and agreement of a few queries with their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["f8_f9_routing", "c1_sections", "c5_windows", "g1_merge_nodes", "g12_closure", "w1_pack_context", "q1_q4_grade", "v2_topk"])
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    shape = lambda rows, names: sorted(repr([round(v, 6) if isinstance(v, float) else v for _, v in sorted(zip(names, r, strict=True))]) for r in rows)
    assert shape(map(tuple, got.collect()), got.columns) == shape(want.fetchall(), want.columns)


def test_views_that_join_large_tables_are_made_once(spark):
    """whatever reads the tree several times reads what was made, and joins and sorts the line items once."""
    from quillspan.plans.fixtures import view

    for name in ("tree", "related"):
        plan = view(spark, "/root/testdata/sf0.001", name)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
