import glob
import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from tidemark.plans import registry  # noqa: E402

duckdb = pytest.importorskip("duckdb")
AGAINST_SQL = ("p1_found", "p2_totals", "p5_hierarchy", "p6_found", "p7_stats", "impact_down", "importance", "bm25_topk", "tfidf_link", "explicit_link", "enclosing_symbol", "merge3", "asof_history", "recall_order", "gaps", "rename_plan")


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    same = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(([same(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", AGAINST_SQL)
def test_query_equals_its_sql(spark, sf, db, name):
    got = registry.queries()[name](spark, sf)
    cur = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert cells([tuple(r) for r in got.collect()], got.columns) == cells(cur.fetchall(), names)


def test_every_sql_has_its_query_and_every_problem_is_there():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 90
    core = registry.queries()
    assert {"p1_found", "p2_found", "p5_found", "p6_found", "p7_found"} <= set(core)
    assert all(callable(f) for f in q.values())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).columns == ["idempotency_key", "assertion_id"]


def test_the_core_stands_without_the_llm_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())
