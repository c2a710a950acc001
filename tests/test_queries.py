import os

import duckdb
import pytest

import __spark_entry__ as entry
from vertebra.plans import queries as graph

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(graph.QUERIES))
def test_equals_sql(spark, sf_dir, sql, name):
    got = entry.queries()[name](spark, sf_dir)
    cur = sql.execute(graph.ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want


def test_traversals_reach_all(spark, sf_dir, sql):
    """No id bound: every order, every customer with orders, and every vertex near the start passes through."""
    q, one = entry.queries(), lambda s: sql.execute(s).fetchone()[0]
    assert q["expand_one_hop_all"](spark, sf_dir).count() == one("SELECT count(*) FROM orders")
    assert q["expand_two_hop_all"](spark, sf_dir).select("customer").distinct().count() == one("SELECT count(DISTINCT o_custkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
    assert q["lazy_property_filter_all"](spark, sf_dir).where("order_id > 500").count() == one("SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45 AND l_orderkey >= 500")
    near = {(r.label_id, r.id): r.steps for r in q["var_length_reachability_all"](spark, sf_dir).collect()}
    edges = sql.execute("SELECT 6, c_custkey + 1, 4, c_nationkey + 1 FROM customer UNION ALL SELECT 4, n_nationkey + 1, 3, n_regionkey + 1 FROM nation UNION ALL SELECT 7, s_suppkey + 1, 4, s_nationkey + 1 FROM supplier").fetchall()
    want = {(6, 1): 0}
    for n in range(1, 5):
        for a, b, c, d in edges:
            for x, y in (((a, b), (c, d)), ((c, d), (a, b))):
                if want.get(x, 9) == n - 1:
                    want.setdefault(y, n)
    assert near == want


def test_entry(spark):
    assert entry.entry(spark).count() == 5
