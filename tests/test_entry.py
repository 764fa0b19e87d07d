"""The registered queries against their SQL, at the smallest size."""

import glob
import os

import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline")))


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-6


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in cursor.fetchall()), key=repr)
    found = sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr)
    assert len(found) == len(expected)
    assert all(same(x, y) for a, b in zip(found, expected, strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark, sf_dir):
    assert entry.entry(spark).first()["mismatched"] == 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_does_not_import_the_removable_part():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/vertexloom/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path, encoding="utf-8") as f:
                text = f.read()
            assert "import llm" not in text and ".llm" not in text, path


def test_plans_have_no_nested_loops_and_prune_columns(spark, sf_dir):
    """Equi-joins throughout, and scans that read what is asked for only."""
    for name in ("gscore_w5", "spmv_plain", "two_hop_scores", "relabel_edges"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
        assert "l_extendedprice" not in plan.split("== Physical Plan ==")[-1]
