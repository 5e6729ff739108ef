"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import os

import pytest

from trailspark.plans import catalogue, catalogue_more, catalogue_places, catalogue_questions  # noqa: F401  the others add to the queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_agrees_with_sql(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, DIR)
    want = oracle.execute(catalogue.ORACLES[name])
    assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, oracle, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0


def test_traces_start_at_the_first_part(spark, tmp_path):
    import __spark_entry__ as entry

    own = [(1, p) for p in range(1, 9)] + [(2, 1), (2, 4)]  # 1 to 8 in a row, and a way from 1 to 4
    spark.createDataFrame(own, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    nodes = lambda name: sorted(r["node"] for r in entry.queries()[name](spark, str(tmp_path)).collect())
    assert nodes("backbone_path") == [1, 4, 5, 6, 7, 8]
    assert nodes("trace_fixed_point_first") == list(range(1, 9))


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
