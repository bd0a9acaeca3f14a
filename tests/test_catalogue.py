"""Every query with SQL gives the same rows in DuckDB; no range join becomes a nested loop; kernel queries return rows."""

import duckdb
import pytest

from volumetra.operators import spatial
from volumetra.plans import catalogue, fixtures, jobs

SF = "/root/testdata/sf0.001"
TABLES = "part supplier lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.SQL | jobs.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = (catalogue.QUERIES | jobs.QUERIES)[name](spark, SF)
    want = duck.execute((catalogue.SQL | jobs.SQL)[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_range_joins_are_equi_joins(spark):
    plan = spatial.overlapping_pairs(fixtures.views(spark, SF), 150)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES | jobs.QUERIES))
def test_no_query_plans_a_nested_loop(spark, name):
    plan = (catalogue.QUERIES | jobs.QUERIES)[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["detect_dog", "stitch_phase", "match_ransac", "match_icp", "merge_points", "solve_global", "fuse_affine_blocks", "resave_pyramid"])
def test_kernel_queries_run(spark, name):
    assert jobs.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_point_queries_see_every_point_and_pair(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    assert jobs.QUERIES["merge_points"](spark, sf).agg({"n": "sum"}).first()[0] == 10_000
    seen = {}

    def spy(pairs, points, method, **options):
        seen[method] = (pairs.count(), points.count())
        return points

    monkeypatch.setattr(jobs.registration, "match_points", spy)
    for name in ("match_icp", "match_fast_rotation", "match_precise_translation"):
        jobs.QUERIES[name](spark, sf)
    assert seen == dict.fromkeys(("ICP", "FAST_ROTATION", "PRECISE_TRANSLATION"), (28, 10_000))
