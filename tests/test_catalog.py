"""Every query with an oracle gives the rows of its SQL."""

from decimal import Decimal

import duckdb
import pytest

from popspark.plans import catalog, fitting, more, roundtrips, tracing  # noqa: F401

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(records, columns):
    return sorted([tuple(str(plain(r[c])) for c in columns) for r in records])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows([r.asDict() for r in got.collect()], columns) == rows([dict(zip(want.columns, r)) for r in want.fetchall()], columns)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_layout_independent(spark, sf):
    """Keyed draws do not depend on the number of partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(tuple, catalog.weighted_draw_by_zone(spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_ipu_survey_is_drawn_from_all_households(spark, sf):
    got = {r.hhid for r in catalog.ipu_weights(spark, sf).select("hhid").distinct().collect()}
    assert got == {r.hhid for r in catalog.sampled_hh(spark, sf).select("hhid").collect()} and any(k % 15 for k in got)


@pytest.mark.parametrize("name", ["naive_population", "weighted_draw", "weighted_draw_by_zone", "sample_exact_fraction", "row_chunks"])
def test_no_single_task(spark, sf, name):
    """Draws, exact samples and row numbers meet neither in a cross join nor in one partition."""
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition", "TakeOrderedAndProject"))
