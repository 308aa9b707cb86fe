"""Registered queries: complete, importable without a session, and equal to their SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from fleetgauge import constants as C
from fleetgauge.operators import explore
from workbench import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()
SAMPLE = [
    "prj1_glue_jobs", "prj2_glue_workflows", "prj7_lambda_functions", "agg9_set1_last_update_times", "jn2_expand_wildcards",
    "dig4_win3_catalog_deltas", "dig7_jn9_agg12_lambda_functions", "agg1_resource_health", "agg5_str5_run_comments",
    "agg15_flt10_run_totals_glue_jobs", "win4_str7_catalog_diff", "agg24_stf6_alerts_timeline", "snk2_alert_log",
    "stf1_sessionise_stream",
]


def plain(x):
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return "nan" if math.isnan(x) else repr(float(x))
    return str(x)


def test_every_query_has_its_sql():
    queries, sql = entry_points.queries(), entry_points.oracle_sql()
    assert set(catalogue.SPARK) == set(catalogue.SQL) and len(catalogue.SPARK) > 150
    assert set(catalogue.SPARK) <= set(queries) and set(sql) <= set(queries)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_points.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(entry_points.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(at) == columns
    assert got == sorted(tuple(plain(r[at[c]]) for c in columns) for r in cursor.fetchall())


def test_series_reject_unknown_measures(spark):
    with pytest.raises(ValueError):
        explore.series(None, C.GLUE_JOBS, ["error_message"])
    with pytest.raises(ValueError):
        explore.allowed_measures("nothing")
