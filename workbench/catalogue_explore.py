"""Queries of dashboards: totals, series, alert log statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge import schemas
from fleetgauge.functions import text as X
from fleetgauge.operators import explore as E
from fleetgauge.operators.digest_runs import first_last, latest
from fleetgauge.operators.progress import union_types
from workbench.registry import add, in_emitted_order, ms
from workbench.views import END, START, Views

RANGE = "time BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-22'"
PERIOD = {"start": START, "end": END}
ENVS = ["env-0", "env-2"]


def rounded(df, *columns, n=2):
    return df.withColumns({c: F.round(c, n) for c in columns})


# --- AGG15: run totals, with FLT10 ------------------------------------------------------

for _kind, _names in (
    (C.GLUE_JOBS, ["job-1", "job-4", "job-7"]), (C.GLUE_WORKFLOWS, ["wf-1", "wf-2"]),
    (C.GLUE_CRAWLERS, ["crawler-1", "crawler-3"]), (C.GLUE_DATA_QUALITY, ["rules-1", "rules-5"]),
    (C.STEP_FUNCTIONS, ["sm-1", "sm-2"]), (C.EMR_SERVERLESS, ["app-0", "app-3"]),
):
    _dpu = _kind in (C.GLUE_JOBS, C.GLUE_CRAWLERS)
    _list = ", ".join(f"'{n}'" for n in _names)
    _hours = ["execution_hours", *(["dpu_hours"] if _dpu else [])]
    add(
        f"agg15_flt10_run_totals_{_kind}",
        lambda v, k=_kind, n=_names, h=_hours: rounded(
            E.run_totals(v.metrics(k), k, names=n, envs=ENVS, **PERIOD), *h, n=4),
        f"""SELECT sum(execution)::BIGINT AS total_runs, sum(failed)::BIGINT AS failed, sum(succeeded)::BIGINT AS succeeded,
            {'round(sum(dpu_seconds) / 3600, 4) AS dpu_hours,' if _dpu else ''}
            round(sum({C.DURATION[_kind]}) / 3600, 4) AS execution_hours FROM m_{_kind}
            WHERE {RANGE} AND resource_name IN ({_list}) AND monitored_environment IN ('env-0', 'env-2')""",
    )

_REQUESTS = f"""SELECT monitored_environment, resource_name, lambda_function_request_id, 1::BIGINT AS execution,
    (sum(invocation) - 1)::BIGINT AS retry_attempts, min(failed) AS failed, max(succeeded) AS succeeded,
    sum(duration_ms) AS duration_ms, sum(billed_duration_ms) AS billed_duration_ms, sum(memory_size_mb) AS memory_size_mb,
    sum("GB_seconds") AS "GB_seconds", max(max_memory_used_mb) AS max_memory_used_mb, min(time) AS time
    FROM m_lambda_functions WHERE {RANGE} GROUP BY 1, 2, 3"""

add("agg16_lambda_totals", lambda v: E.lambda_totals(v.m_lambda, **PERIOD),
    f"""SELECT sum(execution)::BIGINT AS total_executions, sum(succeeded)::BIGINT AS succeeded_executions,
        sum(failed)::BIGINT AS failed_executions, sum(retry_attempts)::BIGINT AS retry_attempts FROM ({_REQUESTS})""")
add(
    "agg17_lambda_usage",
    lambda v: rounded(E.lambda_usage(v.m_lambda, **PERIOD), "total_gb_seconds", "total_billed_sec", "total_duration_sec",
                      "total_memory_gb"),
    f"""SELECT round(sum("GB_seconds"), 2) AS total_gb_seconds, round(sum(billed_duration_ms) / 1000, 2) AS total_billed_sec,
        round(sum(duration_ms) / 1000, 2) AS total_duration_sec, round(sum(memory_size_mb) / 1024, 2) AS total_memory_gb,
        max(max_memory_used_mb) AS max_memory_used_mb FROM m_lambda_functions WHERE {RANGE}""",
)
_POINTS = C.SERIES_MEASURES[C.LAMBDA_FUNCTIONS]
add(
    "agg18_lambda_series",
    lambda v: rounded(ms(E.lambda_series(v.m_lambda, _POINTS, **PERIOD)), "duration_ms", "GB_seconds", n=6),
    f"""SELECT epoch_ms(time) AS time, {', '.join(
        f'round("{m}", 6) AS "{m}"' if m in ('duration_ms', 'GB_seconds') else f'"{m}"' for m in _POINTS)} FROM ({_REQUESTS})""",
)
add(
    "agg19_crawler_objects", lambda v: E.crawler_objects(v.metrics(C.GLUE_CRAWLERS), **PERIOD),
    " UNION ALL ".join(
        f"""SELECT '{label}' AS objects, sum({p}_added)::BIGINT AS added, sum({p}_updated)::BIGINT AS updated,
        sum({p}_deleted)::BIGINT AS deleted FROM m_glue_crawlers WHERE {RANGE}"""
        for label, p in (("Tables", "tables"), ("Partitions", "partitions"))),
)

_NEWEST = f"""SELECT * FROM m_glue_catalogs WHERE {RANGE}
    QUALIFY row_number() OVER (PARTITION BY resource_name ORDER BY time DESC) = 1"""
_COUNTS = ["tables_count", "partitions_count", "indexes_count"]
add("agg20_catalog_database_count", lambda v: E.catalog_database_count(v.m_catalogs, **PERIOD),
    f"SELECT count(DISTINCT resource_name)::BIGINT AS database_count FROM ({_NEWEST})")
add("agg21_catalog_totals", lambda v: E.catalog_totals(v.m_catalogs, **PERIOD),
    f"SELECT {', '.join(f'sum({c})::BIGINT AS total_{c}' for c in _COUNTS)} FROM ({_NEWEST})")
add("win2_latest_snapshots", lambda v: ms(latest(v.m_catalogs, ["resource_name"], _COUNTS)),
    f"""SELECT resource_name, epoch_ms(time) AS time, {', '.join(_COUNTS)} FROM (SELECT * FROM m_glue_catalogs
        QUALIFY row_number() OVER (PARTITION BY resource_name ORDER BY time DESC) = 1)""")
add(
    "win1_first_last",
    lambda v: ms(first_last(v.m_catalogs, ["resource_name"])).select("resource_name", "time", "tables_count", "rn_asc", "rn_desc")
    .withColumns({n: F.when(F.col(n) == 1, True).otherwise(False) for n in ("rn_asc", "rn_desc")}),
    """SELECT resource_name, epoch_ms(time) AS time, tables_count, a = 1 AS rn_asc, d = 1 AS rn_desc FROM (
        SELECT *, row_number() OVER (PARTITION BY resource_name ORDER BY time) AS a,
        row_number() OVER (PARTITION BY resource_name ORDER BY time DESC) AS d FROM m_glue_catalogs) WHERE a = 1 OR d = 1""",
)
_ENDS = """SELECT *, lag(tables_count) OVER w AS p_tables_count, lag(partitions_count) OVER w AS p_partitions_count,
    lag(indexes_count) OVER w AS p_indexes_count, row_number() OVER (PARTITION BY resource_name ORDER BY time DESC) AS rn FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_name ORDER BY time) AS a,
      row_number() OVER (PARTITION BY resource_name ORDER BY time DESC) AS d FROM m_glue_catalogs WHERE {}) WHERE a = 1 OR d = 1)
    WINDOW w AS (PARTITION BY resource_name ORDER BY time)"""
_LABEL = "CASE WHEN x > 0 THEN '+ ' || x WHEN x = 0 THEN '+ 0' ELSE x::VARCHAR END"


def _diff_sql(where: str) -> str:
    sums = ", ".join(f"sum({c} - p_{c})::BIGINT AS {c}" for c in _COUNTS)
    labels = ", ".join(f"{_LABEL.replace('x', c, 1).replace('|| x', f'|| {c}').replace('x = 0', f'{c} = 0').replace('x::', f'{c}::')} AS {c.replace('_count', '_diff')}" for c in _COUNTS)
    return f"SELECT {labels} FROM (SELECT {sums} FROM ({_ENDS.format(where)}) WHERE rn = 1)"


add("win4_str7_catalog_diff", lambda v: E.catalog_diff(v.m_catalogs, envs=ENVS, **PERIOD),
    _diff_sql(f"{RANGE} AND monitored_environment IN ('env-0', 'env-2')"))
add("win4_catalog_diff_single_snapshot",
    lambda v: E.catalog_diff(v.m_catalogs.filter(F.col("partitions_count") == 50).dropDuplicates(["resource_name"])),
    "SELECT NULL::VARCHAR AS tables_diff, NULL::VARCHAR AS partitions_diff, NULL::VARCHAR AS indexes_diff FROM (SELECT count(*) FROM events)")
add(
    "str7_signed", lambda v: v.ev.select("event_id", X.signed(F.col("k") - 50).alias("label")),
    "SELECT event_id, CASE WHEN k > 50 THEN '+ ' || (k - 50) WHEN k = 50 THEN '+ 0' ELSE (k - 50)::VARCHAR END AS label FROM ev",
)
add("srt4_database_list", lambda v: E.database_list(v.m_catalogs, 7, **PERIOD),
    f"SELECT DISTINCT resource_name FROM m_glue_catalogs WHERE {RANGE} ORDER BY 1 LIMIT 7")
add("set2_pick_list_environments", lambda v: E.pick_list(v.metrics(C.GLUE_JOBS), "monitored_environment"),
    "SELECT DISTINCT monitored_environment FROM m_glue_jobs")
add("set2_pick_list_resources", lambda v: E.pick_list(v.metrics(C.GLUE_JOBS), "resource_name"),
    "SELECT DISTINCT resource_name FROM m_glue_jobs")

# --- SER ----------------------------------------------------------------------------------

for _kind in C.RESOURCE_TYPES:
    if _kind == C.LAMBDA_FUNCTIONS:
        continue
    _measures = E.allowed_measures(_kind)
    add(
        f"ser1_ser2_series_{_kind}",
        lambda v, k=_kind, m=_measures: ms(E.series(v.metrics(k), k, m, envs=ENVS, **PERIOD)),
        f"""SELECT epoch_ms(time) AS time, {', '.join(f'"{m}"' for m in _measures)} FROM m_{_kind}
            WHERE {RANGE} AND monitored_environment IN ('env-0', 'env-2')""",
    )
def _counted(kind: str) -> list[str]:
    """Measures of a type that are whole numbers."""
    return [n for n, t in schemas.metrics_columns(kind).items() if t == "bigint"]


def _totals(v: Views) -> DataFrame:
    """Every whole-numbered measure of every type, `invocation` of functions included."""
    return union_types([
        E.totals_since(v.metrics(k), START, _counted(k)).select(
            F.lit(k).alias("resource_type"), F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("total")) for m in _counted(k)])))
        for k in C.RESOURCE_TYPES])


add(
    "agg28_totals_since", _totals,
    " UNION ALL ".join(
        f"""SELECT '{k}' AS resource_type, unnest([{', '.join(f"'{m}'" for m in _counted(k))}]) AS measure,
        unnest([{', '.join(f'sum("{m}")::BIGINT' for m in _counted(k))}]) AS total FROM m_{k} WHERE time > TIMESTAMP '2024-01-08'"""
        for k in C.RESOURCE_TYPES),
)

# --- alert log ----------------------------------------------------------------------------

_TYPES = ["glue_jobs", "glue_crawlers", "step_functions"]
_FILTER = {"types": _TYPES, "status_re": "ed$|stop", "name_re": "JOB-1"}
_WHERE = """resource_type IN ('glue_jobs', 'glue_crawlers', 'step_functions')
    AND regexp_matches(event_status, 'ed$|stop', 'i') AND regexp_matches(resource_name, 'job-1', 'i')"""
add("agg22_alert_count", lambda v: E.alert_count(v.alert_rows, **_FILTER),
    f"SELECT count(*)::BIGINT AS alerts FROM alert_rows WHERE {_WHERE}")
add("agg23_alerts_by_result", lambda v: in_emitted_order(E.alerts_by_result(v.alert_rows, **_FILTER), [], ["event_result"]),
    f"SELECT event_result, count(*)::BIGINT AS cnt, true AS in_order FROM alert_rows WHERE {_WHERE} GROUP BY 1")
add(
    "agg24_stf6_alerts_timeline", lambda v: ms(E.alerts_timeline(v.alert_rows, 5, results=["FAILURE", "SUCCESS"])),
    """SELECT epoch_ms(time_bucket(INTERVAL 5 MINUTES, event_time)) AS bin_start, count(*)::BIGINT AS events_cnt
        FROM alert_rows WHERE event_result IN ('FAILURE', 'SUCCESS') GROUP BY 1""",
)
add(
    "ser3_flt11_alert_listing",
    lambda v: ms(E.alert_listing(v.alert_rows, results=["FAILURE"], **_FILTER)),
    f"""SELECT epoch_us(event_time) // 1000 AS event_time, resource_type, resource_name, event_status, event_result,
        execution_info_url, event AS message FROM alert_rows WHERE event_result = 'FAILURE' AND {_WHERE}""",
)
add(
    "flt12_subject_contains",
    lambda v: E.subject_contains(v.alert_rows.select("event", X.subject(
        F.col("monitored_environment"), F.col("event_status"), F.col("resource_type"), F.col("resource_name")
    ).alias("message_subject")), ["FAILED", "job-3"]),
    """SELECT event, monitored_environment || ': ' || event_status || ' - ' || resource_type || ' : ' || resource_name
        AS message_subject FROM alert_rows WHERE event_status = 'FAILED' AND contains(resource_name, 'job-3')""",
)
