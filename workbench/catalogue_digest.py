"""Queries of the digest: runs of a period, health, comments, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions import links, text
from fleetgauge.operators import digest_runs as D
from fleetgauge.operators import health as H
from fleetgauge.operators import matching as M
from fleetgauge.plans import digest as P
from fleetgauge.operators.progress import union_types
from fleetgauge.session import bounded_broadcast, scratch_path, settle
from fleetgauge.sources import settings as ST
from fleetgauge.sources import tables as TB
from workbench.registry import add, in_emitted_order, joined
from workbench.views import END, START, Views

RANGE = "time BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-22'"
_EMPTY = {
    "failed_attempts": "0::BIGINT", "context_type": "NULL::VARCHAR", "glue_table_name": "NULL::VARCHAR",
    "glue_db_name": "NULL::VARCHAR", "glue_job_name": "NULL::VARCHAR", "log_stream": "NULL::VARCHAR",
}


def _plain_sql(kind: str) -> str:
    extra = dict(_EMPTY)
    run_id = C.RUN_ID[kind]
    if kind == C.GLUE_DATA_QUALITY:
        run_id = "CASE context_type WHEN 'GLUE_DATA_CATALOG' THEN ruleset_run_id WHEN 'GLUE_JOB' THEN glue_job_run_id END"
        for n in ("context_type", "glue_table_name", "glue_db_name", "glue_job_name"):
            extra[n] = n
    return f"""SELECT '{kind}' AS resource_type, monitored_environment, resource_name,
        CASE WHEN failed > 0 THEN {run_id} ELSE '' END AS job_run_id, execution, failed, succeeded,
        {C.DURATION[kind]} AS execution_time_sec, CASE WHEN failed > 0 THEN error_message ELSE '' END AS error_message,
        {', '.join(f'{v} AS {n}' for n, v in extra.items())} FROM m_{kind} WHERE {RANGE}"""


_ATTEMPTS = f"""SELECT 'lambda_functions' AS resource_type, t.monitored_environment, t.resource_name,
    t.lambda_function_request_id AS job_run_id, 1::BIGINT AS execution, min(t.failed) AS failed, max(t.succeeded) AS succeeded,
    round(sum(t.duration_ms) / 1000, 2) AS execution_time_sec, ids.error_message, sum(t.failed)::BIGINT AS failed_attempts,
    NULL::VARCHAR AS context_type, NULL::VARCHAR AS glue_table_name, NULL::VARCHAR AS glue_db_name,
    NULL::VARCHAR AS glue_job_name, t.log_stream
    FROM m_lambda_functions t JOIN (SELECT lambda_function_request_id, coalesce(string_agg(error_message, ', ' ORDER BY time), '')
      AS error_message FROM m_lambda_functions WHERE {RANGE} GROUP BY 1) ids
    ON t.lambda_function_request_id = ids.lambda_function_request_id
    GROUP BY t.monitored_environment, t.resource_name, t.lambda_function_request_id, t.log_stream, ids.error_message"""

_KINDS = [k for k in C.RESOURCE_TYPES if k != C.GLUE_CATALOGS]
_DIG = {k: _ATTEMPTS if k == C.LAMBDA_FUNCTIONS else _plain_sql(k) for k in _KINDS}
_SECONDS = "round(execution_time_sec, 1) AS execution_time_sec"


def _runs(v: Views, kind: str) -> DataFrame:
    return D.digest_runs(v.metrics(kind), kind, START, END)


for _n, _kind in enumerate(C.RESOURCE_TYPES, 1):
    if _kind == C.GLUE_CATALOGS:
        continue
    if _kind == C.LAMBDA_FUNCTIONS:
        add("dig7_jn9_agg12_lambda_functions",
            lambda v: _runs(v, C.LAMBDA_FUNCTIONS).withColumn("execution_time_sec", F.round("execution_time_sec", 1)),
            f"SELECT * EXCLUDE (execution_time_sec), {_SECONDS} FROM ({_ATTEMPTS})")
        continue
    _n = {C.STEP_FUNCTIONS: 6}.get(_kind, _n)
    add(f"dig{_n}_{_kind}", lambda v, k=_kind: _runs(v, k), _DIG[_kind])

add(
    "agg14_request_errors", lambda v: D.request_errors(v.m_lambda, START, END),
    f"""SELECT lambda_function_request_id, coalesce(string_agg(error_message, ', ' ORDER BY time), '')
        AS error_message FROM m_lambda_functions WHERE {RANGE} GROUP BY 1""",
)
add(
    "agg14_very_many_request_errors",  # very many texts of one request: none is lost, in time order
    lambda v: D.request_errors(v.m_lambda.withColumn("lambda_function_request_id", F.col("resource_name")), START, END),
    f"""SELECT resource_name AS lambda_function_request_id, coalesce(string_agg(error_message, ', ' ORDER BY time, error_message), '')
        AS error_message FROM m_lambda_functions WHERE {RANGE} GROUP BY 1""",
)

# --- catalogs -----------------------------------------------------------------------------

_COUNTS = ["tables_count", "partitions_count", "indexes_count"]


def _delta_sql(keys: str) -> str:
    """The reference shape: first and last rows by two rankings, then a look back."""
    lags = ", ".join(f"lag({c}) OVER (PARTITION BY {keys} ORDER BY time) AS p_{c}" for c in _COUNTS)
    out = ", ".join(f"{c}, coalesce({c} - p_{c}, 0) AS {c.replace('_count', '_added')}" for c in _COUNTS)
    return f"""SELECT 'glue_catalogs' AS resource_type, monitored_environment, resource_name, {out} FROM (
        SELECT *, {lags}, row_number() OVER (PARTITION BY {keys} ORDER BY time DESC) AS rn FROM (
          SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY time DESC) AS d,
            row_number() OVER (PARTITION BY {keys} ORDER BY time) AS a FROM m_glue_catalogs WHERE {RANGE})
        WHERE a = 1 OR d = 1) WHERE rn = 1"""


_BY_ENV = _delta_sql("monitored_environment, resource_name")
add("dig4_win3_catalog_deltas", lambda v: D.catalog_deltas(v.m_catalogs, START, END), _BY_ENV)
add("dig4_win3_catalog_deltas_by_name", lambda v: D.catalog_deltas(v.m_catalogs, START, END, match_env=False),
    _delta_sql("resource_name"))

# --- health -------------------------------------------------------------------------------

_ALL = " UNION ALL BY NAME ".join(f"SELECT * FROM ({q})" for q in _DIG.values())
_MEASURES = """sum(coalesce(execution, 0))::BIGINT AS executions, sum(coalesce(succeeded, 0))::BIGINT AS success,
    sum(coalesce(failed, 0))::BIGINT AS errors,
    (count(*) FILTER (sla_seconds > 0 AND execution_time_sec > sla_seconds))::BIGINT AS breaches,
    (count(*) FILTER (succeeded > 0 AND failed_attempts > 0))::BIGINT AS late"""


def _health_sql(match: str = "c.resource_type = r.resource_type AND c.name = r.resource_name "
                "AND c.monitored_environment = r.monitored_environment") -> str:
    return f"""SELECT group_name, resource_type, monitored_environment, resource_name, account_id, region_name, sla_seconds,
        minimum_number_of_runs, executions, success, errors, breaches + late AS warnings, breaches > 0 AS has_sla_breach,
        late > 0 AS has_failed_attempts,
        minimum_number_of_runs > 0 AND executions < minimum_number_of_runs AS insufficient_runs,
        CASE WHEN errors > 0 OR (minimum_number_of_runs > 0 AND executions < minimum_number_of_runs) THEN 'error'
             WHEN breaches + late > 0 THEN 'warning' ELSE 'ok' END AS status
        FROM (SELECT c.group_name, c.resource_type, c.monitored_environment, c.name AS resource_name, c.account_id, c.region_name,
          c.sla_seconds, c.minimum_number_of_runs, {_MEASURES}
          FROM (SELECT * FROM config WHERE resource_type <> 'glue_catalogs') c LEFT JOIN ({_ALL}) r ON {match}
          GROUP BY ALL)"""


def _config(v: Views) -> DataFrame:
    return v.config().filter(F.col("resource_type") != C.GLUE_CATALOGS)


def _all_runs(v: Views) -> DataFrame:
    return P.all_runs(v.all_metrics(), START, END)


add("agg1_resource_health", lambda v: H.resource_health(_all_runs(v), _config(v)), _health_sql())
add("agg1_resource_health_by_name", lambda v: H.resource_health(_all_runs(v), _config(v), match_env=False),
    _health_sql("c.resource_type = r.resource_type AND c.name = r.resource_name"))
add(
    "agg1_glue_jobs_health",
    lambda v: H.aggregate_health(C.GLUE_JOBS, _runs(v, C.GLUE_JOBS), v.config()),
    f"SELECT * FROM ({_health_sql()}) WHERE resource_type = 'glue_jobs'",
)
add(
    "jn8_attach_runs",
    lambda v: H.resource_health(_all_runs(v), v.config(resolved=False).filter(F.col("resource_type") != C.GLUE_CATALOGS)).select(
        "group_name", "resource_type", "resource_name", "monitored_environment", "executions"),
    f"""SELECT group_name, c.resource_type, name AS resource_name, c.monitored_environment, coalesce(sum(execution), 0)::BIGINT AS executions
        FROM (SELECT DISTINCT group_name, resource_type, m.name, monitored_environment FROM monitored m
          JOIN environments v ON m.monitored_environment = v.name WHERE resource_type <> 'glue_catalogs') c
        LEFT JOIN ({_ALL}) r ON c.resource_type = r.resource_type AND c.name = r.resource_name
          AND c.monitored_environment = r.monitored_environment GROUP BY 1, 2, 3, 4""",
)
add(
    "agg6_str9_group_summary", lambda v: H.group_summary(H.resource_health(_all_runs(v), _config(v))),
    f"""SELECT *, CASE WHEN total_failures > 0 THEN 'error' WHEN total_warnings > 0 THEN 'warning' ELSE 'ok' END AS status,
        map {{{', '.join(f"'{t}': '{n}'" for t, n in C.DISPLAY_NAMES.items())}}}[resource_type] AS service_name FROM (
        SELECT group_name, resource_type, sum(executions)::BIGINT AS total_executions, sum(success)::BIGINT AS total_success,
          sum(errors + insufficient_runs::INT)::BIGINT AS total_failures, sum(warnings)::BIGINT AS total_warnings
        FROM ({_health_sql()}) GROUP BY 1, 2)""",
)

_CAT_HEALTH = f"""SELECT *, CASE WHEN least(tables_added, partitions_added, indexes_added) < 0 THEN 'warning' ELSE 'no_status' END
      AS status, coalesce(array_to_string([{', '.join(
          f"CASE WHEN {w.lower()}_added < 0 THEN 'WARNING: Some Glue Data Catalog {w} have been deleted.' END"
          for w in ('Tables', 'Partitions', 'Indexes'))}], '<br/>'), '') AS comments FROM (
    SELECT c.group_name, c.resource_type, c.monitored_environment, c.name AS resource_name, {', '.join(
        f'coalesce(sum({m}), 0)::BIGINT AS {m}' for m in H.CATALOG_MEASURES)}
    FROM (SELECT * FROM config WHERE resource_type = 'glue_catalogs') c LEFT JOIN ({_BY_ENV}) d
    ON c.name = d.resource_name AND c.monitored_environment = d.monitored_environment GROUP BY 1, 2, 3, 4)"""
_CAT_SUMMARY = f"""SELECT *, CASE WHEN least(total_tables_added, total_partitions_added, total_indexes_added) < 0
        THEN 'warning' ELSE 'no_status' END AS status, 'Glue Data Catalogs' AS service_name FROM (
      SELECT group_name, resource_type, {', '.join(f'sum({m})::BIGINT AS total_{m}' for m in H.CATALOG_MEASURES)}
      FROM ({_CAT_HEALTH}) GROUP BY 1, 2)"""


def _catalog_health(v: Views) -> DataFrame:
    return H.catalog_health(D.catalog_deltas(v.m_catalogs, START, END), v.config())


add("agg7_str10_catalog_health", _catalog_health, _CAT_HEALTH)
add("agg8_catalog_summary", lambda v: H.catalog_summary(_catalog_health(v)), _CAT_SUMMARY)


def _all_health(v: Views) -> DataFrame:
    """Health of all types, each by its own aggregator, in the columns they share."""
    parts = [H.aggregate_health(k, _runs(v, k), v.config()) for k in C.RESOURCE_TYPES]
    return union_types([p.select("group_name", "resource_type", "monitored_environment", "resource_name", "status") for p in parts])


add(
    "set5_all_health", _all_health,
    f"""SELECT group_name, resource_type, monitored_environment, resource_name, status FROM ({_health_sql()})
        UNION ALL SELECT group_name, resource_type, monitored_environment, resource_name, status FROM ({_CAT_HEALTH})""",
)

# --- comments -----------------------------------------------------------------------------

_P = "'https://' || region_name || '.console.aws.amazon.com"
_URL = f"""CASE c.resource_type
    WHEN 'glue_jobs' THEN {_P}/gluestudio/home?region=' || region_name || '#/job/' || c.name || '/run/' || job_run_id
    WHEN 'glue_workflows' THEN {_P}/glue/home?region=' || region_name || '#/v2/etl-configuration/workflows/run/' || c.name || '?runId=' || job_run_id
    WHEN 'glue_crawlers' THEN {_P}/glue/home?region=' || region_name || '#/v2/data-catalog/crawlers/view/' || c.name
    WHEN 'glue_data_quality' THEN CASE WHEN context_type = 'GLUE_DATA_CATALOG' THEN {_P}/glue/home?region=' || region_name
      || '#/v2/data-catalog/tables/evaluation-run-details/' || glue_table_name || '?database=' || glue_db_name || '&catalogId='
      || account_id || '&runid=' || job_run_id
      ELSE {_P}/gluestudio/home?region=' || region_name || '#/editor/job/' || glue_job_name || '/dataquality' END
    WHEN 'lambda_functions' THEN {_P}/cloudwatch/home?region=' || region_name || '#logsV2:log-groups/log-group/$252Faws$252Flambda$252F'
      || c.name || '/log-events/' || log_stream
    WHEN 'step_functions' THEN {_P}/states/home?region=' || region_name || '#/v2/executions/details/arn:aws:states:' || region_name
      || ':' || account_id || ':execution:' || c.name || ':' || job_run_id
    WHEN 'emr_serverless' THEN {_P}/emr?region=' || region_name || '#/serverless' END"""
_NOTED = f"""SELECT DISTINCT group_name, resource_type, monitored_environment, resource_name, unnest(CASE
      WHEN failed > 0 AND late THEN [2, 5] WHEN failed > 0 THEN [2] ELSE [5] END) AS section,
      ' - <a href=''' || url || '''> ERROR: ' || CASE WHEN length(msg) > 100 THEN substr(msg, 1, 100) || '...' ELSE msg END || '</a>' AS line
    FROM (SELECT c.group_name, c.resource_type, c.monitored_environment, c.name AS resource_name, failed,
        succeeded > 0 AND failed_attempts > 0 AS late, {_URL} AS url, coalesce(error_message, '') AS msg
      FROM (SELECT * FROM config WHERE resource_type <> 'glue_catalogs') c JOIN ({_ALL}) r ON c.resource_type = r.resource_type
        AND c.name = r.resource_name AND c.monitored_environment = r.monitored_environment
      WHERE failed > 0 OR (succeeded > 0 AND failed_attempts > 0))"""
_STANDING = f"""SELECT group_name, resource_type, monitored_environment, resource_name, l.section AS section, l.line AS line FROM (
    SELECT *, unnest([
      CASE WHEN errors > 0 THEN {{'section': 1, 'line': 'Some runs have failed:'}} END,
      CASE WHEN insufficient_runs THEN {{'section': 3, 'line': 'Insufficient runs: ' || executions
        || ' run(s) during the monitoring period (at least ' || minimum_number_of_runs || ' expected).'}} END,
      CASE WHEN has_failed_attempts THEN {{'section': 4,
        'line': 'WARNING: Some runs have succeeded after one or more retry attempts:'}} END,
      CASE WHEN has_sla_breach THEN {{'section': 6, 'line': 'WARNING: Some runs haven''t met SLA (=' || sla_seconds || ' sec).'}} END
    ]) AS l FROM ({_health_sql()})) WHERE l IS NOT NULL"""


_LINES = f"SELECT * FROM ({_NOTED}) UNION ALL SELECT * FROM ({_STANDING})"
_COMMENTS = f"""SELECT group_name, resource_type, monitored_environment, resource_name, piece, string_agg(line, '<br/>' ORDER BY section, line) AS comments
    FROM (SELECT *, (row_number() OVER (PARTITION BY group_name, resource_type, monitored_environment, resource_name ORDER BY section, line) - 1)
      // {H.JOINED_LINES} AS piece FROM ({_LINES})) GROUP BY 1, 2, 3, 4, 5"""


def _noted(v: Views) -> DataFrame:
    return H.run_comments(_all_runs(v), _config(v))


def _lines(v: Views) -> DataFrame:
    return H.comment_lines(H.resource_health(_all_runs(v), _config(v)), _noted(v))


add("agg5_str5_run_comments", _noted, _NOTED)
add("str11_comments", lambda v: H.comments(_lines(v)), _COMMENTS)
add(  # resources with very many lines: none is lost, each text is bounded
    "str11_very_many_comments", lambda v: H.comments(_lines(v)).withColumn("lines", F.size(F.split("comments", "<br/>"))).groupBy(*H.ENTRY).agg(
        F.sum("lines").alias("lines"), F.max("lines").alias("longest")),
    f"""SELECT group_name, resource_type, monitored_environment, resource_name, count(*)::BIGINT AS lines,
        least(count(*), {H.JOINED_LINES})::INT AS longest FROM ({_LINES}) GROUP BY 1, 2, 3, 4""",
)
add(
    "str6_encode_fragment",
    lambda v: v.ev.select("event_id", links.encode_fragment(
        F.concat(F.lit("/a/[$L]"), F.col("event_type"), F.lit("]$"))).alias("encoded")),
    "SELECT event_id, '$252Fa$252F$255B$2524L$255D' || event_type || '$255D$2524' AS encoded FROM ev",
)
add(
    "str8_resource_status",
    lambda v: v.ev.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n")).select(
        "event_type", "k", text.resource_status(F.when(F.col("event_type") == "error", F.col("n")).otherwise(0),
                                                F.col("k") % 10 == 0, F.col("k") % 3).alias("status")),
    """SELECT event_type, k, CASE WHEN event_type = 'error' OR k % 10 = 0 THEN 'error' WHEN k % 3 > 0 THEN 'warning' ELSE 'ok' END
        AS status FROM ev GROUP BY event_type, k""",
)
add(
    "str13_period_text",
    lambda v: v.ev.select("event_id", text.period_text(F.col("ts"), F.col("ts") + F.expr("INTERVAL 9 HOURS")).alias("period"),
                          text.digest_subject(F.col("ts")).alias("subject")),
    """SELECT event_id, 'This report has been generated for the period from ' || strftime(ts, '%B %d, %Y %I:%M %p') || ' to '
        || strftime(ts + INTERVAL 9 HOURS, '%B %d, %Y %I:%M %p') || '.' AS period,
        'Digest Report ' || strftime(ts, '%Y-%m-%d') AS subject FROM ev""",
)

# --- reports ------------------------------------------------------------------------------


def _parts(v: Views):
    config, metrics = _config(v), v.all_metrics()
    runs = P.all_runs(metrics, START, END)
    health = settle(H.resource_health(runs, config), "health")
    rows = P.generic_tables(H.group_summary(health), health, H.comment_lines(health, H.run_comments(runs, config)))
    catalogs = settle(_catalog_health(v), "catalog-health")
    return rows, P.catalog_tables(H.catalog_summary(catalogs), catalogs)


def _flat_rows(df: DataFrame) -> DataFrame:
    return joined(df, "values", sep="|").drop("row_order", "line_text")


_ROWS = f"""SELECT 1 AS section, group_name, resource_type, 0 AS line_section, 'row' AS kind, concat_ws('|', group_name, service_name,
      total_executions, total_success, total_failures, total_warnings) AS values, status AS style, group_name AS k1, NULL AS k2 FROM (
      SELECT *, CASE WHEN total_failures > 0 THEN 'error' WHEN total_warnings > 0 THEN 'warning' ELSE 'ok' END AS status,
        map {{{', '.join(f"'{t}': '{n}'" for t, n in C.DISPLAY_NAMES.items())}}}[resource_type] AS service_name FROM (
        SELECT group_name, resource_type, sum(executions)::BIGINT AS total_executions, sum(success)::BIGINT AS total_success,
          sum(errors + insufficient_runs::INT)::BIGINT AS total_failures, sum(warnings)::BIGINT AS total_warnings
        FROM ({_health_sql()}) GROUP BY 1, 2))
    UNION ALL SELECT 3, group_name, resource_type, 0, 'row', concat_ws('|', resource_name, success, errors, warnings), status, resource_name, monitored_environment
    FROM ({_health_sql()})
    UNION ALL SELECT 3, group_name, resource_type, section, 'comment', line, NULL, resource_name, monitored_environment FROM ({_LINES})"""
_CAT_ROWS = f"""SELECT 2 AS section, group_name, resource_type, 0 AS line_section, 'row' AS kind, concat_ws('|', group_name, service_name,
      {', '.join('total_' + m for m in H.CATALOG_MEASURES[3:] + H.CATALOG_MEASURES[:3])}) AS values, status AS style, group_name AS k1, NULL AS k2 FROM ({_CAT_SUMMARY})
    UNION ALL SELECT 3, group_name, resource_type, 0, 'row', concat_ws('|', resource_name,
      {', '.join(H.CATALOG_MEASURES[3:] + H.CATALOG_MEASURES[:3])}, comments), status, resource_name, monitored_environment FROM ({_CAT_HEALTH})"""
add("rep1_generic_tables", lambda v: _flat_rows(_parts(v)[0]), f"SELECT * EXCLUDE (k1, k2) FROM ({_ROWS})")
add("rep2_catalog_tables", lambda v: _flat_rows(_parts(v)[1]), f"SELECT * EXCLUDE (k1, k2) FROM ({_CAT_ROWS})")
add(
    "srt1_order_digest",
    lambda v: in_emitted_order(
        P.order_digest(H.group_summary(H.resource_health(_all_runs(v), _config(v)))).select(
            "group_name", text.type_ordinal(F.col("resource_type")).alias("type_order"), "resource_type", "total_executions"),
        [], ["group_name", "type_order"]).drop("type_order"),
    f"""SELECT group_name, resource_type, sum(executions)::BIGINT AS total_executions, true AS in_order
        FROM ({_health_sql()}) GROUP BY 1, 2""",
)


def _reports(v: Views) -> DataFrame:
    return P.digest(v.all_metrics(), v.config(), v.recipients, v.delivery_methods, START, END)


_SUMMARY_HEAD, _RESOURCE_HEAD = "|".join(C.SUMMARY_HEADER), "|".join(C.RESOURCE_HEADER)
_CSUMMARY_HEAD, _CRESOURCE_HEAD = "|".join(C.CATALOG_SUMMARY_HEADER), "|".join(C.CATALOG_RESOURCE_HEADER)
_ORD = f"list_position([{', '.join(f'{chr(39)}{t}{chr(39)}' for t in C.RESOURCE_TYPES)}], resource_type)"
_LINES_SQL = f"""WITH aud AS (SELECT delivery_method, monitoring_groups, (row_number() OVER (PARTITION BY delivery_method, monitoring_groups ORDER BY recipient) - 1)
      // {M.RECIPIENTS} AS part, recipient FROM recipient_groups),
    mine AS (SELECT DISTINCT delivery_method, monitoring_groups, unnest(monitoring_groups) AS group_name FROM aud),
    t AS (SELECT m.delivery_method, m.monitoring_groups, section, CASE WHEN section = 3 THEN group_name ELSE '' END AS g,
        CASE WHEN section = 3 THEN {_ORD} ELSE 0 END AS o, CASE WHEN section = 3 THEN resource_type END AS resource_type,
        k1 || chr(0) || CASE WHEN section < 3 THEN ({_ORD} - 1)::VARCHAR ELSE coalesce(k2, '') END AS row_order, line_section, kind, values, style
      FROM ({_ROWS} UNION ALL {_CAT_ROWS}) JOIN mine m USING (group_name)),
    blocks AS (SELECT DISTINCT delivery_method, monitoring_groups, section, g, o, resource_type FROM t),
    placed AS (
      SELECT * EXCLUDE (resource_type) FROM t
      UNION ALL SELECT delivery_method, monitoring_groups, section, g, o, '', -2, 'text', g || ': ' ||
        map {{{', '.join(f"'{t}': '{n}'" for t, n in C.DISPLAY_NAMES.items())}}}[resource_type], 'header' FROM blocks WHERE section = 3
      UNION ALL SELECT delivery_method, monitoring_groups, section, g, o, '', -1, 'header', CASE WHEN section = 1 THEN '{_SUMMARY_HEAD}'
        WHEN section = 2 THEN '{_CSUMMARY_HEAD}' WHEN resource_type = 'glue_catalogs' THEN '{_CRESOURCE_HEAD}' ELSE '{_RESOURCE_HEAD}' END, NULL FROM blocks
      UNION ALL SELECT DISTINCT delivery_method, monitoring_groups, 0, '', 0, '', -2, 'text', 'Digest Summary', 'header' FROM blocks
      UNION ALL SELECT DISTINCT delivery_method, monitoring_groups, 0, '', 0, '', -1, 'text',
        'This report has been generated for the period from January 08, 2024 12:00 AM to January 22, 2024 12:00 AM.', 'h11' FROM blocks)
    SELECT delivery_method, monitoring_groups, row_number() OVER (PARTITION BY delivery_method, monitoring_groups
        ORDER BY section, g, o, row_order, line_section, values, style NULLS FIRST) AS ordinal, kind, values, style FROM placed"""


def _report_lines(v: Views) -> DataFrame:
    """Every line of every report with its number."""
    generic, catalogs = _parts(v)
    audiences = settle(P.with_audience(M.group_recipients(v.recipients, v.delivery_methods)), "audiences")
    lines = P.report_lines(generic.unionByName(catalogs), audiences, START, END)
    who = audiences.select("audience", "delivery_method", "monitoring_groups").distinct()
    return joined(joined(lines.join(bounded_broadcast(who), "audience"), "values", sep="|"), "monitoring_groups").drop("audience")


def _body_digests(reports: DataFrame) -> DataFrame:
    """Bodies as digests of their lines, in their order."""
    line = lambda b: F.concat_ws("|", b["kind"], b["style"], F.array_join(b["values"], "|"))
    return joined(reports, "recipients").select(
        "delivery_method", "recipients", "part", "piece", F.size("message_body").alias("lines"),
        F.md5(F.array_join(F.transform("message_body", line), "\n")).alias("digest"), "message_subject")


def _stored_digest(v: Views) -> DataFrame:
    """The whole job: stored tables, settings, and the period from the tooling's hours."""
    base = scratch_path(v.spark, "digest")
    for kind, facts in v.all_metrics().items():
        TB.write_metrics(facts, base, kind)
    tooling = v.table("region").agg(F.lit(14 * 24).alias("digest_report_period_hours"))
    settings = ST.Settings(
        v.environments, v.delivery_methods, v.monitored.select("group_name").distinct(), v.monitored, v.recipients, tooling)
    return P.run_digest(v.spark, base, settings, v.inventory, END)


_DIGESTS = f"""SELECT delivery_method, recipients, part, piece, lines, digest, 'Digest Report 2024-01-22' AS message_subject FROM (
      SELECT delivery_method, monitoring_groups, (ordinal - 1) // {P.LINES} AS piece, count(*)::INT AS lines,
        md5(string_agg(concat_ws('|', kind, style, values), chr(10) ORDER BY ordinal)) AS digest FROM ({_LINES_SQL}) GROUP BY 1, 2, 3)
    JOIN (SELECT delivery_method, monitoring_groups, part, string_agg(recipient, ',' ORDER BY recipient) AS recipients FROM (
        SELECT *, (row_number() OVER (PARTITION BY delivery_method, monitoring_groups ORDER BY recipient) - 1) // {M.RECIPIENTS} AS part
        FROM recipient_groups) GROUP BY 1, 2, 3) USING (delivery_method, monitoring_groups)"""
add("rep3_rep4_reports", lambda v: _body_digests(_reports(v)), _DIGESTS)
add("rep3_rep4_report_lines", _report_lines,
    f"SELECT delivery_method, array_to_string(monitoring_groups, ',') AS monitoring_groups, ordinal, kind, values, style FROM ({_LINES_SQL})")
add("j4_run_digest", lambda v: _body_digests(_stored_digest(v)), _DIGESTS)
