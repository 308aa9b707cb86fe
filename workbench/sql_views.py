"""The shapes of `views.py`, in SQL, as common table expressions."""

from __future__ import annotations

import re

from workbench.views import STEMS

TYPES = [
    "glue_jobs", "glue_workflows", "glue_crawlers", "glue_catalogs", "glue_data_quality",
    "lambda_functions", "step_functions", "emr_serverless",
]

ENV = "'env-' || (user_id % 3)"
BAD = "event_type = 'error'"
OPEN = "event_type = 'view'"
MS = "date_trunc('milliseconds', ts)"
SECONDS = "CAST(round(value * 1000000) AS BIGINT) / 1000000.0"
LONG = "'k=' || k || ' ' || repeat('x', (k + 20)::INT)"


def name(stem: str) -> str:
    return f"'{stem}-' || (user_id // 2)"


def pick(bad: list[str], open_: str, good: str) -> str:
    cases = " ".join(f"WHEN {BAD} AND k % {len(bad)} = {i} THEN '{b}'" for i, b in enumerate(bad))
    return f"CASE {cases} WHEN {OPEN} THEN '{open_}' ELSE '{good}' END"


def cut(text: str, n: int) -> str:
    return f"CASE WHEN length({text}) > {n} THEN substr({text}, 1, {n}) || '...' ELSE {text} END"


FLAG = f"({BAD})::INT::BIGINT"
GOOD = f"(event_type NOT IN ('error', 'view'))::INT::BIGINT"
BASE = f"event_id, {ENV} AS monitored_environment, {MS} AS time"

VIEWS = {
    "ev": "SELECT event_id, ts, user_id, event_type, value, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    "m_glue_jobs": f"""SELECT {BASE}, {name('job')} AS resource_name, 'jr_' || event_id AS job_run_id,
        1::BIGINT AS execution, {GOOD} AS succeeded, {FLAG} AS failed,
        floor(value)::DOUBLE AS execution_time_sec, CASE WHEN {BAD} THEN {LONG} END AS error_message,
        round(CASE WHEN k % 3 = 2 AND value <> 0 THEN value * 3 ELSE floor(value) * (k % 3 + 2) END, 3)
            AS dpu_seconds
        FROM ev WHERE NOT ({OPEN})""",
    "wf_base": f"""SELECT *, k % 5 + 1 AS total, (k % 7 = 0)::INT AS bad1,
        ({BAD} OR k % 7 = 0)::INT::BIGINT AS wf_failed FROM ev WHERE NOT ({OPEN})""",
    "m_glue_workflows": f"""SELECT {BASE}, {name('wf')} AS resource_name, 'wr_' || event_id AS workflow_run_id,
        1::BIGINT AS execution, 1 - wf_failed AS succeeded, wf_failed AS failed, {SECONDS} AS execution_time_sec,
        CASE WHEN {BAD} AND k % 2 = 0 THEN 'wf k=' || k
             WHEN wf_failed = 1 AND k % 3 = 1 THEN 'JOB Error: ' || {cut("repeat('e', k::INT)", 50)}
             WHEN wf_failed = 1 AND k % 3 = 2 THEN 'Total Errors: 2. JOB Error: x; CRAWLER Error: c=' || k
        END AS error_message,
        total AS actions_total, k % 2 AS actions_timeouted, bad1::BIGINT AS actions_failed,
        k % 3 AS actions_stopped, total - bad1 AS actions_succeeded, k % 4 AS actions_errored
        FROM wf_base""",
    "m_glue_crawlers": f"""SELECT {BASE}, {name('crawler')} AS resource_name, 'cr_' || event_id AS crawl_id,
        1::BIGINT AS execution, {GOOD} AS succeeded, {FLAG} AS failed, {SECONDS} AS duration_sec,
        CASE WHEN k % 10 <> 9 THEN round(k / 1000.0 * 3600, 3) END AS dpu_seconds,
        CASE WHEN {BAD} THEN 'crawl k=' || k END AS error_message,
        CASE WHEN k % 4 = 2 THEN k ELSE 0 END AS tables_added,
        CASE WHEN k % 4 = 3 THEN k ELSE 0 END AS tables_updated,
        CASE WHEN k % 4 = 2 THEN 2 ELSE 0 END AS tables_deleted,
        CASE WHEN k % 4 = 3 THEN 5 ELSE 0 END AS partitions_added,
        0::BIGINT AS partitions_updated, 0::BIGINT AS partitions_deleted
        FROM ev WHERE NOT ({OPEN})""",
    "m_glue_catalogs": f"""SELECT {BASE}, {name('db')} AS resource_name, '123' AS catalog_id,
        floor(value)::BIGINT AS tables_count, k AS partitions_count, event_id % 7 AS indexes_count FROM ev""",
    "dq_base": f"""SELECT *, k % 4 AS n, (k % 4 >= 1 AND {BAD})::INT AS f1, (k % 4 >= 2 AND k % 5 = 0)::INT AS f2,
        'bad value ' || repeat('9', k::INT) AS said FROM ev""",
    "dq_text": """SELECT *, CASE WHEN f1 = 1 AND f2 = 1 THEN 'r1: ' || said || '; r2: ' || said
        WHEN f1 = 1 THEN 'r1: ' || said WHEN f2 = 1 THEN 'r2: ' || said END AS full_text FROM dq_base""",
    "m_glue_data_quality": f"""SELECT {BASE}, {name('rules')} AS resource_name, 'dq_' || event_id AS dq_result_id,
        k / 100.0 AS score, CASE WHEN k % 2 = 0 THEN 'GLUE_DATA_CATALOG' ELSE 'GLUE_JOB' END AS context_type,
        1::BIGINT AS execution, (f1 + f2 = 0)::INT::BIGINT AS succeeded, (f1 + f2 > 0)::INT::BIGINT AS failed,
        n - f1 - f2 AS rules_succeeded, (f1 + f2)::BIGINT AS rules_failed, n AS total_rules,
        {SECONDS} AS execution_time_sec, {cut('full_text', 100)} AS error_message,
        CASE WHEN k % 2 = 0 THEN 'rr_' || event_id END AS ruleset_run_id,
        CASE WHEN k % 2 = 0 THEN 'tbl-' || k END AS glue_table_name,
        CASE WHEN k % 2 = 0 THEN {name('db')} END AS glue_db_name,
        CASE WHEN k % 2 = 1 THEN {name('job')} END AS glue_job_name,
        CASE WHEN k % 2 = 1 THEN 'jr_' || event_id END AS glue_job_run_id FROM dq_text""",
    "m_step_functions": f"""SELECT {BASE}, {name('sm')} AS resource_name, 'ex_' || event_id AS step_function_run_id,
        1::BIGINT AS execution, {GOOD} AS succeeded, {FLAG} AS failed, {SECONDS} AS duration_sec,
        CASE WHEN {BAD} THEN CASE WHEN k % 2 = 0 THEN 'Err' ELSE '' END || ' {{"k":' || k || '}}' END
            AS error_message FROM ev WHERE NOT ({OPEN})""",
    "m_emr_serverless": f"""SELECT {BASE}, {name('app')} AS resource_name, 'er_' || event_id AS job_run_id,
        'n' || k AS job_run_name, 'app' || (user_id // 2) AS app_id, 1::BIGINT AS execution,
        {GOOD} AS succeeded, {FLAG} AS failed, floor(value)::DOUBLE AS execution_time_sec,
        CASE WHEN {BAD} THEN {cut("repeat('ab', (2 * k)::INT)", 200)} END AS error_message,
        value AS "total_vCPU_hour", value * 4 AS "total_memory_GB_hour", k::DOUBLE AS "total_storage_GB_hour",
        value * 0.5 AS "billed_vCPU_hour", value * 4 * 0.5 AS "billed_memory_GB_hour",
        k::DOUBLE AS "billed_storage_GB_hour"
        FROM ev WHERE NOT ({OPEN}) AND k % 10 <> 0""",
    "m_lambda_functions": f"""SELECT event_id, 'env-' || (event_id // 3 % 3) AS monitored_environment,
        'fn-' || (event_id // 3 % 8) AS resource_name, {MS} AS time,
        'req-' || (event_id // 3) AS lambda_function_request_id, 'ls-' || (event_id // 2 % 16) AS log_stream,
        1::BIGINT AS invocation, 1 - {FLAG} AS succeeded, {FLAG} AS failed,
        CASE WHEN {BAD} THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, value AS duration_ms,
        ceil(value)::DOUBLE AS billed_duration_ms, (k % 4 * 128 + 128)::DOUBLE AS memory_size_mb,
        (k % 4 * 128 + 128)::DOUBLE / 1024 * (ceil(value) / 1000) AS "GB_seconds", k::DOUBLE AS max_memory_used_mb,
        CASE WHEN {BAD} THEN {LONG} END AS error_message FROM ev""",
    # invocations the function log holds: all but those left open
    "log_runs": f"""SELECT *, 'fn-' || (event_id // 3 % 8) AS function_name, 'ls-' || (event_id // 3 % 16) AS log_stream,
        'req-' || (event_id // 3) AS request_id, epoch_us(ts) // 1000 AS started,
        CASE WHEN {BAD} THEN CASE WHEN k % 2 = 0 THEN '[ERROR] boom k=' || k ELSE 'bad k=' || k END
          || CASE WHEN k % 5 = 0 THEN '<br/>[ERROR] again ' || repeat('z', k::INT) ELSE '' END END AS full_text
        FROM ev WHERE NOT ({OPEN})""",
    "environments": """SELECT 'env-' || s_suppkey AS name, lpad(s_suppkey::VARCHAR, 12, '0') AS account_id,
        'region-' || (s_suppkey % 4) AS region FROM supplier""",
    "monitored_raw": """SELECT p_partkey AS p, p_partkey // 5 % 8 AS t, p_partkey * 3 // 80 AS near FROM part""",
    "monitored": f"""SELECT 'group-' || (p // 40) AS group_name, [{', '.join(f"'{t}'" for t in TYPES)}][t + 1] AS resource_type,
        [{', '.join(f"'{s}'" for s in STEMS)}][t + 1] || '-' || CASE p % 5 WHEN 0 THEN near || '' WHEN 1 THEN near || '*'
          WHEN 2 THEN near || '?' WHEN 3 THEN near || '[0-4]' ELSE 'missing' || (p % 3) END AS name,
        'env-' || (p % 3) AS monitored_environment, (p % 3 * 20)::INT AS sla_seconds,
        (p % 4 * 10)::INT AS minimum_number_of_runs, p::BIGINT AS entry_order FROM monitored_raw""",
    "inventory": "SELECT * FROM ("
    + " UNION ".join(
        f"SELECT '{t}' AS resource_type, {ENV} AS monitored_environment, {name(s)} AS name FROM ev"
        for t, s in zip(TYPES, STEMS)
    )
    + ") WHERE name <> 'job-11'",
    "found": """SELECT m.group_name, m.resource_type, m.monitored_environment, i.name, m.sla_seconds,
        m.minimum_number_of_runs, m.entry_order FROM monitored m JOIN inventory i USING (resource_type, monitored_environment)
        WHERE i.name GLOB m.name
        UNION ALL SELECT group_name, resource_type, monitored_environment, name, sla_seconds, minimum_number_of_runs,
        entry_order FROM monitored WHERE resource_type = 'glue_data_quality' AND NOT regexp_matches(name, '[*?\\[]')""",
    "expanded": """SELECT *, true AS resolved FROM found
        QUALIFY row_number() OVER (PARTITION BY group_name, resource_type, monitored_environment, name ORDER BY entry_order DESC) = 1
        UNION ALL SELECT group_name, resource_type, monitored_environment, name, sla_seconds, minimum_number_of_runs,
        entry_order, false FROM monitored m
        WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.group_name = m.group_name AND f.resource_type = m.resource_type)
        QUALIFY row_number() OVER (PARTITION BY group_name, resource_type, monitored_environment, name ORDER BY entry_order DESC) = 1""",
    "config": """SELECT e.*, v.account_id, v.region AS region_name FROM expanded e JOIN environments v
        ON e.monitored_environment = v.name""",
    "subs": """SELECT c_name AS recipient, c_mktsegment AS delivery_method, 'group-' || (o_orderkey // 290) AS monitoring_group,
        bool_or(o_orderstatus = 'F') AS alerts, bool_or(o_orderkey % 100 = 0) AS digest
        FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL""",
    "methods": """SELECT DISTINCT c_mktsegment AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'AWS_SNS' ELSE 'AWS_SES' END
        AS delivery_method_type FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "recipient_groups": """SELECT c_name AS recipient, c_mktsegment AS delivery_method,
        coalesce(list(monitoring_group ORDER BY monitoring_group) FILTER (digest), []) AS monitoring_groups
        FROM customer LEFT JOIN subs ON c_name = recipient GROUP BY ALL""",
    "audiences": """SELECT delivery_method, monitoring_groups, list(recipient ORDER BY recipient) AS recipients
        FROM recipient_groups GROUP BY ALL""",
    "alert_rows": f"""SELECT event_id, ts AS event_time, {ENV} AS monitored_environment, {name('job')} AS resource_name,
        [{', '.join(f"'{t}'" for t in TYPES)}][event_id % 8 + 1] AS resource_type,
        {pick(['FAILED', 'ERROR', 'TIMEOUT', 'STOPPED'], 'RUNNING', 'SUCCEEDED')} AS event_status,
        CASE WHEN {BAD} THEN 'FAILURE' WHEN {OPEN} THEN 'INFO' ELSE 'SUCCESS' END AS event_result,
        'u' || event_id AS execution_info_url, 'e' || event_id AS event FROM ev""",
    # what classification of the JSON events has to give
    "cls_base": f"""SELECT *, event_id % 10 AS s,
        CASE WHEN user_id % 5 = 4 THEN '999999999999' ELSE lpad((user_id % 3)::VARCHAR, 12, '0') END AS account,
        'region-' || (user_id % 3) AS region,
        CASE WHEN {BAD} THEN 'FAILURE' WHEN {OPEN} THEN 'INFO' ELSE 'SUCCESS' END AS plain_result FROM ev""",
    "cls_typed": f"""SELECT *,
        ['glue_jobs', 'glue_workflows', 'glue_crawlers', 'glue_catalogs', 'glue_catalogs', 'glue_data_quality',
         'step_functions', 'lambda_functions', 'emr_serverless'][s + 1] AS resource_type,
        CASE s WHEN 0 THEN {name('job')} WHEN 1 THEN {name('wf')} WHEN 2 THEN {name('crawler')} WHEN 3 THEN {name('db')}
          WHEN 4 THEN {name('db')} WHEN 5 THEN CASE WHEN k % 10 <> 0 THEN {name('rules')} END WHEN 6 THEN {name('sm')}
          WHEN 7 THEN 'fn-' || (user_id % 8) WHEN 8 THEN CASE WHEN k % 10 <> 0 THEN {name('app')} END END AS resource_name,
        CASE s WHEN 0 THEN {pick(['FAILED', 'ERROR', 'TIMEOUT', 'STOPPED'], 'RUNNING', 'SUCCEEDED')}
          WHEN 1 THEN CASE WHEN {BAD} THEN 'FAILED' ELSE 'COMPLETED' END
          WHEN 2 THEN CASE WHEN {BAD} THEN 'Failed' WHEN {OPEN} THEN 'Started' ELSE 'Succeeded' END
          WHEN 3 THEN 'SUCCESS' WHEN 4 THEN CASE WHEN {BAD} THEN 'FAILURE' ELSE 'SUCCESS' END
          WHEN 5 THEN CASE WHEN {BAD} THEN 'FAILED' WHEN {OPEN} THEN 'RUNNING' ELSE 'SUCCEEDED' END
          WHEN 6 THEN CASE WHEN {BAD} THEN 'ABORTED' WHEN {OPEN} THEN 'RUNNING' ELSE 'SUCCEEDED' END
          WHEN 7 THEN CASE WHEN {BAD} THEN 'FAILED' WHEN {OPEN} THEN 'RUNNING' ELSE 'SUCCEEDED' END
          WHEN 8 THEN CASE WHEN {BAD} THEN 'CANCELLED' WHEN {OPEN} THEN 'RUNNING' ELSE 'SUCCESS' END END AS state,
        CASE s WHEN 3 THEN 'SUCCESS' WHEN 4 THEN CASE WHEN {BAD} THEN 'FAILURE' ELSE 'SUCCESS' END ELSE plain_result END AS result
        FROM cls_base WHERE s < 9""",
    "cls": f"""SELECT t.*, v.name AS monitored_environment,
        CASE s WHEN 5 THEN CASE WHEN k % 10 = 0 THEN 'Required GLue DQ Ruleset name is not defined in the DQ event'
                WHEN k % 25 = 1 THEN 'Unknown or missing context type in the DQ event' END
             WHEN 8 THEN CASE WHEN k % 10 = 0 THEN 'EMR Serverless Application ID is not defined in the event'
                WHEN {BAD} AND k % 4 = 0 THEN 'EMR Job Run ID is not defined in the event' END END AS error,
        'https://' || t.region || '.console.aws.amazon.com' || CASE s
          WHEN 0 THEN '/gluestudio/home?region=' || t.region || '#/job/' || resource_name || '/run/jr_' || event_id
          WHEN 1 THEN '/glue/home?region=' || t.region || '#/v2/etl-configuration/workflows/run/' || resource_name || '?runId=wr_' || event_id
          WHEN 2 THEN '/glue/home?region=' || t.region || '#/v2/data-catalog/crawlers/view/' || resource_name
          WHEN 3 THEN '/glue/home?region=' || t.region || '#/v2/data-catalog/databases/view/' || resource_name
          WHEN 4 THEN '/glue/home?region=' || t.region || '#/v2/data-catalog/tables/view/tbl-' || k || '?database=' || resource_name
          WHEN 5 THEN CASE WHEN k % 2 = 0 THEN '/glue/home?region=' || t.region || '#/v2/data-catalog/tables/evaluation-run-details/tbl-'
              || k || '?database=' || {name('db')} || '&catalogId=123&runid=rr_' || event_id
            ELSE '/gluestudio/home?region=' || t.region || '#/editor/job/' || {name('job')} || '/dataquality' END
          WHEN 6 THEN '/states/home?region=' || t.region || '#/v2/executions/details/arn:aws:states:' || t.region || ':' || account
              || ':execution:' || resource_name || ':ex_' || event_id
          WHEN 7 THEN '/cloudwatch/home?region=' || t.region || '#logsV2:log-groups/log-group/$252Faws$252Flambda$252F' || resource_name
              || '/log-events/2024$252F01$252F$255B$2524LATEST$255D' || k
          WHEN 8 THEN '/emr?region=' || t.region || '#/serverless' END AS url
        FROM cls_typed t LEFT JOIN environments v ON t.account = v.account_id AND t.region = v.region""",
    "scope": """SELECT DISTINCT c.resource_type, c.resource_name, m.group_name FROM
        (SELECT DISTINCT resource_type, resource_name FROM cls WHERE error IS NULL) c
        JOIN (SELECT DISTINCT resource_type, group_name, name FROM monitored) m
        ON c.resource_type = m.resource_type AND c.resource_name GLOB m.name""",
    "options": """SELECT s.resource_type, s.resource_name, delivery_method, list(DISTINCT recipient ORDER BY recipient) AS recipients
        FROM scope s JOIN subs ON s.group_name = subs.monitoring_group WHERE alerts
        GROUP BY s.resource_type, s.resource_name, delivery_method""",
    "alerts": """SELECT * FROM cls c WHERE error IS NULL AND result IN ('SUCCESS', 'FAILURE') AND EXISTS
        (SELECT 1 FROM scope s WHERE s.resource_type = c.resource_type AND s.resource_name = c.resource_name)""",
}


def with_views(sql: str) -> str:
    """A statement preceded by the views it uses, and those they use."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in VIEWS:
            if view not in needed and re.search(rf"\b(FROM|JOIN)\s+{view}\b", text):
                visit(VIEWS[view])
                if view not in needed:
                    needed.append(view)

    visit(sql)
    if not needed:
        return sql
    parts = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    lead = "WITH "
    if sql.lstrip().upper().startswith("WITH "):
        return f"{lead}{parts}, {sql.lstrip()[5:]}"
    return f"{lead}{parts} {sql}"
