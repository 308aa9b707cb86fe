"""Queries of collection: sources, normalisation, progress, function logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge import schemas
from fleetgauge.functions import outcome as O
from fleetgauge.functions import timefn
from fleetgauge.operators import logs as L
from fleetgauge.operators import matching as M
from fleetgauge.operators import normalise as N
from fleetgauge.operators import progress as P
from fleetgauge.plans.collect import collect, to_collect
from fleetgauge.session import scratch_path
from fleetgauge.sources import events as EV
from fleetgauge.sources import runs as R
from fleetgauge.sources import tables as TB
from fleetgauge.sources.commits import Pass
from workbench.registry import add, in_emitted_order, joined, ms
from workbench.sql_views import pick
from workbench.views import END, NOW, START, Views

FACT = "SELECT * EXCLUDE (event_id) REPLACE (epoch_ms(time) AS time) FROM m_{}"
S, E_ = "TIMESTAMP '2024-01-08'", "TIMESTAMP '2024-01-22'"

# --- PRJ: facts ---------------------------------------------------------------------------

for _id, _kind in (
    ("prj1", C.GLUE_JOBS), ("prj2", C.GLUE_WORKFLOWS), ("prj3", C.GLUE_CRAWLERS),
    ("prj5", C.GLUE_DATA_QUALITY), ("prj6", C.STEP_FUNCTIONS), ("prj8", C.EMR_SERVERLESS),
):
    add(f"{_id}_{_kind}", lambda v, k=_kind: ms(N.normalise(k, v.flat(k))), FACT.format(_kind))

_CATALOG_SQL = """
    WITH t AS (SELECT 'env-' || (p_partkey % 20 % 3) AS e, 'db-' || (p_partkey % 20) AS d, 't' || p_partkey AS n,
            p_brand AS b FROM part WHERE p_partkey % 9 <> 0),
    per AS (SELECT e, d, count(*)::BIGINT AS tables_count, min_by(b, n) AS catalog_id FROM t GROUP BY ALL),
    p AS (SELECT e, d, count(*)::BIGINT AS c, (count(*) FILTER (l_linenumber = 1))::BIGINT AS i
          FROM lineitem JOIN t ON n = 't' || l_partkey GROUP BY ALL),
    n AS (SELECT 'env-' || (n_nationkey % 3) AS e, 'db-' || n_nationkey AS d FROM nation)
    SELECT e AS monitored_environment, d AS resource_name, coalesce(catalog_id, '123') AS catalog_id,
        coalesce(tables_count, 0) AS tables_count, coalesce(c, 0) AS partitions_count, coalesce(i, 0) AS indexes_count
    FROM n LEFT JOIN per USING (e, d) LEFT JOIN p USING (e, d)"""


def _snapshot(v: Views) -> DataFrame:
    listing = v.listing
    return N.snapshot_catalogs(**listing, at=F.lit(NOW)).drop("time")


add("prj4_glue_catalogs", _snapshot, _CATALOG_SQL)
add(
    "agg13_catalog_counts",
    lambda v: N.catalog_counts(**v.listing).agg(
        *[F.sum(c).alias(c) for c in ("tables_count", "partitions_count", "indexes_count")]
    ),
    f"""SELECT sum(tables_count)::BIGINT AS tables_count, sum(partitions_count)::BIGINT AS partitions_count,
        sum(indexes_count)::BIGINT AS indexes_count FROM ({_CATALOG_SQL})""",
)

_LOG_COLUMNS = ["function_name", "log_stream", "request_id", "started", "completed", "status", "error_count", "error_message"]
_LOG_SQL = """SELECT function_name, log_stream, request_id, started, started + 2 AS completed,
    CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
    CASE WHEN event_type = 'error' THEN 1 + (k % 5 = 0)::INT ELSE 0 END::BIGINT AS error_count,
    CASE WHEN length(full_text) > 100 THEN substr(full_text, 1, 100) || '...' ELSE full_text END AS error_message
    FROM log_runs"""


def _closed(v: Views, **options) -> DataFrame:
    out = L.sessionise(v.function_log, **options)
    return out.select(
        "function_name", "log_stream", "request_id", F.unix_millis("started_on").alias("started"),
        F.unix_millis("completed_on").alias("completed"), "status", "error_count", "error_message",
    )


add("stf1_sessionise", _closed, _LOG_SQL)
add("stf1_sessionise_narrow_slices", lambda v: _closed(v, slice_minutes=1), _LOG_SQL)
add(
    "prj7_lambda_functions",
    lambda v: ms(N.normalise_lambda(L.sessionise(v.function_log))),
    """SELECT 'env-0' AS monitored_environment, function_name AS resource_name, started AS time,
        request_id AS lambda_function_request_id, log_stream, 1::BIGINT AS invocation,
        (event_type <> 'error')::INT::BIGINT AS succeeded, (event_type = 'error')::INT::BIGINT AS failed,
        CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, value AS duration_ms,
        ceil(value)::DOUBLE AS billed_duration_ms, (k % 4 * 128 + 128)::DOUBLE AS memory_size_mb,
        (k % 4 * 128 + 128)::DOUBLE / 1024 * (ceil(value) / 1000) AS "GB_seconds", k::DOUBLE AS max_memory_used_mb,
        CASE WHEN length(full_text) > 100 THEN substr(full_text, 1, 100) || '...' ELSE full_text END AS error_message
        FROM log_runs""",
)
add(
    "flt9_stf2_line_kinds",
    lambda v: L.relevant_lines(v.function_log).groupBy(L.line_kind(F.col("message")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    ),
    """SELECT kind, count(*)::BIGINT AS n FROM (
        SELECT unnest(CASE WHEN event_type = 'view' THEN [1] WHEN event_type = 'error' AND k % 5 = 0 THEN [1, 2, 2, 3, 4]
          WHEN event_type = 'error' THEN [1, 2, 3, 4] ELSE [1, 3, 4] END) AS kind FROM ev) GROUP BY kind""",
)
add(
    "win5_active_request",
    lambda v: L.with_active_request(v.function_log).filter(F.col("kind") == L.ERROR).select(
        "log_stream", F.col("rid").alias("request_id"), F.unix_millis("ts").alias("ts"), "message"
    ),
    """SELECT log_stream, request_id, started + 1 AS ts, CASE WHEN k % 2 = 0 THEN '[ERROR] boom k=' || k
          ELSE '[ERROR]' || chr(9) || '2024Z' || chr(9) || request_id || chr(9) || ' bad k=' || k || ' ' || chr(10) END AS message
        FROM log_runs WHERE event_type = 'error'
       UNION ALL SELECT log_stream, request_id, started + 2, '[ERROR] again ' || repeat('z', k::INT)
        FROM log_runs WHERE event_type = 'error' AND k % 5 = 0""",
)
add(
    "srt2_order_log",
    lambda v: in_emitted_order(
        L.order_log(v.function_log).select(*L.OWNER, F.unix_millis("ts").alias("ts"), L.line_kind(F.col("message")).alias("kind")),
        [], [*L.OWNER, "ts", "kind"],
    ).select("log_stream", "ts", "kind", "in_order"),
    """SELECT log_stream, ts, kind, true AS in_order FROM (SELECT 'ls-' || (event_id // 3 % 16) AS log_stream, unnest(
          CASE WHEN event_type = 'view' THEN [0, 2] WHEN event_type = 'error' AND k % 5 = 0 THEN [0, 1, 2, 2, 2, 3]
          WHEN event_type = 'error' THEN [0, 1, 2, 2, 3] ELSE [0, 2, 2, 3] END) + epoch_us(ts) // 1000 AS ts, unnest(
          CASE WHEN event_type = 'view' THEN [1, NULL] WHEN event_type = 'error' AND k % 5 = 0 THEN [1, 2, 2, NULL, 3, 4]
          WHEN event_type = 'error' THEN [1, 2, NULL, 3, 4] ELSE [1, NULL, 3, 4] END) AS kind FROM ev)""",
)
add(
    "prj16_report_fields",
    lambda v: v.function_log.filter(F.col("message").startswith("REPORT")).select(
        "request_id", F.unix_millis("ts").alias("ts"),
        *[col.alias(n) for n, col in O.parse_report(F.col("message")).items()],
    ),
    """SELECT request_id, started + 3 AS ts, value AS duration_ms, ceil(value)::DOUBLE AS billed_duration_ms,
        (k % 4 * 128 + 128)::DOUBLE AS memory_size_mb, k::DOUBLE AS max_memory_used_mb FROM log_runs""",
)

# --- SRC5-12: landed files read back ------------------------------------------------------

_NEST = {
    C.GLUE_JOBS: ("raw_jobs", "JobRuns", []), C.GLUE_WORKFLOWS: ("raw_workflows", "Runs", []),
    C.GLUE_CRAWLERS: ("raw_crawlers", "Crawls", ["CrawlerName"]),
    C.GLUE_DATA_QUALITY: ("raw_dq", "Results", []), C.STEP_FUNCTIONS: ("raw_sfn", "executions", []),
}


def _land(v: Views, kind: str) -> str:
    """Write a type's raw records the way they arrive, and say where."""
    path = scratch_path(v.spark, f"landed-{kind}")
    if kind == C.EMR_SERVERLESS:
        flat = v.raw_emr
        inner = [c for c in flat.columns if c != "monitored_environment"]
        docs = flat.select("monitored_environment", F.struct(*inner).alias("jobRun"))
    elif kind == "lambda_logs":
        pair = lambda f, c: F.struct(F.lit(f).alias("field"), c.alias("value"))
        docs = v.function_log.select("monitored_environment", "function_name", F.array(
            pair("@timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")), pair("@logStream", F.col("log_stream")),
            pair("@message", F.col("message")), pair("@requestId", F.col("request_id")),
        ).alias("entry"))
    else:
        view, outer, beside = _NEST[kind]
        flat = getattr(v, view)
        keys = ["monitored_environment", *beside]
        inner = [c for c in flat.columns if c not in keys]
        docs = flat.select(*keys, F.array(F.struct(*inner)).alias(outer))
    docs.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return path


def _read_back(v: Views, kind: str) -> DataFrame:
    flat = R.read_runs(v.spark, _land(v, kind), kind)
    if kind == C.STEP_FUNCTIONS:
        flat = M.with_machine_arn(flat, v.machines)
    if kind == C.EMR_SERVERLESS:
        flat = M.with_app_name(flat, v.apps)
    return ms(N.normalise(kind, flat))


for _id, _kind in (
    ("src5", C.GLUE_JOBS), ("src6", C.GLUE_WORKFLOWS), ("src7", C.GLUE_CRAWLERS),
    ("src8", C.GLUE_DATA_QUALITY), ("src10", C.STEP_FUNCTIONS), ("src12", C.EMR_SERVERLESS),
):
    add(f"{_id}_landed_{_kind}", lambda v, k=_kind: _read_back(v, k), FACT.format(_kind))


def _listing_back(v: Views) -> DataFrame:
    base = scratch_path(v.spark, "landed-catalog")
    for level, df in v.listing.items():
        df.write.json(f"{base}/{level}")
    return N.snapshot_catalogs(**R.read_catalog_listing(v.spark, base), at=F.lit(NOW)).drop("time")


add("src9_landed_glue_catalogs", _listing_back, _CATALOG_SQL)
add(
    "src11_landed_lambda_logs",
    lambda v: L.sessionise(R.read_runs(v.spark, _land(v, "lambda_logs"), "lambda_logs")).select(
        "function_name", "log_stream", "request_id", F.unix_millis("started_on").alias("started"),
        F.unix_millis("completed_on").alias("completed"), "status", "error_count", "error_message",
    ),
    _LOG_SQL,
)

# --- PRJ9-24: columns ---------------------------------------------------------------------

# Types whose outcome follows from a state column: it, its failure states, the open and the good one.
_STATES = {
    C.GLUE_JOBS: ("JobRunState", ["FAILED", "ERROR", "TIMEOUT", "STOPPED"], "RUNNING", "SUCCEEDED"),
    C.GLUE_CRAWLERS: ("State", ["FAILED", "STOPPED"], "RUNNING", "COMPLETED"),
    C.STEP_FUNCTIONS: ("status", ["FAILED", "ABORTED", "TIMED_OUT"], "RUNNING", "SUCCEEDED"),
    C.EMR_SERVERLESS: ("state", ["FAILED", "CANCELLED"], "RUNNING", "SUCCESS"),
}


def _outcomes(v: Views) -> DataFrame:
    """Flags of all runs of the types with a state column."""
    raw = {C.GLUE_JOBS: v.raw_jobs, C.GLUE_CRAWLERS: v.raw_crawlers, C.STEP_FUNCTIONS: v.raw_sfn, C.EMR_SERVERLESS: v.raw_emr}
    return P.union_types([
        O.with_outcome(raw[k], k, state).groupBy(F.lit(k).alias("resource_type"), F.col(state).alias("state"), "succeeded", "failed").agg(
            F.count(F.lit(1)).alias("n")) for k, (state, *_) in _STATES.items()])


add(
    "prj9_outcome_flags", _outcomes,
    " UNION ALL ".join(
        f"""SELECT '{k}' AS resource_type, {pick(bad, open_, good)} AS state,
        (event_type NOT IN ('error', 'view'))::INT::BIGINT AS succeeded, (event_type = 'error')::INT::BIGINT AS failed,
        count(*)::BIGINT AS n FROM ev GROUP BY ALL""" for k, (_, bad, open_, good) in _STATES.items()),
)
add(
    "prj10_workflow_outcome",
    lambda v: v.metrics(C.GLUE_WORKFLOWS).groupBy("succeeded", "failed").agg(F.count(F.lit(1)).alias("n")),
    "SELECT succeeded, failed, count(*)::BIGINT AS n FROM m_glue_workflows GROUP BY ALL",
)
add(
    "prj11_dq_outcome",
    lambda v: v.raw_dq.select(
        "ResultId", O.dq_failed(F.col("RuleResults")).alias("is_failure"),
        O.dq_succeeded(F.col("RuleResults")).alias("is_success"),
    ).withColumnRenamed("ResultId", "result_id"),
    "SELECT dq_result_id AS result_id, failed = 1 AS is_failure, succeeded = 1 AS is_success FROM m_glue_data_quality",
)
add(
    "prj12_duration",
    lambda v: v.raw_sfn.select("name", timefn.duration_sec(F.col("startDate"), F.col("stopDate")).alias("seconds")),
    "SELECT 'ex_' || event_id AS name, CAST(round(value * 1000000) AS BIGINT) / 1000000.0 AS seconds FROM ev",
)
add(
    "prj13_job_dpu_seconds",
    lambda v: v.raw_jobs.select("Id", O.job_dpu_seconds(
        F.col("DPUSeconds"), F.col("ExecutionTime"), F.col("MaxCapacity")).alias("dpu_seconds")).withColumnRenamed("Id", "id"),
    """SELECT 'jr_' || event_id AS id, round(CASE WHEN k % 3 = 2 AND value <> 0 THEN value * 3
        ELSE floor(value) * (k % 3 + 2) END, 3) AS dpu_seconds FROM ev""",
)
add(
    "prj14_crawl_dpu_seconds",
    lambda v: v.raw_crawlers.select(F.col("CrawlId").alias("id"), O.crawl_dpu_seconds(F.col("DPUHour")).alias("dpu_seconds")),
    "SELECT 'cr_' || event_id AS id, CASE WHEN k % 10 <> 9 THEN round(k / 1000.0 * 3600, 3) END AS dpu_seconds FROM ev",
)
add(
    "prj15_gb_seconds",
    lambda v: v.m_lambda.select(
        F.unix_millis("time").alias("time"),
        F.round(O.gb_seconds(F.col("memory_size_mb"), F.col("billed_duration_ms")), 6).alias("gb_seconds")),
    """SELECT epoch_ms(time) AS time, round(memory_size_mb / 1024 * (billed_duration_ms / 1000), 6) AS gb_seconds
        FROM m_lambda_functions""",
)
add(
    "prj17_crawl_summary",
    lambda v: v.raw_crawlers.select(
        F.col("CrawlId").alias("id"), O.parse_crawl_summary(F.col("Summary")).alias("s")).select("id", "s.*"),
    """SELECT 'cr_' || event_id AS id, CASE WHEN k % 4 = 2 THEN k ELSE 0 END AS tables_added,
        CASE WHEN k % 4 = 3 THEN k ELSE 0 END AS tables_updated, CASE WHEN k % 4 = 2 THEN 2 ELSE 0 END AS tables_deleted,
        CASE WHEN k % 4 = 3 THEN 5 ELSE 0 END AS partitions_added, 0 AS partitions_updated, 0 AS partitions_deleted
        FROM ev""",
)
add(
    "prj18_prj19_prj20_dq_columns",
    lambda v: v.raw_dq.select(
        F.col("ResultId").alias("id"), O.context_type(F.col("DataSource.GlueTable")).alias("context_type"),
        O.rule_count(F.col("RuleResults"), C.RULE_SUCCESS).alias("passed"),
        O.rule_count(F.col("RuleResults"), C.RULE_FAILURE).alias("broken"),
        O.rule_count(F.col("RuleResults")).alias("total"), O.dq_error(F.col("RuleResults")).alias("error_text"),
    ),
    """SELECT dq_result_id AS id, context_type, rules_succeeded AS passed, rules_failed AS broken, total_rules AS total,
        error_message AS error_text FROM m_glue_data_quality""",
)
add(
    "prj21_lambda_error",
    lambda v: L.sessionise(v.function_log).filter("error_count > 0").select("request_id", "attempt", "error_message").groupBy(
        "request_id").agg(F.max("error_message").alias("error_message"), F.count(F.lit(1)).alias("n")),
    """SELECT request_id, max(CASE WHEN length(full_text) > 100 THEN substr(full_text, 1, 100) || '...' ELSE full_text END)
        AS error_message, count(*)::BIGINT AS n FROM log_runs WHERE event_type = 'error' GROUP BY request_id""",
)
add(
    "prj22_emr_error",
    lambda v: v.raw_emr.select(F.col("jobRunId").alias("id"), O.emr_error(F.col("stateDetails")).alias("error_text")),
    """SELECT 'er_' || event_id AS id, CASE WHEN event_type = 'error' THEN CASE WHEN 2 * k * 1 > 100
          THEN substr(repeat('ab', (2 * k)::INT), 1, 200) || '...' ELSE repeat('ab', (2 * k)::INT) END END AS error_text FROM ev""",
)
add(
    "prj23_step_error",
    lambda v: v.raw_sfn.select(F.col("name").alias("id"), O.sfn_error(F.col("error"), F.col("cause")).alias("error_text")),
    """SELECT 'ex_' || event_id AS id, CASE WHEN k % 2 = 0 THEN 'Err' ELSE '' END || ' {"k":' || k || '}' AS error_text FROM ev""",
)
add(
    "prj24_workflow_error",
    lambda v: v.raw_workflows.select(F.col("WorkflowRunId").alias("id"), O.workflow_error(F.col("Graph.Nodes")).alias("error_text")),
    """SELECT 'wr_' || event_id AS id, CASE WHEN k % 3 = 1 THEN 'JOB Error: ' || CASE WHEN k > 50 THEN
        repeat('e', 50) || '...' ELSE repeat('e', k::INT) END
        WHEN k % 3 = 2 THEN 'Total Errors: 2. JOB Error: x; CRAWLER Error: c=' || k END AS error_text FROM ev""",
)

# --- FLT, JN, AGG, SNK of collection -------------------------------------------------------

def _final(v: Views) -> DataFrame:
    """Runs that are kept, of every type, by state."""
    raw = {
        C.GLUE_JOBS: (v.raw_jobs, "JobRunState"), C.GLUE_WORKFLOWS: (v.raw_workflows, "Status"), C.GLUE_CRAWLERS: (v.raw_crawlers, "State"),
        C.GLUE_DATA_QUALITY: (v.raw_dq.withColumn("state", F.lit("any")), "state"), C.GLUE_CATALOGS: (v.m_catalogs.withColumn("state", F.lit("any")), "state"),
        C.LAMBDA_FUNCTIONS: (L.sessionise(v.function_log), "status"), C.STEP_FUNCTIONS: (v.raw_sfn, "status"), C.EMR_SERVERLESS: (v.raw_emr, "state"),
    }
    return P.union_types([
        N.only_final(df, k).groupBy(F.lit(k).alias("resource_type"), F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"))
        for k, (df, state) in raw.items()])


_FINAL = {
    **{k: (pick(bad, open_, good), "event_type <> 'view'") for k, (_, bad, open_, good) in _STATES.items()},
    C.GLUE_WORKFLOWS: (pick(["STOPPED", "ERROR", "FAILURE"], "RUNNING", "COMPLETED"), "event_type <> 'view'"),
    C.GLUE_DATA_QUALITY: ("'any'", "true"), C.GLUE_CATALOGS: ("'any'", "true"),
    C.LAMBDA_FUNCTIONS: ("CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END", "event_type <> 'view'"),
}
_FINAL[C.EMR_SERVERLESS] = (_FINAL[C.EMR_SERVERLESS][0], "event_type <> 'view' AND k % 10 <> 0")
add(
    "flt3_flt4_final_runs", _final,
    " UNION ALL ".join(f"SELECT '{k}' AS resource_type, {state} AS state, count(*)::BIGINT AS n FROM ev WHERE {kept} GROUP BY ALL"
                       for k, (state, kept) in _FINAL.items()),
)


def _resources(v: Views) -> DataFrame:
    return v.inventory.select("resource_type", F.col("name").alias("resource_name")).distinct()


_LAST = " UNION ALL ".join(
    f"SELECT '{k}' AS resource_type, resource_name, max(time) AS last_update_time FROM m_{k} GROUP BY resource_name"
    for k in C.RESOURCE_TYPES
)
_MIDDLE = "TIMESTAMP '2024-01-21 12:00:00'"


def _before(v: Views) -> dict[str, DataFrame]:
    """Metrics stored up to the middle of the last day."""
    return {k: df.filter(F.col("time") < F.lit(NOW.replace(day=21))) for k, df in v.all_metrics().items()}


add("agg9_set1_last_update_times", lambda v: ms(P.last_update_times(v.all_metrics())),
    f"SELECT resource_type, resource_name, epoch_ms(last_update_time) AS last_update_time FROM ({_LAST})")
add("agg10_last_update_time", lambda v: ms(P.last_update_time(v.metrics(C.GLUE_JOBS), "job-3")),
    "SELECT epoch_ms(max(time)) AS last_update_time FROM m_glue_jobs WHERE resource_name = 'job-3'")
_BEFORE = " UNION ALL ".join(
    f"SELECT '{k}' AS resource_type, resource_name, max(time) AS t FROM m_{k} WHERE time < {_MIDDLE} GROUP BY resource_name"
    for k in C.RESOURCE_TYPES
)
_SINCE = f"""SELECT DISTINCT i.resource_type, i.name AS resource_name,
    greatest(coalesce(b.t, {_MIDDLE}), {_MIDDLE}) AS since_time FROM inventory i
    LEFT JOIN ({_BEFORE}) b ON i.resource_type = b.resource_type AND i.name = b.resource_name"""
add("jn11_stf3_since_times", lambda v: ms(P.since_times(_resources(v), P.last_update_times(_before(v)), NOW)),
    f"SELECT resource_type, resource_name, epoch_ms(since_time) AS since_time FROM ({_SINCE})")
add(
    "jn11_since_times_stored",
    lambda v: ms(P.since_times(
        _resources(v), P.last_update_times({C.GLUE_JOBS: v.metrics(C.GLUE_JOBS)}), NOW,
        stored=P.last_update_times(v.all_metrics()))),
    f"""SELECT DISTINCT i.resource_type, i.name AS resource_name, epoch_ms(greatest(coalesce(l.last_update_time,
        {_MIDDLE}), {_MIDDLE})) AS since_time FROM inventory i
        LEFT JOIN ({_LAST}) l ON i.resource_type = l.resource_type AND i.name = l.resource_name""",
)


def _fresh(v: Views, strict: bool) -> DataFrame:
    since = P.since_times(_resources(v), P.last_update_times(v.all_metrics()), NOW)
    if strict:
        since = since.withColumn("since_time", F.greatest(F.lit(START), F.col("since_time") - F.expr("INTERVAL 10 DAYS")))
    return to_collect(v.raw_jobs, C.GLUE_JOBS, since, NOW, strict=strict).select(
        F.col("Id").alias("id"), F.col("JobName").alias("name"))


add(
    "flt1_started_after",
    lambda v: _fresh(v, True),
    f"""SELECT 'jr_' || event_id AS id, 'job-' || (user_id // 2) AS name FROM ev JOIN (SELECT DISTINCT i.name,
        greatest({S}, greatest(coalesce(l.last_update_time, {_MIDDLE}), {_MIDDLE}) - INTERVAL 10 DAYS) AS since_time
        FROM inventory i LEFT JOIN ({_LAST}) l ON i.resource_type = l.resource_type AND i.name = l.resource_name
        WHERE i.resource_type = 'glue_jobs') s ON s.name = 'job-' || (user_id // 2) WHERE ts > s.since_time""",
)
add(
    "flt1_look_back",
    lambda v: _fresh(v, False),
    f"""SELECT 'jr_' || event_id AS id, 'job-' || (user_id // 2) AS name FROM ev
        WHERE user_id // 2 <> 11 AND ts > {_MIDDLE}""",
)
add(
    "flt2_log_started_after",
    lambda v: P.log_started_after(v.function_log, v.m_lambda.groupBy("resource_name").agg(
        F.min("time").alias("since_time"))).groupBy("function_name").agg(F.count(F.lit(1)).alias("n")),
    """WITH m AS (SELECT resource_name, min(time) AS t FROM m_lambda_functions GROUP BY 1),
       l AS (SELECT 'fn-' || (event_id // 3 % 8) AS fn, epoch_us(ts) // 1000 + unnest(CASE WHEN event_type = 'view' THEN [0, 2]
          WHEN event_type = 'error' AND k % 5 = 0 THEN [0, 1, 2, 2, 2, 3] WHEN event_type = 'error' THEN [0, 1, 2, 2, 3]
          ELSE [0, 2, 2, 3] END) AS ts FROM ev)
       SELECT fn AS function_name, count(*)::BIGINT AS n FROM l JOIN m ON fn = resource_name
       WHERE ts >= epoch_ms(t) + 1 GROUP BY fn""",
)
add(
    "agg11_earliest_since",
    lambda v: ms(P.earliest_since(
        _resources(v).filter(F.col("resource_type") == C.GLUE_DATA_QUALITY),
        P.last_update_times({C.GLUE_DATA_QUALITY: v.metrics(C.GLUE_DATA_QUALITY)}), START)),
    """SELECT epoch_ms(min(t)) AS since_time FROM (SELECT resource_name, max(time) AS t FROM m_glue_data_quality GROUP BY 1)""",
)
add(
    "agg11_earliest_since_incomplete",
    lambda v: ms(P.earliest_since(
        v.monitored.select(F.col("name").alias("resource_name")),
        P.last_update_times(v.all_metrics()), START)),
    f"SELECT CASE WHEN (SELECT count(*) FROM monitored) > 0 THEN epoch_ms({S}) END AS since_time",
)
add(
    "jn12_dq_results_for",
    lambda v: P.dq_results_for(v.raw_dq, v.raw_dq.filter(F.col("StartedOn") > F.lit(START)), "rules-2").select(
        F.col("ResultId").alias("id")),
    f"SELECT 'dq_' || event_id AS id FROM ev WHERE user_id // 2 = 2 AND ts > {S}",
)
add(
    "jn13_app_name", lambda v: M.with_app_name(v.raw_emr, v.apps).groupBy("applicationId", "resource_name").agg(
        F.count(F.lit(1)).alias("n")).withColumnRenamed("applicationId", "app_id"),
    "SELECT 'app' || (user_id // 2) AS app_id, 'app-' || (user_id // 2) AS resource_name, count(*)::BIGINT AS n FROM ev GROUP BY ALL",
)
add(
    "jn14_machine_arn", lambda v: M.with_machine_arn(v.raw_sfn, v.machines).groupBy("resource_name").agg(
        F.count(F.lit(1)).alias("n")),
    "SELECT 'sm-' || (user_id // 2) AS resource_name, count(*)::BIGINT AS n FROM ev GROUP BY ALL",
)


def _stored_twice(v: Views, kinds: list[str]) -> str:
    """Write overlapping batches of some tables, one pass for each batch; where they are."""
    base = scratch_path(v.spark, "metrics")
    for kept in (F.col("time") < F.lit(END), F.col("time") > F.lit(START)):
        step = Pass(v.spark, base)
        for kind in kinds:
            TB.stage_metrics(v.metrics(kind).filter(kept), step, kind)
        TB.commit_metrics(step)
    return base


def _stored_jobs(v: Views) -> DataFrame:
    return ms(TB.metrics(v.spark, _stored_twice(v, [C.GLUE_JOBS]), C.GLUE_JOBS).drop("date"))


add("snk1_src14_metrics_table", _stored_jobs, FACT.format("glue_jobs"))


def _column_sums(v: Views) -> DataFrame:
    """Every column of every stored table added up by resource: texts by length, numbers in thousandths."""
    def sums(kind: str, df: DataFrame) -> DataFrame:
        of = {"string": F.length, "timestamp": F.unix_millis}
        named = [f for f in df.schema if f.name != "resource_name"]
        total = lambda f: F.sum(of.get(f.dataType.simpleString(), lambda x: F.floor(F.col(x) * 1000 + 0.3))(f.name)).cast("bigint")
        pairs = F.array(*[F.struct(F.lit(f.name).alias("column_name"), total(f).alias("total")) for f in named])
        return df.groupBy("resource_name").agg(F.count(F.lit(1)).alias("n"), pairs.alias("p")).select(
            F.lit(kind).alias("resource_type"), "resource_name", "n", F.inline("p"))

    base = _stored_twice(v, C.RESOURCE_TYPES)
    return P.union_types([sums(k, TB.metrics(v.spark, base, k).drop("date")) for k in C.RESOURCE_TYPES])


FLOORED = 'floor("{0}" * 1000 + 0.3::DOUBLE)'


def _column_sums_sql(kind: str) -> str:
    of = {"string": 'length("{0}")', "timestamp": 'epoch_ms("{0}")'}
    named = {n: t for n, t in schemas.metrics_columns(kind).items() if n != "resource_name"}
    one = lambda n: f"sum({of.get(named[n], FLOORED).format(n)})::BIGINT"
    return f"""SELECT '{kind}' AS resource_type, resource_name, count(*)::BIGINT AS n,
        unnest([{', '.join(f"'{n}'" for n in named)}]) AS column_name, unnest([{', '.join(map(one, named))}]) AS total
        FROM m_{kind} GROUP BY resource_name"""


add("snk1_all_metrics_tables", _column_sums, " UNION ALL ".join(map(_column_sums_sql, C.RESOURCE_TYPES)))
add("snk5_prune", lambda v: TB.prune(v.metrics(C.GLUE_JOBS), NOW, days=7).agg(F.count(F.lit(1)).alias("n")),
    "SELECT count(*)::BIGINT AS n FROM m_glue_jobs WHERE time >= TIMESTAMP '2024-01-15 12:00:00'")
add("snk5_stf4_accept_writes", lambda v: TB.accept_writes(v.metrics(C.GLUE_JOBS), NOW).agg(F.count(F.lit(1)).alias("n")),
    f"SELECT count(*)::BIGINT AS n FROM m_glue_jobs WHERE time >= {_MIDDLE}")
add(
    "src15_empty_tables",
    lambda v: v.metrics(C.GLUE_JOBS).groupBy("resource_name").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "all_empty": F.lit(TB.is_empty(v.metrics(C.GLUE_JOBS))),
        "none_empty": F.lit(TB.is_empty(v.metrics(C.GLUE_JOBS).filter(F.col("time") < F.lit(START.replace(year=2000)))))}),
    "SELECT resource_name, count(*)::BIGINT AS n, false AS all_empty, true AS none_empty FROM m_glue_jobs GROUP BY 1",
)
add(
    "src16_scalar",
    lambda v: v.metrics(C.GLUE_JOBS).agg(F.count(F.lit(1)).alias("n")).withColumns({
        "longest": F.lit(TB.scalar(v.metrics(C.GLUE_JOBS).agg(F.max("execution_time_sec")))),
        "missing": F.lit(TB.scalar(v.metrics(C.GLUE_JOBS).filter("failed > 5").select("error_message"))).cast("string")}),
    "SELECT count(*)::BIGINT AS n, max(execution_time_sec) AS longest, NULL::VARCHAR AS missing FROM m_glue_jobs",
)
add(
    "dt1_dt3_times",
    lambda v: v.ev.select("event_id", timefn.epoch_ms(F.col("ts")).alias("ms"), F.unix_micros(timefn.store_time(
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("000")))).alias("micros"),
        F.unix_millis(timefn.store_time(F.date_format("ts", "yyyy-MM-dd HH:mm:ss."))).alias("whole")),
    """SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS micros, epoch_ms(date_trunc('second', ts)) AS whole FROM ev""",
)
add(
    "dt2_event_time",
    lambda v: v.ev.select("event_id", F.unix_millis(timefn.event_time(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("with_z"), F.unix_millis(timefn.event_time(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))).alias("without_z")),
    "SELECT event_id, epoch_ms(date_trunc('second', ts)) AS with_z, epoch_ms(date_trunc('second', ts)) AS without_z FROM ev",
)
add(
    "dt4_iso_from_ms",
    lambda v: v.ev.select("event_id", timefn.iso_from_ms(F.unix_millis("ts")).alias("iso"), timefn.iso_from_ms(
        F.when(F.col("k") > 50, F.unix_seconds("ts") * 1000)).alias("whole")),
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN (epoch_us(ts) // 1000) % 1000 = 0 THEN '' ELSE
        '.' || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || '000' END || '+00:00' AS iso, CASE WHEN k > 50 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
        || '+00:00' END AS whole FROM ev""",
)
add(
    "dt5_flt5_digest_window",
    lambda v: TB.in_period(v.metrics(C.STEP_FUNCTIONS), *timefn.digest_window(END, 14 * 24)).agg(
        F.count(F.lit(1)).alias("n")),
    f"SELECT count(*)::BIGINT AS n FROM m_step_functions WHERE time BETWEEN {S} AND {E_}",
)


# --- the whole job ------------------------------------------------------------------------


def _collected(v: Views) -> DataFrame:
    """Collect every type twice over the same records: what is stored and published, per resource.

    The writable time reaches back over the whole inputs, and the second pass finds nothing new.
    """
    base = scratch_path(v.spark, "collect")
    raw = {k: v.flat(k) for k in C.RESOURCE_TYPES if k not in (C.GLUE_CATALOGS, C.LAMBDA_FUNCTIONS)}
    raw |= {C.LAMBDA_FUNCTIONS: v.function_log, C.GLUE_CATALOGS: tuple(v.listing.values())}
    now = v.ev.agg(F.min("ts")).first()[0].replace(hour=0, minute=0, second=0, microsecond=0)
    functions = v.function_log.select(F.lit(C.LAMBDA_FUNCTIONS).alias("resource_type"), F.col("function_name").alias("name"))
    databases = v.listing["databases"].select(F.lit(C.GLUE_CATALOGS).alias("resource_type"), F.col("DatabaseName").alias("name"))
    others = v.inventory.filter(~F.col("resource_type").isin(C.LAMBDA_FUNCTIONS, C.GLUE_CATALOGS)).select("resource_type", "name")
    config = P.union_types([others, functions, databases]).distinct()
    for _ in range(2):
        collect(v.spark, raw, f"{base}/metrics", config, v.environments, f"{base}/events", now)
    stored = P.union_types([
        TB.metrics(v.spark, f"{base}/metrics", k).select(F.lit(k).alias("part"), "resource_name") for k in C.RESOURCE_TYPES])
    events = EV.read_events(v.spark, f"{base}/events", streaming=False).select(
        F.col("source").alias("part"), F.coalesce("detail.workflowName", "detail.lambdaName").alias("resource_name"))
    return stored.unionByName(events).groupBy("part", "resource_name").agg(F.count(F.lit(1)).alias("n"))


_KNOWN = "SELECT DISTINCT name FROM inventory WHERE resource_type"
add(
    "j1_j2_collect", _collected,
    f"""SELECT part, resource_name, count(*)::BIGINT AS n FROM (
        {' UNION ALL '.join(
            f"SELECT '{k}' AS part, resource_name FROM m_{k} WHERE resource_name IN ({_KNOWN} = '{k}')"
            for k in C.RESOURCE_TYPES if k not in (C.GLUE_CATALOGS, C.LAMBDA_FUNCTIONS))}
        UNION ALL SELECT 'lambda_functions', function_name FROM log_runs
        UNION ALL SELECT 'glue_catalogs', resource_name FROM ({_CATALOG_SQL})
        UNION ALL SELECT 'fleetgauge.glue_workflow', resource_name FROM m_glue_workflows
          WHERE resource_name IN ({_KNOWN} = 'glue_workflows')
        UNION ALL SELECT 'fleetgauge.lambda', function_name FROM log_runs) GROUP BY ALL""",
)
