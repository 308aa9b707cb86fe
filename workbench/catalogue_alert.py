"""Queries of alerting: classification, scope, alert log, notifications, streams."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge import schemas
from fleetgauge.functions import text as X
from fleetgauge.functions.outcome import emr_error
from fleetgauge.operators import classify as K
from fleetgauge.operators import digest_runs as D
from fleetgauge.operators import logs as L
from fleetgauge.operators import matching as M
from fleetgauge.operators import normalise as N
from fleetgauge.operators.normalise import only_final
from fleetgauge.operators.progress import union_types
from fleetgauge.plans import alerting as A
from fleetgauge.session import scratch_path, settle
from fleetgauge.sources import events as EV
from fleetgauge.sources import sinks
from fleetgauge.sources.tables import in_period
from fleetgauge.streaming import alerts as SA
from fleetgauge.streaming import logs as SL
from workbench.registry import add, in_emitted_order, joined, ms
from workbench.views import END, START, Views


def _id() -> Column:
    """The event's number, from its envelope."""
    return F.get_json_object("event", "$.id").substr(3, 20).cast("bigint").alias("event_id")


def _classified(v: Views) -> DataFrame:
    return A.classified(v.events(), v.alert_config)


def _of(v: Views, kind: str) -> DataFrame:
    return K.mapped(_classified(v)).filter(F.col("resource_type") == kind).select(
        _id(), "resource_name", "state", "result", "execution_info_url", "monitored_environment")


for _n, _kind in enumerate(
    [C.GLUE_JOBS, C.GLUE_WORKFLOWS, C.GLUE_CRAWLERS, C.GLUE_CATALOGS, C.GLUE_DATA_QUALITY, C.STEP_FUNCTIONS,
     C.LAMBDA_FUNCTIONS, C.EMR_SERVERLESS], 1,
):
    add(f"evt{_n}_{_kind}", lambda v, k=_kind: _of(v, k),
        f"""SELECT event_id, resource_name, state, result, url AS execution_info_url, monitored_environment FROM cls
            WHERE resource_type = '{_kind}' AND error IS NULL""")

add(
    "evt9_event_errors",
    lambda v: K.event_errors(_classified(v)).select(_id(), "resource_type", F.split("error", ": ")[0].alias("reason")),
    "SELECT event_id, resource_type, error AS reason FROM cls WHERE error IS NOT NULL",
)
add(
    "js1_parse_envelope",
    lambda v: EV.parse_envelope(v.event_json.select(F.when(F.col("event_id") % 17 == 0, F.lit("{broken")).otherwise(
        F.col("value")).alias("value"))).groupBy("is_readable", "source", "detail_type").agg(F.count(F.lit(1)).alias("n")),
    """WITH s AS (SELECT event_id, event_id % 10 AS s FROM events)
       SELECT event_id % 17 <> 0 AS is_readable, CASE WHEN event_id % 17 <> 0 THEN ['aws.glue', 'fleetgauge.glue_workflow',
          'aws.glue', 'aws.glue', 'aws.glue', 'aws.glue-dataquality', 'aws.states', 'fleetgauge.lambda',
          'aws.emr-serverless', 'aws.glue'][s + 1] END AS source,
         CASE WHEN event_id % 17 <> 0 THEN ['Glue Job State Change', 'Glue Workflow State Change', 'Glue Crawler State Change',
          'Glue Data Catalog Database State Change', 'Glue Data Catalog Table State Change',
          'Data Quality Evaluation Results Available', 'Step Functions Execution Status Change',
          'Lambda Function Execution State Change', 'EMR Serverless Job Run State Change', 'Something Else'][s + 1] END
          AS detail_type, count(*)::BIGINT AS n FROM s GROUP BY 1, 2, 3""",
)
add(
    "jn3_flt8_resolve_type",
    lambda v: K.resolve_type(v.events(), EV.event_types(v.spark)).groupBy("resource_type").agg(F.count(F.lit(1)).alias("n")),
    "SELECT resource_type, count(*)::BIGINT AS n FROM cls_typed GROUP BY 1",
)
add(
    "flt7_with_flags",
    lambda v: K.with_flags(K.mapped(_classified(v))).groupBy("resource_type", "result", "is_alertable", "is_monitorable").agg(
        F.count(F.lit(1)).alias("n")),
    """SELECT resource_type, result, result = 'FAILURE' AS is_alertable, result IN ('SUCCESS', 'FAILURE') AS is_monitorable,
        count(*)::BIGINT AS n FROM cls WHERE error IS NULL GROUP BY ALL""",
)
add(
    "str4_subject",
    lambda v: K.mapped(_classified(v)).select(_id(), X.subject(
        F.col("monitored_environment"), F.col("state"), F.col("resource_type"), F.col("resource_name")).alias("subject")),
    """SELECT event_id, coalesce(monitored_environment, 'None') || ': ' || state || ' - ' || resource_type || ' : '
        || resource_name AS subject FROM cls WHERE error IS NULL""",
)
_TYPE_OF = ["Glue Job State Change", "Glue Workflow State Change", "Glue Crawler State Change",
            "Glue Data Catalog Database State Change", "Glue Data Catalog Table State Change",
            "Data Quality Evaluation Results Available", "Step Functions Execution Status Change",
            "Lambda Function Execution State Change", "EMR Serverless Job Run State Change"]
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN (epoch_us(ts) // 1000) % 1000 = 0 THEN '' ELSE '.' || " \
       "lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || '000' END || '+00:00'"
_ERR = "CASE WHEN result = 'FAILURE' THEN ' !' ELSE '' END"
_A = "'<a href=''' || url || '''>' || "
_BODY = f"""'AWS Account=' || account || chr(10) || 'AWS Region=' || c.region || chr(10) || 'Time='
    || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'Event Type=' || [{', '.join(f"'{t}'" for t in _TYPE_OF)}][s + 1] || chr(10) ||
  CASE resource_type
  WHEN 'glue_jobs' THEN 'Job Name=' || resource_name || chr(10) || 'State=' || state || {_ERR} || chr(10) || 'Glue Job Run ID=' || {_A}
     'jr_' || event_id || '</a>' || chr(10) || 'Message=m' || k
  WHEN 'glue_workflows' THEN 'Workflow Name=' || resource_name || chr(10) || 'Workflow Run ID=' || {_A} 'wr_' || event_id || '</a>'
  WHEN 'glue_crawlers' THEN 'Crawler Name=' || resource_name || chr(10) || 'State=' || state || {_ERR} || chr(10) || 'Execution Info='
     || {_A} 'Link to AWS Console</a>' || chr(10) || 'Message=' || CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'e' || k
     WHEN k % 3 = 0 THEN 'm' || k ELSE 'Missing execution details message' END
  WHEN 'glue_catalogs' THEN 'Database Name=' || resource_name || chr(10) || 'Type of Change='
     || CASE s WHEN 3 THEN 'CreateDatabase' ELSE 'UpdateTable' END || chr(10) || 'Execution Info=' || {_A} 'Link to AWS Console</a>'
  WHEN 'glue_data_quality' THEN 'Glue DQ Ruleset Name=' || resource_name || chr(10) || 'State=' || state || {_ERR} || chr(10)
     || CASE WHEN k % 2 = 0 THEN 'Glue Table Name=tbl-' || k || chr(10) || 'Glue Database Name=db-' || (user_id // 2)
        ELSE 'Glue Job Name=job-' || (user_id // 2) END || chr(10) || 'Glue DQ Run ID=' || {_A}
        CASE WHEN k % 2 = 0 THEN 'rr_' ELSE 'jr_' END || event_id || '</a>'
  WHEN 'lambda_functions' THEN 'Function Name=' || resource_name || chr(10) || 'State=' || state || {_ERR} || chr(10) || 'Log Events='
     || {_A} 'Link to AWS CloudWatch Log Group</a>' || chr(10) || 'Log Stream=2024/01/[$LATEST]' || k || chr(10)
     || 'Request ID=req-' || event_id || chr(10) || 'Message=f' || k
  WHEN 'step_functions' THEN 'State Machine Name=' || resource_name || chr(10) || 'Status=' || state || {_ERR} || chr(10) || 'Start Date='
     || {_ISO.format('ts')} || chr(10) || 'Stop Date=' || CASE WHEN event_type = 'view' THEN '' ELSE {_ISO.format("ts + INTERVAL 1 SECOND")} END
     || chr(10) || 'Execution Info=' || {_A} 'ex_' || event_id || '</a>'
  WHEN 'emr_serverless' THEN 'EMR Serverless Application Name=' || resource_name || chr(10) || CASE WHEN k % 4 <> 0
     THEN 'EMR Serverless Job Name=n' || k || chr(10) ELSE '' END || 'State=' || state || {_ERR} || chr(10) || 'Job Run ID='
     || CASE WHEN k % 4 <> 0 THEN 'er_' || event_id ELSE '' END || chr(10) || CASE WHEN k % 4 <> 0 THEN 'Script Location=s3://x/y.py'
     || chr(10) ELSE '' END || 'Console URL=' || {_A} 'Link to Amazon EMR Console</a>' || CASE WHEN k % 4 <> 0 AND k > 0
     AND event_type = 'error' THEN chr(10) || 'Message=' || repeat('ab', least(2 * k, 100)::INT) || CASE WHEN k > 50 THEN '...' ELSE '' END ELSE '' END
  END"""


def _body_text(col) -> Column:
    row = lambda r: F.concat(r["values"][0], F.lit("="), F.coalesce(r["values"][1], F.lit("")),
                             F.when(r["style"] == "error", " !").otherwise(""))
    return F.array_join(F.transform(col, row), "\n")


def _emr_runs(v: Views) -> DataFrame:
    return v.raw_emr.select(
        "jobRunId", "name", F.col("jobDriver.sparkSubmit.entryPoint").alias("entry_point"),
        emr_error(F.col("stateDetails")).alias("message"),
    )


def _full_config(v: Views) -> A.AlertConfig:
    config = v.alert_config
    return A.AlertConfig(config.environments, config.monitored, config.recipients, config.delivery_methods,
                         apps=config.apps, emr_runs=_emr_runs(v))


def _with_body(v: Views) -> DataFrame:
    return K.with_message(K.mapped(A.classified(v.events(), _full_config(v))))


add(
    "evt10_evt11_event_body",
    lambda v: _with_body(v).select(_id(), _body_text("message_body").alias("body")),
    f"SELECT event_id, {_BODY} AS body FROM cls c WHERE error IS NULL",
)
add(
    "srt5_event_table",
    lambda v: v.events().filter(F.col("source") == "aws.glue").select(_id(), K.event_table().alias("table_name")).filter(
        F.col("table_name").isNotNull()),
    "SELECT event_id, 'tbl-' || k AS table_name FROM ev WHERE event_id % 10 = 4",
)

# --- the alert job, as a batch ------------------------------------------------------------


def _matches(v: Views) -> DataFrame:
    return settle(A.matches_for(_classified(v), v.alert_config), "matches")


def _alerts(v: Views, matches: DataFrame) -> DataFrame:
    return A.alert_events(_classified(v), matches)


add(
    "flt6_in_scope",
    lambda v: M.in_scope(K.mapped(_classified(v)), _matches(v)).select(_id()),
    """SELECT event_id FROM cls c WHERE error IS NULL AND EXISTS (SELECT 1 FROM scope s
        WHERE s.resource_type = c.resource_type AND s.resource_name = c.resource_name)""",
)
add(
    "flt6_in_scope_by_environment",
    lambda v: M.in_scope(
        K.mapped(_classified(v)),
        settle(A.matches_for(_classified(v), dataclasses.replace(v.alert_config, match_env=True)), "matches")).select(_id()),
    """SELECT event_id FROM cls c WHERE error IS NULL AND EXISTS (SELECT 1 FROM monitored m
        WHERE m.resource_type = c.resource_type AND m.monitored_environment = c.monitored_environment
          AND c.resource_name GLOB m.name)""",
)
_LOG_SQL = """SELECT event_id, epoch_ms(date_trunc('second', ts)) AS event_time, monitored_environment, resource_name, resource_type,
    state AS event_status, result AS event_result, url AS execution_info_url FROM alerts"""
add("snk2_alert_log", lambda v: ms(A.alert_log(_alerts(v, _matches(v)))).select(_id(), "*").drop("event"), _LOG_SQL)
_NOTE_SQL = """SELECT a.resource_name AS message_group_id, epoch_ms(date_trunc('second', ts)) AS event_time, a.resource_type,
    a.resource_name, o.delivery_method, m.delivery_method_type, part, recipients,
    coalesce(a.monitored_environment, 'None') || ': ' || state || ' - ' || a.resource_type || ' : ' || a.resource_name
    AS message_subject, count(*)::BIGINT AS n FROM alerts a JOIN (
      SELECT resource_type, resource_name, delivery_method, part, string_agg(recipient, ',' ORDER BY recipient) AS recipients FROM (
        SELECT *, (row_number() OVER (PARTITION BY resource_type, resource_name, delivery_method ORDER BY recipient) - 1) // 50 AS part FROM (
          SELECT DISTINCT s.resource_type, s.resource_name, delivery_method, recipient FROM scope s
            JOIN subs ON s.group_name = subs.monitoring_group WHERE subs.alerts)) GROUP BY ALL) o
    ON a.resource_type = o.resource_type AND a.resource_name = o.resource_name
    LEFT JOIN methods m ON o.delivery_method = m.name WHERE result = 'FAILURE' GROUP BY ALL"""


def _note_counts(notes: DataFrame, *more: Column) -> DataFrame:
    return ms(joined(notes, "recipients")).groupBy(
        "message_group_id", "event_time", "resource_type", "resource_name", "delivery_method", "delivery_method_type",
        "part", "recipients", "message_subject").agg(F.count(F.lit(1)).alias("n"), *more)


def _notes(v: Views) -> DataFrame:
    matches = _matches(v)
    return A.notifications(_alerts(v, matches), matches, v.alert_config)


add(
    "snk3_stf7_notifications",
    lambda v: _note_counts(
        in_emitted_order(sinks.ordered_outbox(_notes(v)), [], ["message_group_id", "event_time", "message_key"]),
        F.bool_and("in_order").alias("in_order")),
    f"SELECT *, true AS in_order FROM ({_NOTE_SQL})",
)
def _results(v: Views) -> DataFrame:
    """Results with their messages as text: method, type, subject and number of body lines of each."""
    one = lambda m: F.concat_ws("=", m["delivery_method"], F.coalesce(m["delivery_method_type"], F.lit("")), m["message_subject"],
                                F.size(m["message_body"]).cast("string"))
    return A.alert_results(A.classified(v.events(), _full_config(v)), v.alert_config, _matches(v)).select(
        _id(), "*", F.array_join(F.transform("messages", one), ";").alias("told"), F.size("messages").cast("bigint").alias("n")).drop("event", "messages")


add(
    "evt12_alert_results", _results,
    f"""SELECT event_id, c.resource_type, c.resource_name, in_scope AND result = 'FAILURE' AS event_is_alertable,
        in_scope AND result IN ('SUCCESS', 'FAILURE') AS event_is_monitorable,
        CASE WHEN in_scope THEN url ELSE '' END AS execution_info_url,
        CASE WHEN in_scope AND result = 'FAILURE' THEN coalesce(n, 0) ELSE 0 END::BIGINT AS n,
        CASE WHEN in_scope AND result = 'FAILURE' THEN coalesce(array_to_string(list_transform(told, lambda t: t || '=' || coalesce(monitored_environment, 'None')
          || ': ' || state || ' - ' || c.resource_type || ' : ' || c.resource_name || '=' || len(string_split(body, chr(10)))), ';'), '') ELSE '' END AS told
        FROM (SELECT *, {_BODY} AS body, EXISTS (SELECT 1 FROM scope s WHERE s.resource_type = c.resource_type
            AND s.resource_name = c.resource_name) AS in_scope FROM cls c WHERE error IS NULL) c
        LEFT JOIN (SELECT resource_type, resource_name, count(*)::BIGINT AS n,
            list(delivery_method || '=' || coalesce(delivery_method_type, '') ORDER BY delivery_method) AS told
          FROM (SELECT DISTINCT resource_type, resource_name, delivery_method FROM options) o LEFT JOIN methods m ON o.delivery_method = m.name GROUP BY 1, 2) o
        ON c.resource_type = o.resource_type AND c.resource_name = o.resource_name""",
)


def _new_kind(v: Views) -> DataFrame:
    """A kind nobody knew, registered for the while of a query, with one run, one event and one digest run an event."""
    kind = "probe_runs"
    runs = v.raw_jobs.select("monitored_environment", F.col("JobName").alias("resource_name"), F.col("StartedOn").alias("time"))
    types = v.spark.createDataFrame([("aws.glue", "Something Else", kind)], "source string, detail_type string, resource_type string")
    registries = ((N.NORMALISERS, lambda df: df), (K.EVENT_RULES, lambda: (F.concat(F.lit("probe-"), "region"), F.lit("DONE"), F.lit(C.SUCCESS))),
                  (D.DIGEST_RUNS, lambda df, start, end: in_period(df, start, end)))
    refused = []
    for call in (lambda: N.normalise("nothing", runs), lambda: D.digest_runs(runs, "nothing", START, END)):
        try:
            call()
        except ValueError:
            refused.append(True)
    try:
        for registry, rule in registries:
            registry[kind] = rule
        facts = N.normalise(kind, runs)
        counted = lambda part, df: df.groupBy(F.lit(part).alias("part"), "resource_name").agg(F.count(F.lit(1)).alias("n"))
        events = K.mapped(K.classify_events(K.resolve_type(v.events(), types))).filter((F.col("resource_type") == kind) & (F.col("result") == C.SUCCESS))
        return union_types([counted("ext1", facts), counted("ext2", events), counted("ext3", D.digest_runs(facts, kind, START, END))]).withColumn(
            "unknown_refused", F.lit(len(refused) == 2))
    finally:
        for registry, _ in registries:
            registry.pop(kind, None)


add(
    "ext1_ext2_ext3_new_kind", _new_kind,
    """SELECT part, resource_name, count(*)::BIGINT AS n, true AS unknown_refused FROM (
        SELECT 'ext1' AS part, 'job-' || (user_id // 2) AS resource_name FROM ev
        UNION ALL SELECT 'ext3', 'job-' || (user_id // 2) FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-22'
        UNION ALL SELECT 'ext2', 'probe-region-' || (user_id % 3) FROM ev WHERE event_id % 10 = 9) GROUP BY ALL""",
)

# --- published events ---------------------------------------------------------------------


def _published(v: Views, kind: str) -> DataFrame:
    runs = v.raw_workflows if kind == C.GLUE_WORKFLOWS else L.sessionise(v.function_log)
    events = EV.to_events(M.with_account(runs, v.environments), kind)
    return A.classified(EV.known_sources(EV.parse_envelope(events)), v.alert_config)


add(
    "snk4_prj25_workflow_events",
    lambda v: _published(v, C.GLUE_WORKFLOWS).select(
        F.col("detail.workflowRunId").alias("run"), "resource_name", "state", "result", "monitored_environment",
        F.col("detail.message").alias("message")),
    """SELECT workflow_run_id AS run, resource_name, CASE WHEN failed = 1 THEN 'FAILED' ELSE 'COMPLETED' END AS state,
        CASE WHEN failed = 1 THEN 'FAILURE' ELSE 'SUCCESS' END AS result, monitored_environment,
        'Workflow run execution status: ' || CASE WHEN failed = 1 THEN 'failure' ELSE 'success' END AS message
        FROM m_glue_workflows""",
)
add(
    "snk4_prj26_lambda_events",
    lambda v: _published(v, C.LAMBDA_FUNCTIONS).select(
        "resource_name", "state", "result", "monitored_environment", F.col("detail.request_id").alias("request_id"),
        F.col("detail.log_stream").alias("log_stream"), F.col("detail.message").alias("message")),
    """SELECT function_name AS resource_name, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS state,
        CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS result, 'env-0' AS monitored_environment,
        request_id, log_stream, CASE WHEN length(full_text) > 100 THEN substr(full_text, 1, 100) || '...' ELSE full_text END
        AS message FROM log_runs""",
)

# --- streams ------------------------------------------------------------------------------


def _stream_alerts(v: Views) -> str:
    """Run the alert stream over event files and say where its tables are."""
    base = scratch_path(v.spark, "alert-stream")
    v.event_json.select("value").repartition(6).write.text(f"{base}/events")
    query = SA.run_alerts(
        v.spark, f"{base}/events", f"{base}/out", f"{base}/checkpoint", _settled_config(v), max_files=3)
    query.awaitTermination()
    return f"{base}/out"


def _settled_config(v: Views):
    config = v.alert_config
    return A.AlertConfig(
        settle(config.environments), settle(config.monitored), settle(config.recipients), settle(config.delivery_methods),
        apps=settle(config.apps))


add("src13_stf5_alert_stream_log", lambda v: ms(v.spark.read.parquet(f"{_stream_alerts(v)}/alert_log")).select(
    _id(), "*").drop("event", "date", "batch_id"), _LOG_SQL)
add(
    "stf7_sequence_numbers",
    lambda v: v.spark.read.parquet(f"{_stream_alerts(v)}/outbox").groupBy("message_group_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("sequence_number").alias("first"), F.max("sequence_number").alias("last"),
        (F.count_distinct("sequence_number") == F.count(F.lit(1))).alias("dense")),
    f"SELECT message_group_id, sum(n)::BIGINT AS n, 1::BIGINT AS first, sum(n)::BIGINT AS last, true AS dense FROM ({_NOTE_SQL}) GROUP BY 1",
)
add("stf5_alert_stream_outbox", lambda v: _note_counts(v.spark.read.parquet(f"{_stream_alerts(v)}/outbox")), _NOTE_SQL)


def _stream_timeline(v: Views) -> DataFrame:
    base = scratch_path(v.spark, "timeline-stream")
    v.alert_rows.withColumn("date", F.to_date("event_time")).repartition(4).write.partitionBy("date").parquet(
        f"{base}/log/batch_id=0")
    bins = SA.stream_timeline(v.spark, f"{base}/log", 5, "0 seconds")
    query = SA.run_once(bins.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/checkpoint"))
    query.awaitTermination()
    return ms(v.spark.read.parquet(f"{base}/out"))


add(
    "stf6_stream_timeline", _stream_timeline,
    """SELECT bin_start, events_cnt FROM (SELECT epoch_ms(time_bucket(INTERVAL 5 MINUTES, event_time)) AS bin_start,
        count(*)::BIGINT AS events_cnt, max(max(event_time)) OVER () AS latest,
        time_bucket(INTERVAL 5 MINUTES, event_time) + INTERVAL 5 MINUTES AS bin_end FROM alert_rows
        GROUP BY time_bucket(INTERVAL 5 MINUTES, event_time)) WHERE bin_end <= date_trunc('milliseconds', latest)""",
)


def _stream_log(v: Views) -> DataFrame:
    """Sessionise the log as a stream of four batches in time order."""
    base = scratch_path(v.spark, "log-stream")
    columns = [f.name for f in schemas.ddl(schemas.LOG_DDL)]
    span = v.function_log.agg(F.min("ts"), F.max("ts")).first()
    step = (span[1] - span[0]) / 4
    for n in range(4):
        low, high = span[0] + step * n, span[0] + step * (n + 1)
        piece = v.function_log.filter(
            (F.col("ts") >= F.lit(low)) & ((F.col("ts") < F.lit(high)) if n < 3 else F.lit(True)))
        piece.select(*columns).coalesce(1).write.mode("append").parquet(f"{base}/log")
    stream = v.spark.readStream.schema(schemas.ddl(schemas.LOG_DDL)).option("maxFilesPerTrigger", 1).parquet(f"{base}/log")
    SL.sessionise_stream(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return v.spark.read.parquet(f"{base}/out").select(
        "function_name", "log_stream", "request_id", F.unix_millis("started_on").alias("started"), "status", "error_message")


add(
    "stf1_sessionise_stream", _stream_log,
    """SELECT function_name, log_stream, request_id, started, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END
        AS status, CASE WHEN length(full_text) > 100 THEN substr(full_text, 1, 100) || '...' ELSE full_text END AS error_message
        FROM log_runs""",
)


def _unique(v: Views) -> DataFrame:
    """A stream that repeats every record, then brings others of all times: each is kept once, late ones not at all."""
    base = scratch_path(v.spark, "unique-stream")
    facts = v.m_lambda.select("resource_name", "time", "lambda_function_request_id")
    late = facts.withColumn("lambda_function_request_id", F.concat(F.lit("second-"), "lambda_function_request_id"))
    # What is late is told by the watermark of the batch before, which follows the first batch.
    for piece in (facts.unionAll(facts), facts, facts.unionAll(late)):
        piece.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = v.spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    once = SA.unique_records(stream, ["resource_name", "lambda_function_request_id", "time"])
    SA.run_once(once.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/checkpoint")).awaitTermination()
    return ms(v.spark.read.parquet(f"{base}/out"))


add(
    "stf4_unique_records", _unique,
    """SELECT resource_name, epoch_ms(time) AS time, lambda_function_request_id FROM m_lambda_functions
       UNION SELECT resource_name, epoch_ms(time), 'second-' || lambda_function_request_id FROM m_lambda_functions
       WHERE time > (SELECT max(time) FROM m_lambda_functions) - INTERVAL 24 HOURS""",
)
add(
    "src13_read_events",
    lambda v: EV.read_events(v.spark, _land_events(v), streaming=False).groupBy("source").agg(F.count(F.lit(1)).alias("n")),
    """SELECT ['aws.glue', 'fleetgauge.glue_workflow', 'aws.glue', 'aws.glue', 'aws.glue', 'aws.glue-dataquality', 'aws.states',
        'fleetgauge.lambda', 'aws.emr-serverless', 'aws.glue'][event_id % 10 + 1] AS source, count(*)::BIGINT AS n
        FROM events GROUP BY 1""",
)


def _land_events(v: Views) -> str:
    path = scratch_path(v.spark, "events")
    EV.publish_events(v.event_json, path)
    return path
