"""Fixed schemas. Nothing in the package infers one."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import types as T

from fleetgauge import constants as C


def ddl(text: str) -> T.StructType:
    """A StructType from DDL text (needs a running session)."""
    return T.StructType.fromDDL(text)


_DIMENSIONS = "monitored_environment STRING, resource_name STRING, time TIMESTAMP"

METRICS_DDL = {
    C.GLUE_JOBS: f"""{_DIMENSIONS}, job_run_id STRING, execution BIGINT, succeeded BIGINT,
        failed BIGINT, execution_time_sec DOUBLE, error_message STRING, dpu_seconds DOUBLE""",
    C.GLUE_WORKFLOWS: f"""{_DIMENSIONS}, workflow_run_id STRING, execution BIGINT,
        succeeded BIGINT, failed BIGINT, execution_time_sec DOUBLE, error_message STRING,
        actions_total BIGINT, actions_timeouted BIGINT, actions_failed BIGINT,
        actions_stopped BIGINT, actions_succeeded BIGINT, actions_errored BIGINT""",
    C.GLUE_CRAWLERS: f"""{_DIMENSIONS}, crawl_id STRING, execution BIGINT, succeeded BIGINT,
        failed BIGINT, duration_sec DOUBLE, dpu_seconds DOUBLE, error_message STRING,
        tables_added BIGINT, tables_updated BIGINT, tables_deleted BIGINT,
        partitions_added BIGINT, partitions_updated BIGINT, partitions_deleted BIGINT""",
    C.GLUE_CATALOGS: f"""{_DIMENSIONS}, catalog_id STRING, tables_count BIGINT,
        partitions_count BIGINT, indexes_count BIGINT""",
    C.GLUE_DATA_QUALITY: f"""{_DIMENSIONS}, dq_result_id STRING, score DOUBLE,
        context_type STRING, execution BIGINT, succeeded BIGINT, failed BIGINT,
        rules_succeeded BIGINT, rules_failed BIGINT, total_rules BIGINT,
        execution_time_sec DOUBLE, error_message STRING, ruleset_run_id STRING,
        glue_table_name STRING, glue_db_name STRING, glue_job_name STRING,
        glue_job_run_id STRING""",
    C.LAMBDA_FUNCTIONS: f"""{_DIMENSIONS}, lambda_function_request_id STRING,
        log_stream STRING, invocation BIGINT, succeeded BIGINT, failed BIGINT, status STRING,
        duration_ms DOUBLE, billed_duration_ms DOUBLE, memory_size_mb DOUBLE,
        GB_seconds DOUBLE, max_memory_used_mb DOUBLE, error_message STRING""",
    C.STEP_FUNCTIONS: f"""{_DIMENSIONS}, step_function_run_id STRING, execution BIGINT,
        succeeded BIGINT, failed BIGINT, duration_sec DOUBLE, error_message STRING""",
    C.EMR_SERVERLESS: f"""{_DIMENSIONS}, job_run_id STRING, job_run_name STRING,
        app_id STRING, execution BIGINT, succeeded BIGINT, failed BIGINT,
        execution_time_sec DOUBLE, error_message STRING, total_vCPU_hour DOUBLE,
        total_memory_GB_hour DOUBLE, total_storage_GB_hour DOUBLE, billed_vCPU_hour DOUBLE,
        billed_memory_GB_hour DOUBLE, billed_storage_GB_hour DOUBLE""",
}


@lru_cache(maxsize=None)
def _metrics_json(resource_type: str) -> str:
    return ddl(METRICS_DDL[resource_type]).json()


def metrics_schema(resource_type: str) -> T.StructType:
    """Schema of one metrics table."""
    return T.StructType.fromJson(json.loads(_metrics_json(resource_type)))


def metrics_columns(resource_type: str) -> dict[str, str]:
    """Column names of a metrics table with their type names; needs no session."""
    return {name: kind.lower() for name, kind in (field.split() for field in METRICS_DDL[resource_type].split(","))}


_ENV = "monitored_environment STRING"

# Landed run records, one file format per resource type. Each record names the
# environment it was collected from; list responses keep their nested array.
RAW_DDL = {
    C.GLUE_JOBS: f"""{_ENV}, JobRuns ARRAY<STRUCT<Id STRING, Attempt INT, JobName STRING,
        StartedOn TIMESTAMP, LastModifiedOn TIMESTAMP, CompletedOn TIMESTAMP,
        JobRunState STRING, ErrorMessage STRING, PredecessorRuns ARRAY<STRING>,
        AllocatedCapacity INT, ExecutionTime INT, Timeout INT, MaxCapacity DOUBLE,
        LogGroupName STRING, GlueVersion STRING, DPUSeconds DOUBLE>>""",
    C.GLUE_WORKFLOWS: f"""{_ENV}, Runs ARRAY<STRUCT<Name STRING, WorkflowRunId STRING,
        WorkflowRunProperties MAP<STRING, STRING>, StartedOn TIMESTAMP,
        CompletedOn TIMESTAMP, Status STRING, ErrorMessage STRING,
        Statistics STRUCT<TotalActions INT, TimeoutActions INT, FailedActions INT,
        StoppedActions INT, SucceededActions INT, RunningActions INT, ErroredActions INT,
        WaitingActions INT>, Graph STRUCT<Nodes ARRAY<STRUCT<Type STRING, Name STRING,
        Job STRUCT<Name STRING, ErrorMessage STRING>,
        JobDetails STRUCT<JobRuns ARRAY<STRUCT<Id STRING, ErrorMessage STRING>>>,
        CrawlerDetails STRUCT<Crawls ARRAY<STRUCT<State STRING, ErrorMessage STRING>>>>>>>>""",
    C.GLUE_CRAWLERS: f"""{_ENV}, CrawlerName STRING, Crawls ARRAY<STRUCT<CrawlId STRING,
        State STRING, StartTime TIMESTAMP, EndTime TIMESTAMP, ErrorMessage STRING,
        DPUHour DOUBLE, Summary STRING>>""",
    C.GLUE_DATA_QUALITY: f"""{_ENV}, Results ARRAY<STRUCT<ResultId STRING, Score DOUBLE,
        RulesetName STRING, EvaluationContext STRING, RulesetEvaluationRunId STRING,
        StartedOn TIMESTAMP, CompletedOn TIMESTAMP, JobName STRING, JobRunId STRING,
        RuleResults ARRAY<STRUCT<Name STRING, Description STRING, Result STRING,
        EvaluatedMetrics MAP<STRING, DOUBLE>, EvaluationMessage STRING>>,
        DataSource STRUCT<GlueTable STRUCT<DatabaseName STRING, TableName STRING>>>>""",
    C.STEP_FUNCTIONS: f"""{_ENV}, executions ARRAY<STRUCT<executionArn STRING,
        stateMachineArn STRING, name STRING, status STRING, startDate TIMESTAMP,
        stopDate TIMESTAMP, error STRING, cause STRING>>""",
    C.EMR_SERVERLESS: f"""{_ENV}, jobRun STRUCT<applicationId STRING, jobRunId STRING,
        name STRING, createdAt TIMESTAMP, updatedAt TIMESTAMP, state STRING,
        stateDetails STRING, jobDriver STRUCT<sparkSubmit STRUCT<entryPoint STRING>>,
        totalResourceUtilization STRUCT<vCPUHour DOUBLE, memoryGBHour DOUBLE,
        storageGBHour DOUBLE>, totalExecutionDurationSeconds INT,
        billedResourceUtilization STRUCT<vCPUHour DOUBLE, memoryGBHour DOUBLE,
        storageGBHour DOUBLE>>""",
    "lambda_logs": f"""{_ENV}, function_name STRING,
        entry ARRAY<STRUCT<field STRING, value STRING>>""",
}

# Catalog listings: one table per level.
CATALOG_DDL = {
    "databases": f"{_ENV}, DatabaseName STRING, AccountId STRING",
    "tables": f"""{_ENV}, DatabaseName STRING, Name STRING, CatalogId STRING,
        CreateTime TIMESTAMP, UpdateTime TIMESTAMP""",
    "partitions": f"{_ENV}, DatabaseName STRING, TableName STRING, Partition STRING",
    "indexes": f"{_ENV}, DatabaseName STRING, TableName STRING, IndexName STRING",
}

LOG_DDL = f"""{_ENV}, function_name STRING, ts TIMESTAMP, log_stream STRING,
    message STRING, request_id STRING"""

# State-change envelope: `detail` is the union of what the eight kinds of event carry.
EVENT_DDL = """version STRING, id STRING, `detail-type` STRING, source STRING,
    account STRING, time STRING, region STRING, resources ARRAY<STRING>,
    detail STRUCT<jobName: STRING, jobRunId: STRING, severity: STRING, state: STRING,
        status: STRING, message: STRING, errorMessage: STRING, crawlerName: STRING,
        workflowName: STRING, workflowRunId: STRING, event_result: STRING,
        origin_account: STRING, origin_region: STRING, databaseName: STRING,
        tableName: STRING, typeOfChange: STRING, changedTables: ARRAY<STRING>,
        changedPartitions: ARRAY<STRING>, rulesetNames: ARRAY<STRING>,
        context: STRUCT<contextType: STRING, catalogId: STRING, databaseName: STRING,
            tableName: STRING, jobName: STRING, jobId: STRING, runId: STRING>,
        stateMachineArn: STRING, name: STRING, startDate: BIGINT, stopDate: BIGINT,
        lambdaName: STRING, request_id: STRING, log_stream: STRING,
        applicationId: STRING>"""

ALERT_LOG_DDL = """event_time TIMESTAMP, monitored_environment STRING,
    resource_name STRING, resource_type STRING, event_status STRING, event_result STRING,
    execution_info_url STRING, event STRING"""

# --- configuration files --------------------------------------------------------------
GENERAL_DDL = """tooling_environment STRUCT<name: STRING, account_id: STRING,
        region: STRING, metrics_collection_cron_expression: STRING,
        digest_report_period_hours: INT, digest_cron_expression: STRING>,
    monitored_environments ARRAY<STRUCT<name: STRING, account_id: STRING, region: STRING>>,
    delivery_methods ARRAY<STRUCT<name: STRING, delivery_method_type: STRING,
        sender_email: STRING>>"""

_ENTRY = """ARRAY<STRUCT<name: STRING, monitored_environment_name: STRING,
    sla_seconds: INT, minimum_number_of_runs: INT>>"""
GROUPS_DDL = (
    "monitoring_groups ARRAY<STRUCT<group_name: STRING, "
    + ", ".join(f"{t}: {_ENTRY}" for t in C.RESOURCE_TYPES)
    + ">>"
)
RECIPIENTS_DDL = """recipients ARRAY<STRUCT<recipient: STRING, delivery_method: STRING,
    subscriptions: ARRAY<STRUCT<monitoring_group: STRING, alerts: BOOLEAN,
        digest: BOOLEAN>>>>"""

MONITORED_DDL = """group_name STRING, resource_type STRING, name STRING,
    monitored_environment STRING, sla_seconds INT, minimum_number_of_runs INT,
    entry_order BIGINT"""
