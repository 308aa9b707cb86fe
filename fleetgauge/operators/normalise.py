"""Raw run records to metrics facts, one function per resource type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge import schemas
from fleetgauge.functions import outcome as O
from fleetgauge.functions.timefn import duration_sec, to_ms

_STATE = {
    C.GLUE_JOBS: "JobRunState",
    C.GLUE_WORKFLOWS: "Status",
    C.GLUE_CRAWLERS: "State",
    C.LAMBDA_FUNCTIONS: "status",
    C.STEP_FUNCTIONS: "status",
    C.EMR_SERVERLESS: "state",
}


def only_final(df: DataFrame, resource_type: str) -> DataFrame:
    """Finished runs only. Batch jobs also need their utilisation figures."""
    if resource_type in (C.GLUE_DATA_QUALITY, C.GLUE_CATALOGS):
        return df
    if resource_type == C.LAMBDA_FUNCTIONS:
        return df.filter(F.col("started_on").isNotNull() & F.col("report").isNotNull())
    kept = df.filter(O.is_final(resource_type, F.col(_STATE[resource_type])))
    if resource_type == C.EMR_SERVERLESS:
        kept = kept.filter(
            F.col("totalResourceUtilization.vCPUHour").isNotNull()
            & F.col("billedResourceUtilization.vCPUHour").isNotNull()
        )
    return kept


def _fact(df: DataFrame, resource_type: str, columns: dict[str, Column]) -> DataFrame:
    """Select the fact's columns in schema order with the schema's types."""
    schema = schemas.metrics_schema(resource_type)
    columns = {"monitored_environment": F.col("monitored_environment"), **columns}
    return df.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in schema])


def _counts(resource_type: str) -> dict[str, Column]:
    good, bad = C.RUN_STATES[resource_type]
    state = F.col(_STATE[resource_type])
    return {
        "execution": F.lit(1),
        "succeeded": O.flag(state.isin(good)),
        "failed": O.flag(state.isin(bad)),
    }


def normalise_glue_jobs(runs: DataFrame) -> DataFrame:
    c = F.col
    return _fact(only_final(runs, C.GLUE_JOBS), C.GLUE_JOBS, {
        "resource_name": c("JobName"),
        "time": to_ms(c("StartedOn")),
        "job_run_id": c("Id"),
        **_counts(C.GLUE_JOBS),
        "execution_time_sec": c("ExecutionTime"),
        "error_message": c("ErrorMessage"),
        "dpu_seconds": O.job_dpu_seconds(c("DPUSeconds"), c("ExecutionTime"), c("MaxCapacity")),
    })


def normalise_glue_workflows(runs: DataFrame) -> DataFrame:
    c = F.col
    good = O.workflow_success(
        c("Status"), c("Statistics.TotalActions"), c("Statistics.SucceededActions")
    )
    given = c("ErrorMessage")
    return _fact(only_final(runs, C.GLUE_WORKFLOWS), C.GLUE_WORKFLOWS, {
        "resource_name": c("Name"),
        "time": to_ms(c("StartedOn")),
        "workflow_run_id": c("WorkflowRunId"),
        "execution": F.lit(1),
        "succeeded": O.flag(good),
        "failed": O.flag(~good),
        "execution_time_sec": duration_sec(c("StartedOn"), c("CompletedOn")),
        "error_message": F.when(
            ~good & given.isNull(), O.workflow_error(c("Graph.Nodes"))
        ).otherwise(given),
        "actions_total": c("Statistics.TotalActions"),
        "actions_timeouted": c("Statistics.TimeoutActions"),
        "actions_failed": c("Statistics.FailedActions"),
        "actions_stopped": c("Statistics.StoppedActions"),
        "actions_succeeded": c("Statistics.SucceededActions"),
        "actions_errored": c("Statistics.ErroredActions"),
    })


def normalise_glue_crawlers(runs: DataFrame) -> DataFrame:
    c = F.col
    final = only_final(runs, C.GLUE_CRAWLERS).withColumn(
        "summary_counts", O.parse_crawl_summary(c("Summary"))
    )
    return _fact(final, C.GLUE_CRAWLERS, {
        "resource_name": c("CrawlerName"),
        "time": to_ms(c("StartTime")),
        "crawl_id": c("CrawlId"),
        **_counts(C.GLUE_CRAWLERS),
        "duration_sec": duration_sec(c("StartTime"), c("EndTime")),
        "dpu_seconds": O.crawl_dpu_seconds(c("DPUHour")),
        "error_message": c("ErrorMessage"),
        **{
            f"{what}_{done}": c(f"summary_counts.{what}_{done}")
            for what in ("tables", "partitions")
            for done in ("added", "updated", "deleted")
        },
    })


def normalise_data_quality(runs: DataFrame) -> DataFrame:
    c = F.col
    table, rules = c("DataSource.GlueTable"), c("RuleResults")
    on_table = table.isNotNull()
    return _fact(runs, C.GLUE_DATA_QUALITY, {
        "resource_name": c("RulesetName"),
        "time": to_ms(c("StartedOn")),
        "dq_result_id": c("ResultId"),
        "score": c("Score"),
        "context_type": O.context_type(table),
        "execution": F.lit(1),
        "succeeded": O.flag(O.dq_succeeded(rules)),
        "failed": O.flag(O.dq_failed(rules)),
        "rules_succeeded": O.rule_count(rules, C.RULE_SUCCESS),
        "rules_failed": O.rule_count(rules, C.RULE_FAILURE),
        "total_rules": O.rule_count(rules),
        "execution_time_sec": duration_sec(c("StartedOn"), c("CompletedOn")),
        "error_message": O.dq_error(rules),
        "ruleset_run_id": F.when(on_table, c("RulesetEvaluationRunId")),
        "glue_table_name": F.when(on_table, table["TableName"]),
        "glue_db_name": F.when(on_table, table["DatabaseName"]),
        "glue_job_name": F.when(~on_table, c("JobName")),
        "glue_job_run_id": F.when(~on_table, c("JobRunId")),
    })


def normalise_step_functions(runs: DataFrame) -> DataFrame:
    """Needs `resource_name` (see `with_machine_arn`)."""
    c = F.col
    counts = _counts(C.STEP_FUNCTIONS)
    return _fact(only_final(runs, C.STEP_FUNCTIONS), C.STEP_FUNCTIONS, {
        "resource_name": c("resource_name"),
        "time": to_ms(c("startDate")),
        "step_function_run_id": c("name"),
        **counts,
        "duration_sec": duration_sec(c("startDate"), c("stopDate")),
        "error_message": F.when(counts["failed"] > 0, O.sfn_error(c("error"), c("cause"))),
    })


def normalise_lambda(invocations: DataFrame) -> DataFrame:
    """Takes sessionised invocations (`operators.logs.sessionise`)."""
    c = F.col
    report = O.parse_report(c("report"))
    return _fact(only_final(invocations, C.LAMBDA_FUNCTIONS), C.LAMBDA_FUNCTIONS, {
        "resource_name": c("function_name"),
        "time": to_ms(c("started_on")),
        "lambda_function_request_id": c("request_id"),
        "log_stream": c("log_stream"),
        "invocation": F.lit(1),
        "succeeded": O.flag(c("status") == "SUCCEEDED"),
        "failed": O.flag(c("status") == "FAILED"),
        "status": c("status"),
        **report,
        "GB_seconds": O.gb_seconds(report["memory_size_mb"], report["billed_duration_ms"]),
        "error_message": c("error_message"),
    })


def normalise_emr(runs: DataFrame) -> DataFrame:
    """Needs `resource_name`, the application's name (see `with_app_name`)."""
    c = F.col
    return _fact(only_final(runs, C.EMR_SERVERLESS), C.EMR_SERVERLESS, {
        "resource_name": c("resource_name"),
        "time": to_ms(c("createdAt")),
        "job_run_id": c("jobRunId"),
        "job_run_name": c("name"),
        "app_id": c("applicationId"),
        **_counts(C.EMR_SERVERLESS),
        "execution_time_sec": c("totalExecutionDurationSeconds"),
        "error_message": O.emr_error(c("stateDetails")),
        "total_vCPU_hour": c("totalResourceUtilization.vCPUHour"),
        "total_memory_GB_hour": c("totalResourceUtilization.memoryGBHour"),
        "total_storage_GB_hour": c("totalResourceUtilization.storageGBHour"),
        "billed_vCPU_hour": c("billedResourceUtilization.vCPUHour"),
        "billed_memory_GB_hour": c("billedResourceUtilization.memoryGBHour"),
        "billed_storage_GB_hour": c("billedResourceUtilization.storageGBHour"),
    })


def catalog_counts(
    databases: DataFrame, tables: DataFrame, partitions: DataFrame, indexes: DataFrame
) -> DataFrame:
    """Tables, partitions and indexes per database.

    Every level is counted per database before any join, so a huge table only costs partial
    counts, and the joins see one row per database. Parts of unlisted tables do not count.
    """
    db = ["monitored_environment", "DatabaseName"]
    listed = tables.groupBy(*db).agg(
        F.count(F.lit(1)).alias("tables_count"), F.min_by("CatalogId", "Name").alias("catalog_id")
    )

    def parts(df: DataFrame, name: str) -> DataFrame:
        per_table = df.groupBy(*db, F.col("TableName").alias("Name")).agg(
            F.count(F.lit(1)).alias("n")
        )
        known = per_table.join(tables.select(*db, "Name").distinct(), [*db, "Name"], "left_semi")
        return known.groupBy(*db).agg(F.sum("n").alias(name))

    zero = F.lit(0)
    return (
        databases.select(*db, "AccountId")
        .distinct()
        .join(listed, db, "left")
        .join(parts(partitions, "partitions_count"), db, "left")
        .join(parts(indexes, "indexes_count"), db, "left")
        .select(
            *db,
            F.coalesce("catalog_id", "AccountId").alias("catalog_id"),
            F.coalesce("tables_count", zero).alias("tables_count"),
            F.coalesce("partitions_count", zero).alias("partitions_count"),
            F.coalesce("indexes_count", zero).alias("indexes_count"),
        )
    )


def normalise_catalogs(counts: DataFrame) -> DataFrame:
    """One snapshot fact per database from its counts (`catalog_counts`) and the time they were taken on."""
    return _fact(counts, C.GLUE_CATALOGS, {
        "resource_name": F.col("DatabaseName"),
        "time": to_ms(F.col("taken_on")),
        **{n: F.col(n) for n in ("catalog_id", "tables_count", "partitions_count", "indexes_count")},
    })


def snapshot_catalogs(
    databases: DataFrame, tables: DataFrame, partitions: DataFrame, indexes: DataFrame, at: Column
) -> DataFrame:
    """One snapshot fact per database, taken at the given time."""
    return normalise_catalogs(catalog_counts(databases, tables, partitions, indexes).withColumn("taken_on", at))


# Extension point: a new resource type registers its function here.
NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    C.GLUE_JOBS: normalise_glue_jobs,
    C.GLUE_WORKFLOWS: normalise_glue_workflows,
    C.GLUE_CRAWLERS: normalise_glue_crawlers,
    C.GLUE_CATALOGS: normalise_catalogs,
    C.GLUE_DATA_QUALITY: normalise_data_quality,
    C.LAMBDA_FUNCTIONS: normalise_lambda,
    C.STEP_FUNCTIONS: normalise_step_functions,
    C.EMR_SERVERLESS: normalise_emr,
}


def normalise(resource_type: str, runs: DataFrame) -> DataFrame:
    """Apply the registered function; an unknown type is an error."""
    if resource_type not in NORMALISERS:
        raise ValueError(f"no normaliser registered for resource type {resource_type}")
    return NORMALISERS[resource_type](runs)
