"""State-change events to type, name, state, result, link and message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions import text as X
from fleetgauge.functions.links import run_url
from fleetgauge.functions.timefn import event_time, iso_from_ms
from fleetgauge.session import bounded_broadcast

_ROW = "struct<values:array<string>,style:string>"
_DERIVED = (C.GLUE_WORKFLOWS, C.LAMBDA_FUNCTIONS)


def resolve_type(events: DataFrame, types: DataFrame) -> DataFrame:
    """Resource type by source and detail-type; other events drop out."""
    return events.join(F.broadcast(types), ["source", "detail_type"])


def _result(state: Column, good: list[str], bad: list[str]) -> Column:
    return F.when(state.isin(bad), C.FAILURE).when(state.isin(good), C.SUCCESS).otherwise(C.INFO)


def _by_state(resource_type: str, state: str) -> tuple[Column, Column]:
    col = F.col(f"detail.{state}")
    return col, _result(col, *C.EVENT_STATES[resource_type])


def _catalog_state() -> Column:
    given = F.col("detail.state")
    return F.coalesce(
        given, F.when(F.col("detail_type").startswith("Glue Data Catalog"), C.CATALOG_EVENT_SUCCESS)
    )


def event_table() -> Column:
    """The table a catalog event is about: its name, else the first changed table."""
    return F.coalesce(
        F.col("detail.tableName"), F.try_element_at(F.col("detail.changedTables"), F.lit(1))
    )


def dq_context() -> tuple[Column, Column]:
    """Context type and run id of a data-quality event; NULL when unknown or missing."""
    kind = F.col("detail.context.contextType")
    kind = F.when(kind.isin(C.CONTEXT_CATALOG, C.CONTEXT_JOB), kind)
    run_id = F.when(kind == C.CONTEXT_CATALOG, F.col("detail.context.runId")).when(
        kind == C.CONTEXT_JOB, F.col("detail.context.jobId")
    )
    return kind, F.when(F.length(run_id) > 0, run_id)


# --- per type: name, state, result ----------------------------------------------------


def _workflow() -> tuple[Column, Column, Column]:
    result = F.col("detail.event_result")
    state = F.when(result.isin(C.WORKFLOW_EVENT_FAILURES), "FAILED").otherwise(F.col("detail.state"))
    return F.col("detail.workflowName"), state, result


def _catalog() -> tuple[Column, Column, Column]:
    state = _catalog_state()
    result = F.when(state == C.CATALOG_EVENT_SUCCESS, C.SUCCESS).otherwise(C.FAILURE)
    return F.col("detail.databaseName"), state, result


# Extension point: a resource type's name, state and result columns.
EVENT_RULES: dict[str, Callable[[], tuple[Column, Column, Column]]] = {
    C.GLUE_JOBS: lambda: (F.col("detail.jobName"), *_by_state(C.GLUE_JOBS, "state")),
    C.GLUE_WORKFLOWS: _workflow,
    C.GLUE_CRAWLERS: lambda: (F.col("detail.crawlerName"), *_by_state(C.GLUE_CRAWLERS, "state")),
    C.GLUE_CATALOGS: _catalog,
    C.GLUE_DATA_QUALITY: lambda: (
        F.try_element_at(F.col("detail.rulesetNames"), F.lit(1)),
        *_by_state(C.GLUE_DATA_QUALITY, "state"),
    ),
    C.LAMBDA_FUNCTIONS: lambda: (
        F.col("detail.lambdaName"), *_by_state(C.LAMBDA_FUNCTIONS, "state")
    ),
    C.STEP_FUNCTIONS: lambda: (
        X.name_from_arn(F.col("detail.stateMachineArn")), *_by_state(C.STEP_FUNCTIONS, "status")
    ),
    C.EMR_SERVERLESS: lambda: (F.col("app_name"), *_by_state(C.EMR_SERVERLESS, "state")),
}


def _by_type(columns: dict[str, Column], cast: str = "string") -> Column:
    """One column that takes each type's own expression."""
    out = F.lit(None).cast(cast)
    for kind, col in columns.items():
        out = F.when(F.col("resource_type") == kind, col).otherwise(out)
    return out


# --- message body ---------------------------------------------------------------------


def _row(label: str, value: Column, style: Column | None = None) -> Column:
    return F.struct(
        F.array(F.lit(label), value.cast("string")).alias("values"),
        (style if style is not None else F.lit(None).cast("string")).alias("style"),
    ).cast(_ROW)


def common_rows() -> list[Column]:
    """Account, region, time and event type; derived events name where the run was."""
    derived = F.col("resource_type").isin(*_DERIVED)
    return [
        _row("AWS Account", F.when(derived, F.col("detail.origin_account")).otherwise(F.col("account"))),
        _row("AWS Region", F.when(derived, F.col("detail.origin_region")).otherwise(F.col("region"))),
        _row("Time", F.col("time")),
        _row("Event Type", F.col("detail_type")),
    ]


def _link(text: Column) -> Column:
    return F.concat(F.lit("<a href='"), F.col("execution_info_url"), F.lit("'>"), text, F.lit("</a>"))


def _own_rows() -> dict[str, list[Column]]:
    """Rows each type adds, in order. A NULL entry is a row that does not apply."""
    d = lambda name: F.col(f"detail.{name}")
    name, state = F.col("resource_name"), F.col("state")
    style = F.when(F.col("result") == C.FAILURE, "error")
    console = _link(F.lit("Link to AWS Console"))
    kind, run_id = dq_context()
    crawl_message = F.coalesce(
        F.nullif(d("errorMessage"), F.lit("")), d("message"), F.lit("Missing execution details message")
    )
    return {
        C.GLUE_JOBS: [
            _row("Job Name", name), _row("State", state, style),
            _row("Glue Job Run ID", _link(d("jobRunId"))), _row("Message", d("message")),
        ],
        C.GLUE_WORKFLOWS: [
            _row("Workflow Name", name), _row("Workflow Run ID", _link(d("workflowRunId"))),
        ],
        C.GLUE_CRAWLERS: [
            _row("Crawler Name", name), _row("State", state, style),
            _row("Execution Info", console), _row("Message", crawl_message),
        ],
        C.GLUE_CATALOGS: [
            _row("Database Name", name), _row("Type of Change", d("typeOfChange")),
            _row("Execution Info", console),
        ],
        C.GLUE_DATA_QUALITY: [
            _row("Glue DQ Ruleset Name", name), _row("State", state, style),
            F.when(kind == C.CONTEXT_CATALOG, _row("Glue Table Name", d("context.tableName"))),
            F.when(kind == C.CONTEXT_CATALOG, _row("Glue Database Name", d("context.databaseName"))),
            F.when(kind == C.CONTEXT_JOB, _row("Glue Job Name", d("context.jobName"))),
            _row("Glue DQ Run ID", _link(run_id)),
        ],
        C.LAMBDA_FUNCTIONS: [
            _row("Function Name", name), _row("State", state, style),
            _row("Log Events", _link(F.lit("Link to AWS CloudWatch Log Group"))),
            _row("Log Stream", d("log_stream")), _row("Request ID", d("request_id")),
            _row("Message", d("message")),
        ],
        C.STEP_FUNCTIONS: [
            _row("State Machine Name", name), _row("Status", state, style),
            _row("Start Date", iso_from_ms(d("startDate"))),
            _row("Stop Date", iso_from_ms(d("stopDate"))),
            _row("Execution Info", _link(d("name"))),
        ],
        C.EMR_SERVERLESS: [
            _row("EMR Serverless Application Name", name),
            F.when(F.length("emr_run_name") > 0, _row("EMR Serverless Job Name", F.col("emr_run_name"))),
            _row("State", state, style), _row("Job Run ID", d("jobRunId")),
            F.when(F.length("emr_script") > 0, _row("Script Location", F.col("emr_script"))),
            _row("Console URL", _link(F.lit("Link to Amazon EMR Console"))),
            F.when(F.length("emr_message") > 0, _row("Message", F.col("emr_message"))),
        ],
    }


def event_body() -> Column:
    """Table rows of an event's message: common ones, then those of its type."""
    own = {
        kind: F.array_compact(F.array(*common_rows(), *rows)) for kind, rows in _own_rows().items()
    }
    return _by_type(own, f"array<{_ROW}>")


# --- whole ----------------------------------------------------------------------------


def _error() -> Column:
    """Why an event cannot be mapped; NULL when it can."""
    d = lambda name: F.col(f"detail.{name}")
    kind, run_id = dq_context()
    named = F.col("resource_name").isNotNull() & (F.length("resource_name") > 0)
    alertable = F.col("result") == C.FAILURE

    def because(text: str) -> Column:
        return F.concat(F.lit(f"{text}: "), F.col("event"))

    dq = F.col("resource_type") == C.GLUE_DATA_QUALITY
    emr = F.col("resource_type") == C.EMR_SERVERLESS
    return (
        F.when(dq & ~named, because("Required GLue DQ Ruleset name is not defined in the DQ event"))
        .when(dq & kind.isNull(), because("Unknown or missing context type in the DQ event"))
        .when(
            dq & run_id.isNull(),
            F.concat(F.lit("Missing run ID for context type "), kind, F.lit(" in the DQ event: "), F.col("event")),
        )
        .when(
            emr & (F.coalesce(F.length(d("applicationId")), F.lit(0)) == 0),
            because("EMR Serverless Application ID is not defined in the event"),
        )
        .when(
            emr & alertable & (F.coalesce(F.length(d("jobRunId")), F.lit(0)) == 0),
            because("EMR Job Run ID is not defined in the event"),
        )
        .when(
            (F.col("resource_type") == C.GLUE_CATALOGS) & F.col("state").isNull(),
            because("Required state is not defined in event"),
        )
        .when(~named, because("Resource name is not defined in the event"))
        .when(F.col("state").isNull(), because("Required state is not defined in event"))
    )


def classify_events(
    events: DataFrame, apps: DataFrame | None = None, emr_runs: DataFrame | None = None
) -> DataFrame:
    """Name, state, result, link and error text of typed events (`resolve_type`).

    `apps` (id, name) names batch applications; `emr_runs` (jobRunId, name, entry_point,
    message) adds what the run itself knows. Rows with an `error` cannot be mapped: take
    `mapped` or `event_errors`.
    """
    if apps is not None:
        named = apps.select(F.col("id").alias("_app"), F.col("name").alias("app_name"))
        events = events.join(bounded_broadcast(named), F.col("detail.applicationId") == F.col("_app"), "left").drop("_app")
    else:
        events = events.withColumn("app_name", F.col("detail.applicationId"))
    if emr_runs is not None:
        known = emr_runs.select(
            F.col("jobRunId").alias("_run"), F.col("name").alias("emr_run_name"),
            F.col("entry_point").alias("emr_script"), F.col("message").alias("emr_message"),
        )
        is_emr = F.col("resource_type") == C.EMR_SERVERLESS
        events = events.join(
            bounded_broadcast(known), is_emr & (F.col("detail.jobRunId") == F.col("_run")), "left"
        ).drop("_run")
    else:
        none = F.lit(None).cast("string")
        events = events.withColumns({"emr_run_name": none, "emr_script": none, "emr_message": none})

    rules = {kind: rule() for kind, rule in EVENT_RULES.items()}
    typed = events.withColumns(
        {
            "resource_name": _by_type({k: r[0] for k, r in rules.items()}),
            "state": _by_type({k: r[1] for k, r in rules.items()}),
            "result": _by_type({k: r[2] for k, r in rules.items()}),
        }
    )
    derived = F.col("resource_type").isin(*_DERIVED)
    region = F.when(derived, F.col("detail.origin_region")).otherwise(F.col("region"))
    kind, dq_run = dq_context()
    is_dq = F.col("resource_type") == C.GLUE_DATA_QUALITY
    url = run_url(
        F.col("resource_type"), region, F.col("resource_name"),
        account=F.col("account"),
        run_id=_by_type(
            {
                C.GLUE_JOBS: F.col("detail.jobRunId"),
                C.GLUE_WORKFLOWS: F.col("detail.workflowRunId"),
                C.GLUE_DATA_QUALITY: dq_run,
                C.STEP_FUNCTIONS: F.col("detail.name"),
            }
        ),
        context_type=kind,
        table_name=F.when(is_dq, F.col("detail.context.tableName")).otherwise(event_table()),
        db_name=F.when(is_dq, F.col("detail.context.databaseName")).otherwise(F.col("detail.databaseName")),
        catalog_id=F.col("detail.context.catalogId"),
        job_name=F.col("detail.context.jobName"),
        log_stream=F.col("detail.log_stream"),
        type_of_change=F.col("detail.typeOfChange"),
    )
    return typed.withColumns(
        {"execution_info_url": url, "event_time": event_time(F.col("time"))}
    ).withColumn("error", _error())


def mapped(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("error").isNull())


def event_errors(classified: DataFrame) -> DataFrame:
    """Events that could not be mapped, with the reason."""
    return classified.filter(F.col("error").isNotNull()).select(
        "event_time", "source", "detail_type", "resource_type", "error", "event"
    )


def with_flags(events: DataFrame) -> DataFrame:
    """Failures are alertable; failures and successes are monitorable."""
    result = F.col("result")
    return events.withColumns(
        {
            "is_alertable": F.coalesce(result == C.FAILURE, F.lit(False)),
            "is_monitorable": F.coalesce(result.isin(C.SUCCESS, C.FAILURE), F.lit(False)),
        }
    )


def origin() -> tuple[Column, Column]:
    """Account and region an event is about."""
    derived = F.col("resource_type").isin(*_DERIVED)
    return (
        F.when(derived, F.col("detail.origin_account")).otherwise(F.col("account")),
        F.when(derived, F.col("detail.origin_region")).otherwise(F.col("region")),
    )


def with_message(events: DataFrame) -> DataFrame:
    """Subject and body of each event's message. Needs `monitored_environment`."""
    return events.withColumns(
        {
            "message_subject": X.subject(
                F.col("monitored_environment"), F.col("state"), F.col("resource_type"),
                F.col("resource_name"),
            ),
            "message_body": event_body(),
        }
    )
