"""Dashboard statistics and series."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions.text import signed
from fleetgauge.functions.timefn import moment
from fleetgauge.operators.digest_runs import COUNTS, count_changes, latest
from fleetgauge.sources.tables import in_period

REQUEST = ["monitored_environment", "resource_name", "lambda_function_request_id"]


def dashboard_filter(
    df: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    names: list[str] | None = None,
    envs: list[str] | None = None,
    time: str = "time",
) -> DataFrame:
    """Time range, names and environments; an argument left out does not filter."""
    if start is not None and end is not None:
        df = in_period(df, start, end, time)
    if names is not None:
        df = df.filter(F.col("resource_name").isin(names))
    if envs is not None:
        df = df.filter(F.col("monitored_environment").isin(envs))
    return df


def run_totals(metrics: DataFrame, resource_type: str, **filters) -> DataFrame:
    """Runs, failures, successes, hours, and DPU-hours for the types that have them."""
    rows = dashboard_filter(metrics, **filters)
    out = [
        F.sum("execution").alias("total_runs"),
        F.sum("failed").alias("failed"),
        F.sum("succeeded").alias("succeeded"),
    ]
    if resource_type in (C.GLUE_JOBS, C.GLUE_CRAWLERS):
        out.append((F.sum("dpu_seconds") / 3600).alias("dpu_hours"))
    out.append((F.sum(C.DURATION[resource_type]) / 3600).alias("execution_hours"))
    return rows.agg(*out)


def _requests(metrics: DataFrame, **filters) -> DataFrame:
    """Attempts rolled up to requests."""
    return dashboard_filter(metrics, **filters).groupBy(*REQUEST).agg(
        F.lit(1).cast("bigint").alias("execution"),
        (F.sum("invocation") - 1).alias("retry_attempts"),
        F.min("failed").alias("failed"),
        F.max("succeeded").alias("succeeded"),
        F.sum("duration_ms").alias("duration_ms"),
        F.sum("billed_duration_ms").alias("billed_duration_ms"),
        F.sum("memory_size_mb").alias("memory_size_mb"),
        F.sum("GB_seconds").alias("GB_seconds"),
        F.max("max_memory_used_mb").alias("max_memory_used_mb"),
        F.min("time").alias("time"),
    )


def lambda_totals(metrics: DataFrame, **filters) -> DataFrame:
    """Requests, and how many succeeded, failed or were retried."""
    return _requests(metrics, **filters).agg(
        F.sum("execution").alias("total_executions"),
        F.sum("succeeded").alias("succeeded_executions"),
        F.sum("failed").alias("failed_executions"),
        F.sum("retry_attempts").alias("retry_attempts"),
    )


def lambda_usage(metrics: DataFrame, **filters) -> DataFrame:
    """Memory and time used by functions."""
    return dashboard_filter(metrics, **filters).agg(
        F.sum("GB_seconds").alias("total_gb_seconds"),
        (F.sum("billed_duration_ms") / 1000).alias("total_billed_sec"),
        (F.sum("duration_ms") / 1000).alias("total_duration_sec"),
        (F.sum("memory_size_mb") / 1024).alias("total_memory_gb"),
        F.max("max_memory_used_mb").alias("max_memory_used_mb"),
    )


def lambda_series(metrics: DataFrame, measures: list[str], **filters) -> DataFrame:
    """One point per request, at its first attempt's time."""
    _check_measures(C.LAMBDA_FUNCTIONS, measures)
    return _requests(metrics, **filters).select("time", *measures)


def crawler_objects(metrics: DataFrame, **filters) -> DataFrame:
    """Tables and partitions added, updated and deleted, one row each."""
    rows = dashboard_filter(metrics, **filters)
    done = ("added", "updated", "deleted")
    totals = rows.agg(
        *[F.sum(f"{p}_{d}").alias(f"{p}_{d}") for p in ("tables", "partitions") for d in done]
    )
    both = F.array(
        *[
            F.struct(F.lit(label).alias("objects"), *[F.col(f"{p}_{d}").alias(d) for d in done])
            for label, p in (("Tables", "tables"), ("Partitions", "partitions"))
        ]
    )
    return totals.select(F.inline(both))


def catalog_database_count(metrics: DataFrame, **filters) -> DataFrame:
    """Databases with a snapshot."""
    names = dashboard_filter(metrics, **filters).groupBy("resource_name").agg(F.max("time"))
    return names.agg(F.count(F.lit(1)).alias("database_count"))


def catalog_totals(metrics: DataFrame, **filters) -> DataFrame:
    """Tables, partitions and indexes over the newest snapshots."""
    newest = latest(dashboard_filter(metrics, **filters), ["resource_name"], COUNTS)
    return newest.agg(*[F.sum(c).alias(f"total_{c}") for c in COUNTS])


def catalog_diff(metrics: DataFrame, **filters) -> DataFrame:
    """Signed change of the three counts over the period, all databases together.

    Databases with one snapshot have no change to add; if there is no other, the label is
    NULL.
    """
    changes = count_changes(dashboard_filter(metrics, **filters), ["resource_name"])
    diffs = [c.replace("_count", "_diff") for c in COUNTS]
    return changes.agg(*[signed(F.sum(d)).alias(d) for d in diffs])


def database_list(metrics: DataFrame, n: int = 20, **filters) -> DataFrame:
    """The first n database names."""
    rows = dashboard_filter(metrics, **filters)
    return rows.select("resource_name").distinct().orderBy("resource_name").limit(n)


def pick_list(metrics: DataFrame, column: str) -> DataFrame:
    """Distinct values to choose from."""
    return metrics.select(column).distinct()


# --- series ---------------------------------------------------------------------------


def allowed_measures(resource_type: str) -> list[str]:
    """Measures a series of this type may show."""
    if resource_type not in C.SERIES_MEASURES:
        raise ValueError(f"no series for resource type {resource_type}")
    return list(C.SERIES_MEASURES[resource_type])


def _check_measures(resource_type: str, measures: list[str]) -> None:
    unknown = sorted(set(measures) - set(allowed_measures(resource_type)))
    if unknown or not measures:
        raise ValueError(f"measures not available for {resource_type}: {unknown}")


def series(metrics: DataFrame, resource_type: str, measures: list[str], **filters) -> DataFrame:
    """Time and the chosen measures of every stored record."""
    if resource_type == C.LAMBDA_FUNCTIONS:
        return lambda_series(metrics, measures, **filters)
    _check_measures(resource_type, measures)
    return dashboard_filter(metrics, **filters).select("time", *measures)


def totals_since(metrics: DataFrame, since: datetime, measures: list[str]) -> DataFrame:
    """Sums of measures over records strictly after a time."""
    return metrics.filter(F.col("time") > moment(since)).agg(*[F.sum(m).alias(m) for m in measures])


# --- alert log ------------------------------------------------------------------------


def alert_filter(
    log: DataFrame,
    types: list[str] | None = None,
    results: list[str] | None = None,
    status_re: str = "",
    name_re: str = "",
) -> DataFrame:
    """Alert rows of some types and results whose status and name match, without case."""
    if types is not None:
        log = log.filter(F.col("resource_type").isin(types))
    if results is not None:
        log = log.filter(F.col("event_result").isin(results))
    if status_re:
        log = log.filter(F.col("event_status").rlike("(?i)" + status_re))
    if name_re:
        log = log.filter(F.col("resource_name").rlike("(?i)" + name_re))
    return log


def alert_count(log: DataFrame, **filters) -> DataFrame:
    return alert_filter(log, **filters).agg(F.count(F.lit(1)).alias("alerts"))


def alerts_by_result(log: DataFrame, **filters) -> DataFrame:
    return (
        alert_filter(log, **filters)
        .groupBy("event_result")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy("event_result")
    )


def alerts_timeline(log: DataFrame, minutes: int = 5, **filters) -> DataFrame:
    """Alerts per time bin. On a stream with a watermark this closes bins as they pass."""
    binned = alert_filter(log, **filters).groupBy(F.window("event_time", f"{minutes} minutes"))
    return binned.agg(F.count(F.lit(1)).alias("events_cnt")).select(
        F.col("window.start").alias("bin_start"), "events_cnt"
    )


def alert_listing(log: DataFrame, **filters) -> DataFrame:
    """Alert rows as a listing."""
    return alert_filter(log, **filters).select(
        "event_time", "resource_type", "resource_name", "event_status", "event_result",
        "execution_info_url", F.col("event").alias("message"),
    )


def subject_contains(df: DataFrame, parts: list[str], column: str = "message_subject") -> DataFrame:
    """Messages whose subject has all the given texts."""
    for part in parts:
        df = df.filter(F.col(column).contains(part))
    return df

