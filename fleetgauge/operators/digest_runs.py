"""Runs of a period in the digest's common shape."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.sources.tables import in_period

COMMON = {
    "resource_type": "string", "monitored_environment": "string", "resource_name": "string",
    "job_run_id": "string", "execution": "bigint", "failed": "bigint", "succeeded": "bigint",
    "execution_time_sec": "double", "error_message": "string", "failed_attempts": "bigint",
    "context_type": "string", "glue_table_name": "string", "glue_db_name": "string",
    "glue_job_name": "string", "log_stream": "string",
}


def _common(df: DataFrame, resource_type: str, **columns: Column) -> DataFrame:
    """Select the common shape; what a type does not have is NULL."""
    columns["resource_type"] = F.lit(resource_type)
    columns.setdefault("failed_attempts", F.lit(0))
    return df.select(
        *[
            columns.get(n, F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n)
            for n, t in COMMON.items()
        ]
    )


def _if_failed(col: Column) -> Column:
    return F.when(F.col("failed") > 0, col).otherwise("")


def _plain(resource_type: str) -> Callable[..., DataFrame]:
    """Types whose stored runs already have the common shape but for names."""

    def run(metrics: DataFrame, start: datetime, end: datetime) -> DataFrame:
        return _common(
            in_period(metrics, start, end),
            resource_type,
            job_run_id=_if_failed(F.col(C.RUN_ID[resource_type])),
            execution_time_sec=F.col(C.DURATION[resource_type]),
            error_message=_if_failed(F.col("error_message")),
        )

    return run


def _data_quality(metrics: DataFrame, start: datetime, end: datetime) -> DataFrame:
    run_id = F.when(F.col("context_type") == C.CONTEXT_CATALOG, F.col("ruleset_run_id")).when(
        F.col("context_type") == C.CONTEXT_JOB, F.col("glue_job_run_id")
    ).otherwise("")
    return _common(
        in_period(metrics, start, end),
        C.GLUE_DATA_QUALITY,
        job_run_id=_if_failed(run_id),
        error_message=_if_failed(F.col("error_message")),
    )


# --- functions ------------------------------------------------------------------------

_REQUEST = "lambda_function_request_id"


def request_errors(metrics: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """All error texts of each request seen in the period, joined in time order by `", "`.

    The text is one value by definition; a request has as many as it was attempted.
    """
    seen = in_period(metrics, start, end).filter(F.col(_REQUEST).isNotNull())
    texts = F.collect_list(F.when(F.col("error_message").isNotNull(), F.struct("time", "error_message")))
    return seen.groupBy(_REQUEST).agg(
        F.array_join(F.sort_array(texts)["error_message"], ", ").alias("error_message")
    )


def lambda_attempts(metrics: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Retries of a request rolled up, over all its rows, also those outside the period.

    Only requests seen in the period matter, so the table is first cut to those with a semi
    join (which prunes its scan at run time) and then aggregated on the way to the shuffle.
    """
    errors = request_errors(metrics, start, end)
    ids = in_period(metrics, start, end).select(_REQUEST).filter(F.col(_REQUEST).isNotNull()).distinct()
    rolled = (
        metrics.join(ids, _REQUEST, "left_semi")
        .groupBy("monitored_environment", "resource_name", _REQUEST, "log_stream")
        .agg(
            F.min("failed").alias("failed"),
            F.max("succeeded").alias("succeeded"),
            F.round(F.sum("duration_ms") / 1000, 2).alias("execution_time_sec"),
            F.sum("failed").alias("failed_attempts"),
        )
    )
    return rolled.join(errors, _REQUEST, "left").withColumn("execution", F.lit(1).cast("bigint"))


def _functions(metrics: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return _common(
        lambda_attempts(metrics, start, end),
        C.LAMBDA_FUNCTIONS,
        job_run_id=F.col(_REQUEST),
        failed_attempts=F.col("failed_attempts"),
    )


# --- catalogs -------------------------------------------------------------------------

COUNTS = ["tables_count", "partitions_count", "indexes_count"]


def first_last(df: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """First and last row of every resource, with both row numbers.

    Written as a window for any columns; where only a few are wanted, `catalog_deltas` gets
    them from one aggregate instead.
    """
    span = df.groupBy(*keys).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    ends = df.join(span, keys).filter((F.col(time) == F.col("_first")) | (F.col(time) == F.col("_last")))
    by_time = Window.partitionBy(*keys)
    return (
        ends.drop("_first", "_last")
        .withColumns(
            {
                "rn_desc": F.row_number().over(by_time.orderBy(F.col(time).desc())),
                "rn_asc": F.row_number().over(by_time.orderBy(F.col(time).asc())),
            }
        )
        .filter((F.col("rn_desc") == 1) | (F.col("rn_asc") == 1))
    )


def latest(df: DataFrame, keys: list[str], columns: list[str], time: str = "time") -> DataFrame:
    """Newest values per resource, from one aggregate (no window, no sort)."""
    return df.groupBy(*keys).agg(
        F.max(time).alias(time), *[F.max_by(c, time).alias(c) for c in columns]
    )


def count_changes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Newest counts per resource and how far they moved since the oldest.

    A resource with one snapshot has no earlier one, so its changes are NULL. One aggregate
    does what ranking both ends and looking back would: partial on the way to the shuffle,
    so a resource with a large share of the rows is no heavier than another.
    """
    return df.groupBy(*keys).agg(
        F.max_by("monitored_environment", "time").alias("last_environment"),
        *[F.max_by(c, "time").alias(c) for c in COUNTS],
        *[
            F.when(
                F.count(F.lit(1)) > 1, F.max_by(c, "time") - F.min_by(c, "time")
            ).alias(c.replace("_count", "_diff"))
            for c in COUNTS
        ],
    )


def catalog_deltas(
    metrics: DataFrame, start: datetime, end: datetime, match_env: bool = True
) -> DataFrame:
    """Counts per database at the period's end and what was added during it."""
    keys = [*(["monitored_environment"] if match_env else []), "resource_name"]
    changed = count_changes(in_period(metrics, start, end), keys)
    return changed.select(
        F.lit(C.GLUE_CATALOGS).alias("resource_type"),
        F.col("last_environment").alias("monitored_environment"),
        "resource_name",
        *[
            col
            for c in COUNTS
            for col in (
                F.col(c),
                F.coalesce(c.replace("_count", "_diff"), F.lit(0)).alias(c.replace("_count", "_added")),
            )
        ],
    )


# Extension point: how each type's metrics become digest runs.
DIGEST_RUNS: dict[str, Callable[..., DataFrame]] = {
    C.GLUE_JOBS: _plain(C.GLUE_JOBS),
    C.GLUE_WORKFLOWS: _plain(C.GLUE_WORKFLOWS),
    C.GLUE_CRAWLERS: _plain(C.GLUE_CRAWLERS),
    C.GLUE_CATALOGS: catalog_deltas,
    C.GLUE_DATA_QUALITY: _data_quality,
    C.LAMBDA_FUNCTIONS: _functions,
    C.STEP_FUNCTIONS: _plain(C.STEP_FUNCTIONS),
    C.EMR_SERVERLESS: _plain(C.EMR_SERVERLESS),
}


def digest_runs(metrics: DataFrame, resource_type: str, start: datetime, end: datetime) -> DataFrame:
    """Runs of a period, in the digest's shape, of one resource type."""
    if resource_type not in DIGEST_RUNS:
        raise ValueError(f"no digest extraction registered for resource type {resource_type}")
    return DIGEST_RUNS[resource_type](metrics, start, end)
