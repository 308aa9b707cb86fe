"""Health of configured resources and of monitoring groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions import text as X
from fleetgauge.functions.links import run_url
from fleetgauge.operators.matching import last_entry_wins
from fleetgauge.operators.ordinals import pieces
from fleetgauge.session import bounded_broadcast

ENTRY = ["group_name", "resource_type", "monitored_environment", "resource_name"]


def _config(config: DataFrame) -> DataFrame:
    """One row per configured resource, the entry written last."""
    return last_entry_wins(config).withColumnRenamed("name", "resource_name")


def _run_keys(match_env: bool) -> list[str]:
    keys = ["resource_type", "resource_name"]
    return [*keys, "monitored_environment"] if match_env else keys


def _with_config(runs: DataFrame, config: DataFrame, match_env: bool) -> DataFrame:
    """Runs with the entries they belong to. With the config's size checked, runs stay put."""
    keys = _run_keys(match_env)
    facts = runs if match_env else runs.drop("monitored_environment")
    return facts.join(bounded_broadcast(config), keys)


def attach_runs(config: DataFrame, run_totals: DataFrame, measures: list[str], on: list[str] = ENTRY) -> DataFrame:
    """Every configured resource with its totals, 0 where it had no run. Totals are by the columns `on`; an entry that lacks one of `ENTRY` has none."""
    totals = run_totals.select(*[F.col(c).alias(f"_{c}") for c in on], *measures)
    same = [F.col(c) == F.col(f"_{c}") if c in ENTRY else F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    whole = [F.col(c).isNotNull() for c in ENTRY]
    joined = config.join(totals, reduce(and_, same + whole), "left").drop(*[f"_{c}" for c in on])
    return joined.withColumns({m: F.coalesce(m, F.lit(0)) for m in measures})


def sla_breach(sla: Column, seconds: Column) -> Column:
    return F.coalesce((sla > 0) & (seconds > sla), F.lit(False))


def late_success() -> Column:
    """Succeeded, but only after failed attempts."""
    return F.coalesce((F.col("succeeded") > 0) & (F.col("failed_attempts") > 0), F.lit(False))


def resource_health(runs: DataFrame, config: DataFrame, match_env: bool = True) -> DataFrame:
    """Executions, successes, errors, warnings and status of every configured resource.

    Runs meet the distinct limits of their resource, not every entry of it, and are added up on the way to the
    shuffle; entries pick up the totals of their limit. `match_env=False` matches runs to entries
    by name alone.
    """
    entries = _config(config)
    limit = [*_run_keys(match_env), "sla_seconds"]
    joined = _with_config(runs, entries.select(*limit).distinct(), match_env)
    breach, late = sla_breach(F.col("sla_seconds"), F.col("execution_time_sec")), late_success()
    totals = joined.groupBy(*limit).agg(
        F.sum("execution").alias("executions"),
        F.sum("succeeded").alias("success"),
        F.sum("failed").alias("errors"),
        F.count_if(breach).alias("sla_breaches"),
        F.count_if(late).alias("late_successes"),
    )
    measures = ["executions", "success", "errors", "sla_breaches", "late_successes"]
    min_runs = F.col("minimum_number_of_runs")
    health = attach_runs(entries, totals, measures, limit).select(
        *ENTRY,
        "account_id",
        "region_name",
        "sla_seconds",
        "minimum_number_of_runs",
        *measures[:3],
        (F.col("sla_breaches") + F.col("late_successes")).alias("warnings"),
        (F.col("sla_breaches") > 0).alias("has_sla_breach"),
        (F.col("late_successes") > 0).alias("has_failed_attempts"),
        F.coalesce((min_runs > 0) & (F.col("executions") < min_runs), F.lit(False)).alias(
            "insufficient_runs"
        ),
    )
    return health.withColumn(
        "status",
        X.resource_status(F.col("errors"), F.col("insufficient_runs"), F.col("warnings")),
    )


# Where a comment line stands in a resource's text.
FAILED_HEAD, FAILED, TOO_FEW, RETRY_HEAD, RETRIED, SLA = 1, 2, 3, 4, 5, 6


def run_comments(runs: DataFrame, config: DataFrame, match_env: bool = True) -> DataFrame:
    """One row per resource and distinct line about a failed or retried run.

    Kept as rows: how many a resource has depends on how often it failed, which nothing
    bounds.
    """
    noted = runs.filter((F.col("failed") > 0) | late_success())
    joined = _with_config(noted, _config(config), match_env)
    url = run_url(
        F.col("resource_type"), F.col("region_name"), F.col("resource_name"),
        account=F.col("account_id"), run_id=F.col("job_run_id"),
        context_type=F.col("context_type"), table_name=F.col("glue_table_name"),
        db_name=F.col("glue_db_name"), job_name=F.col("glue_job_name"),
        log_stream=F.col("log_stream"),
    )
    sections = F.array(
        F.when(F.col("failed") > 0, FAILED), F.when(late_success(), RETRIED)
    )
    return joined.select(
        *ENTRY,
        F.explode(F.array_compact(sections)).alias("section"),
        X.run_comment(url, F.col("error_message")).alias("line"),
    ).distinct()


def standing_comments(health: DataFrame) -> DataFrame:
    """The fixed lines a resource's health calls for."""
    line = F.struct
    lines = F.array(
        F.when(F.col("errors") > 0, line(F.lit(FAILED_HEAD).alias("section"),
                                         F.lit("Some runs have failed:").alias("line"))),
        F.when(F.col("insufficient_runs"), line(
            F.lit(TOO_FEW).alias("section"),
            X.insufficient_runs_comment(F.col("executions"), F.col("minimum_number_of_runs")).alias("line"),
        )),
        F.when(F.col("has_failed_attempts"), line(
            F.lit(RETRY_HEAD).alias("section"),
            F.lit("WARNING: Some runs have succeeded after one or more retry attempts:").alias("line"),
        )),
        F.when(F.col("has_sla_breach"), line(
            F.lit(SLA).alias("section"), X.sla_comment(F.col("sla_seconds")).alias("line"),
        )),
    )
    return health.select(*ENTRY, F.explode(F.array_compact(lines)).alias("l")).select(
        *ENTRY, "l.section", "l.line"
    )


def comment_lines(health: DataFrame, noted: DataFrame) -> DataFrame:
    """All comment lines of each resource as rows, ordered inside it by (section, line)."""
    return noted.select(*ENTRY, "section", "line").unionByName(standing_comments(health))


#: Comment lines that one text joins at most.
JOINED_LINES = 100


def comments(lines: DataFrame) -> DataFrame:
    """Comment texts per resource: its lines in order, joined by `<br/>`, in pieces of bounded size from 0."""
    numbered = pieces(lines, ENTRY, ["section", "line"], JOINED_LINES)
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "line")))["line"]
    return numbered.groupBy(*ENTRY, "piece").agg(F.array_join(ordered, "<br/>").alias("comments"))


def group_summary(health: DataFrame) -> DataFrame:
    """Totals and status per monitoring group and type."""
    totals = health.groupBy("group_name", "resource_type").agg(
        F.sum("executions").alias("total_executions"),
        F.sum("success").alias("total_success"),
        F.sum(F.col("errors") + F.col("insufficient_runs").cast("bigint")).alias("total_failures"),
        F.sum("warnings").alias("total_warnings"),
    )
    return totals.withColumns(
        {
            "status": X.group_status(F.col("total_failures"), F.col("total_warnings")),
            "service_name": X.display_name(F.col("resource_type")),
        }
    )


# --- catalogs -------------------------------------------------------------------------

CATALOG_MEASURES = [
    "tables_count", "partitions_count", "indexes_count", "tables_added", "partitions_added",
    "indexes_added",
]


def catalog_health(deltas: DataFrame, config: DataFrame, match_env: bool = True) -> DataFrame:
    """Counts and changes of every configured database, 0 where nothing was seen."""
    entries = _config(config).filter(F.col("resource_type") == C.GLUE_CATALOGS)
    totals = _with_config(deltas, entries, match_env).groupBy(*ENTRY).agg(
        *[F.sum(m).alias(m) for m in CATALOG_MEASURES]
    )
    health = attach_runs(entries, totals, CATALOG_MEASURES).select(*ENTRY, *CATALOG_MEASURES)
    deltas_ = [F.col(m) for m in CATALOG_MEASURES[3:]]
    return health.withColumns(
        {"status": X.catalog_status(*deltas_), "comments": X.catalog_comments(*deltas_)}
    )


def catalog_summary(health: DataFrame) -> DataFrame:
    """Six totals and status per monitoring group."""
    totals = health.groupBy("group_name", "resource_type").agg(
        *[F.sum(m).alias(f"total_{m}") for m in CATALOG_MEASURES]
    )
    added = [F.col(f"total_{m}") for m in CATALOG_MEASURES[3:]]
    return totals.withColumns(
        {
            "status": X.catalog_status(*added),
            "service_name": X.display_name(F.col("resource_type")),
        }
    )


# Extension point: catalogs aggregate their own way, all other types share one.
AGGREGATORS: dict[str, Callable[..., DataFrame]] = {
    kind: catalog_health if kind == C.GLUE_CATALOGS else resource_health
    for kind in C.RESOURCE_TYPES
}


def aggregate_health(resource_type: str, runs: DataFrame, config: DataFrame) -> DataFrame:
    """Health of one type's configured resources; an unknown type is an error."""
    if resource_type not in AGGREGATORS:
        raise ValueError(f"no aggregator registered for resource type {resource_type}")
    return AGGREGATORS[resource_type](
        runs, config.filter(F.col("resource_type") == resource_type)
    )
