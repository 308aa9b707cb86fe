"""Text columns: truncation, labels, statuses, comment and subject texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge import constants as C


def truncate(col: Column, n: int) -> Column:
    """First n characters and an ellipsis when longer; NULL stays NULL."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def name_from_arn(col: Column) -> Column:
    """The part after `stateMachine:`; NULL when the marker is missing."""
    return F.try_element_at(F.split(col, "stateMachine:"), F.lit(2))


def display_name(resource_type: Column) -> Column:
    """Report name of a resource type."""
    pairs = [F.lit(x) for item in C.DISPLAY_NAMES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), resource_type)


def type_ordinal(resource_type: Column) -> Column:
    """Position of a resource type in report order, from 1."""
    return F.array_position(F.array(*[F.lit(t) for t in C.RESOURCE_TYPES]), resource_type)


def signed(col: Column) -> Column:
    """`+ n`, `+ 0` or `-n`; NULL falls through to the plain cast, so stays NULL."""
    text = col.cast("string")
    return (
        F.when(col > 0, F.concat(F.lit("+ "), text)).when(col == 0, F.lit("+ 0")).otherwise(text)
    )


def subject(env: Column, state: Column, resource_type: Column, name: Column) -> Column:
    """`env: state - type : name`. An unknown environment shows as None."""
    return F.concat(
        F.coalesce(env, F.lit("None")), F.lit(": "), state, F.lit(" - "),
        resource_type, F.lit(" : "), name,
    )


def resource_status(errors: Column, insufficient: Column, warnings: Column) -> Column:
    """error if anything failed or too few runs, else warning, else ok."""
    return (
        F.when((errors > 0) | insufficient, C.ERROR).when(warnings > 0, C.WARNING).otherwise(C.OK)
    )


def group_status(failures: Column, warnings: Column) -> Column:
    """error, warning or ok for a monitoring group."""
    return F.when(failures > 0, C.ERROR).when(warnings > 0, C.WARNING).otherwise(C.OK)


def catalog_status(tables: Column, partitions: Column, indexes: Column) -> Column:
    """warning if anything was deleted, else no status."""
    return F.when((tables < 0) | (partitions < 0) | (indexes < 0), C.WARNING).otherwise(C.NO_STATUS)


def catalog_comments(tables: Column, partitions: Column, indexes: Column) -> Column:
    """The deletion warnings that apply, joined by `<br/>`."""
    lines = [
        F.when(delta < 0, F.lit(f"WARNING: Some Glue Data Catalog {what} have been deleted."))
        for delta, what in ((tables, "Tables"), (partitions, "Partitions"), (indexes, "Indexes"))
    ]
    return F.array_join(F.array(*lines), "<br/>")


def insufficient_runs_comment(executions: Column, min_runs: Column) -> Column:
    """The line shown when a resource ran less often than asked."""
    return F.format_string(
        "Insufficient runs: %d run(s) during the monitoring period (at least %d expected).",
        executions, min_runs,
    )


def sla_comment(sla: Column) -> Column:
    """The line shown when a run took longer than its SLA."""
    return F.format_string("WARNING: Some runs haven't met SLA (=%d sec).", sla)


def run_comment(url: Column, error_message: Column) -> Column:
    """One failed run as a linked line."""
    return F.concat(
        F.lit(" - <a href='"), F.coalesce(url, F.lit("")), F.lit("'> ERROR: "),
        truncate(F.coalesce(error_message, F.lit("")), C.ERROR_CHARS), F.lit("</a>"),
    )


def digest_subject(day: Column) -> Column:
    """`Digest Report yyyy-MM-dd`."""
    return F.concat(F.lit("Digest Report "), F.date_format(day, "yyyy-MM-dd"))


def period_text(start: Column, end: Column) -> Column:
    """The sentence naming the reported period."""
    fmt = "MMMM dd, yyyy hh:mm a"
    return F.concat(
        F.lit("This report has been generated for the period from "), F.date_format(start, fmt),
        F.lit(" to "), F.date_format(end, fmt), F.lit("."),
    )
