"""How far collection has come, and what is new since."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions.timefn import moment
from fleetgauge.session import bounded_broadcast

RESOURCE = ["resource_type", "resource_name"]


def union_types(parts: list[DataFrame]) -> DataFrame:
    """All parts as one table, by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def last_update_times(metrics_by_type: dict[str, DataFrame]) -> DataFrame:
    """Latest stored time per resource of every type; empty tables just add nothing.

    The types are put together before grouping, so all of them share one small shuffle.
    """
    slim = [
        df.select(F.lit(kind).alias("resource_type"), "resource_name", "time")
        for kind, df in metrics_by_type.items()
    ]
    return union_types(slim).groupBy(*RESOURCE).agg(F.max("time").alias("last_update_time"))


def last_update_time(metrics: DataFrame, resource_name: str) -> DataFrame:
    """Latest stored time of one resource: one row, NULL when it has none."""
    return metrics.filter(F.col("resource_name") == resource_name).agg(
        F.max("time").alias("last_update_time")
    )


def writable_floor(now: datetime, hours: int = C.WRITABLE_HOURS) -> datetime:
    """The earliest time that may still be written."""
    return now - timedelta(hours=hours)


def since_times(
    resources: DataFrame,
    last_update: DataFrame,
    now: datetime,
    stored: DataFrame | None = None,
    hours: int = C.WRITABLE_HOURS,
) -> DataFrame:
    """Time from which each resource is to be collected.

    The given last update, else the stored maximum, else the floor; never before the floor.
    """
    floor = moment(writable_floor(now, hours))
    out = resources.join(last_update.select(*RESOURCE, "last_update_time"), RESOURCE, "left")
    known = [F.col("last_update_time")]
    if stored is not None:
        out = out.join(
            stored.select(*RESOURCE, F.col("last_update_time").alias("stored_time")), RESOURCE, "left"
        )
        known.append(F.col("stored_time"))
    return out.select(
        *resources.columns, F.greatest(F.coalesce(*known, floor), floor).alias("since_time")
    )


def earliest_since(names: DataFrame, last_update: DataFrame, floor: datetime) -> DataFrame:
    """Earliest last update over a set of resources; the floor if any has none."""
    joined = names.select("resource_name").distinct().join(
        last_update.select("resource_name", "last_update_time"), "resource_name", "left"
    )
    missing = F.count_if(F.col("last_update_time").isNull())
    return joined.agg(
        F.when((missing > 0) | (F.count(F.lit(1)) == 0), moment(floor))
        .otherwise(F.min("last_update_time"))
        .alias("since_time")
    )


def started_after(
    df: DataFrame, since: DataFrame, start: str, keys: list[str] | None = None
) -> DataFrame:
    """Rows that began strictly after their resource's since-time.

    `since` has one row per resource to collect; rows of other resources drop out. Its
    smallest time is also applied as a plain filter, so the scan can skip old files.
    """
    keys = keys or ["resource_name"]
    lowest = since.agg(F.min(F.unix_micros("since_time"))).first()[0]
    small = bounded_broadcast(since.select(*keys, "since_time"))
    recent = df.filter(F.col(start) > F.timestamp_micros(F.lit(lowest))) if lowest is not None else df
    return recent.join(small, keys).filter(F.col(start) > F.col("since_time")).drop("since_time")


def log_started_after(log: DataFrame, since: DataFrame, name: str = "function_name") -> DataFrame:
    """Log lines from one millisecond after their function's since-time on."""
    shifted = since.select(
        F.col("resource_name").alias(name),
        F.timestamp_millis(F.unix_millis("since_time") + 1).alias("from_time"),
    )
    return log.join(bounded_broadcast(shifted), name).filter(
        F.col("ts") >= F.col("from_time")
    ).drop("from_time")


def dq_results_for(results: DataFrame, ids: DataFrame, ruleset: str | None = None) -> DataFrame:
    """Results on the id list, of one ruleset when it is named."""
    kept = results if ruleset is None else results.filter(F.col("RulesetName") == ruleset)
    return kept.join(ids.select("ResultId"), "ResultId", "left_semi")
