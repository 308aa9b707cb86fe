"""From landed run records to metrics tables and derived events (J1, J2)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions.timefn import moment
from fleetgauge.operators.logs import sessionise
from fleetgauge.operators.matching import with_account
from fleetgauge.operators.normalise import NORMALISERS, catalog_counts, normalise
from fleetgauge.operators.progress import (
    dq_results_for, earliest_since, log_started_after, since_times, started_after, writable_floor,
)
from fleetgauge.session import bounded_broadcast, settle
from fleetgauge.sources.commits import Pass
from fleetgauge.sources.events import publish_events, to_events
from fleetgauge.sources.tables import commit_metrics, is_empty, key_columns, missing_keys, stage_metrics, stored_last_times, stored_near

# Columns of the raw records: resource name and start.
RAW_KEYS = {
    C.GLUE_JOBS: ("JobName", "StartedOn"),
    C.GLUE_WORKFLOWS: ("Name", "StartedOn"),
    C.GLUE_CRAWLERS: ("CrawlerName", "StartTime"),
    C.GLUE_DATA_QUALITY: ("RulesetName", "StartedOn"),
    C.STEP_FUNCTIONS: ("resource_name", "startDate"),
    C.EMR_SERVERLESS: ("resource_name", "createdAt"),
    C.LAMBDA_FUNCTIONS: ("function_name", "ts"),
}


def to_collect(
    runs: DataFrame, resource_type: str, since: DataFrame, now: datetime, strict: bool = False
) -> DataFrame:
    """Records of configured resources that may be new.

    Strict takes what began after the last stored start. The default looks back over the
    whole writable time instead, since a long run may end after a later one was stored; known
    runs are then left out when writing.
    """
    name, start = RAW_KEYS[resource_type]
    bounds = since.filter(F.col("resource_type") == resource_type)
    if not strict:
        bounds = bounds.withColumn("since_time", moment(writable_floor(now)))
    bounds = bounds.select("resource_name", "since_time").distinct()
    if resource_type == C.LAMBDA_FUNCTIONS:
        return log_started_after(runs, bounds, name)
    named = bounds.withColumnRenamed("resource_name", name)
    return started_after(runs, named, start, [name])


@dataclass(frozen=True)
class Scope:
    """What a pass collects: resources, their since-times, the time of the pass."""

    wanted: DataFrame
    since: DataFrame
    now: datetime
    strict: bool

    def names(self, resource_type: str) -> DataFrame:
        return self.wanted.filter(F.col("resource_type") == resource_type).select("resource_name")


def gather_runs(records: DataFrame, kind: str, scope: Scope) -> DataFrame:
    """Records of configured resources that may be new."""
    return to_collect(records, kind, scope.since, scope.now, scope.strict)


def gather_invocations(log: DataFrame, kind: str, scope: Scope) -> DataFrame:
    """Closed invocations of configured functions."""
    return sessionise(gather_runs(log, kind, scope))


def gather_dq_results(records: DataFrame | tuple[DataFrame, DataFrame], kind: str, scope: Scope) -> DataFrame:
    """Results of configured rulesets; with a listing of results (ResultId, StartedOn) only those on it.

    As the listing is asked once for all rulesets, it is read from the earliest time any of them needs.
    """
    if isinstance(records, DataFrame):
        return gather_runs(records, kind, scope)
    results, listing = records
    floor = writable_floor(scope.now)
    last = scope.since.filter(F.col("resource_type") == kind).select("resource_name", F.col("since_time").alias("last_update_time"))
    asked = earliest_since(scope.names(kind), last, floor).first()["since_time"] if scope.strict else floor
    listed = listing.filter(F.col("StartedOn") > moment(asked))
    return gather_runs(dq_results_for(results, listed), kind, scope)


def gather_catalogs(listings: tuple[DataFrame, ...], kind: str, scope: Scope) -> DataFrame:
    """Counts of the configured catalogs at the time of the pass."""
    databases, *parts = listings
    named = scope.names(kind).withColumnRenamed("resource_name", "DatabaseName")
    return catalog_counts(databases.join(named, "DatabaseName", "left_semi"), *parts).withColumn("taken_on", moment(scope.now))


# Extension point: types whose landed records are not one run a row.
GATHERERS: dict[str, Callable[..., DataFrame]] = {
    C.LAMBDA_FUNCTIONS: gather_invocations,
    C.GLUE_DATA_QUALITY: gather_dq_results,
    C.GLUE_CATALOGS: gather_catalogs,
}


def collect(
    spark: SparkSession,
    raw: dict[str, DataFrame | tuple[DataFrame, ...]],
    base: str,
    config: DataFrame,
    environments: DataFrame,
    events_path: str | None,
    now: datetime,
    strict: bool = False,
    storage: str = "parquet",
) -> None:
    """Bring every type's table up to date, all groups and environments in one pass each.

    `raw` holds flat records per type (function logs under `lambda_functions`; for data quality
    optionally results and their listing; for catalogs the four listings that are counted, of which a
    pass takes a snapshot at `now`); `config` the resources to collect. Finished workflow and function
    runs are published as events. Records and events of a pass become visible together
    (`sources.commits`): a pass that failed is ended or thrown away by the next one.
    """
    for kind in raw:
        if kind not in NORMALISERS:
            raise ValueError(f"no normaliser registered for resource type {kind}")
    step = Pass(spark, base)
    wanted = config.select("resource_type", F.col("name").alias("resource_name")).distinct()
    if strict:
        since = since_times(wanted, stored_last_times(spark, base, storage), now)
    else:
        since = wanted.withColumn("since_time", moment(writable_floor(now)))
    # Bounds and new records are read several times: each is worked out once.
    scope = Scope(wanted, settle(since, "since"), now, strict)
    for kind, records in raw.items():
        fresh = settle(GATHERERS.get(kind, gather_runs)(records, kind, scope), f"fresh-{kind}")
        if events_path is not None and kind in EVENT_KEYS:
            new = fresh if strict else _not_stored(spark, fresh, kind, base, storage)
            events = to_events(with_account(new, environments), kind)
            publish_events(events, step.stage(f"events-{kind}", events_path))
        stage_metrics(normalise(kind, fresh), step, kind, storage=storage)
    commit_metrics(step, storage)


#: Run id, start and name in the raw records of types whose runs are published as events.
EVENT_KEYS = {
    C.GLUE_WORKFLOWS: ("WorkflowRunId", "StartedOn", "Name"),
    C.LAMBDA_FUNCTIONS: ("request_id", "started_on", "function_name"),
}


def _not_stored(spark: SparkSession, fresh: DataFrame, kind: str, base: str, storage: str = "parquet") -> DataFrame:
    """Runs without a stored record yet, so that no run is published twice.

    Reads the stored dates between the first and the last new run only.
    """
    run_id, start, name = EVENT_KEYS[kind]
    keys = key_columns(kind)
    keyed = fresh.select(
        "*", F.struct(
            "monitored_environment", F.col(name).alias("resource_name"), F.col(run_id).alias(C.RUN_ID[kind]),
            F.timestamp_millis(F.unix_millis(start)).alias("time"),
        ).alias("_key"),
    )
    stored = stored_near(spark, base, kind, keyed.select("_key.*"), storage)
    if stored is None or is_empty(stored):
        return fresh
    # Compared null-safe and on the whole key: a run without an id is known as well. Keys alone move.
    missing = bounded_broadcast(missing_keys(keyed.select("_key.*"), stored, kind).select(F.struct(*keys).alias("_missing")))
    same = reduce(lambda a, b: a & b, [F.col("_key")[k].eqNullSafe(F.col("_missing")[k]) for k in keys])
    return keyed.join(missing, same, "left_semi").drop("_key")
