"""From events to alert rows and notifications (J3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.operators.classify import (
    classify_events, event_errors, mapped, origin, resolve_type, with_flags, with_message,
)
from fleetgauge.operators.matching import (
    delivery_options, in_scope, match_groups, with_environment,
)
from fleetgauge.operators.ordinals import reserved
from fleetgauge.session import bounded_broadcast, estimated_bytes, settle
from fleetgauge.sources.events import event_types


@dataclass
class AlertConfig:
    """The tables alerting joins with."""

    environments: DataFrame
    monitored: DataFrame
    recipients: DataFrame
    delivery_methods: DataFrame
    apps: DataFrame | None = None
    emr_runs: DataFrame | None = None
    prefix: str = C.DEFAULT_EVENT_PREFIX
    match_env: bool = False


def classified(events: DataFrame, config: AlertConfig) -> DataFrame:
    """Typed and classified events with their environment's name, broken ones included."""
    types = event_types(events.sparkSession, config.prefix)
    known = classify_events(resolve_type(events, types), config.apps, config.emr_runs)
    account, region = origin()
    return with_environment(known, config.environments, account, region)


def alert_events(known: DataFrame, matches: DataFrame) -> DataFrame:
    """Classified events of monitored resources that failed or succeeded."""
    told = with_flags(mapped(known)).filter(F.col("is_monitorable"))
    return in_scope(told, matches)


def alert_log(alerts: DataFrame) -> DataFrame:
    """Alert log rows."""
    return alerts.select(
        "event_time", "monitored_environment", "resource_name", "resource_type",
        F.col("state").alias("event_status"), F.col("result").alias("event_result"),
        "execution_info_url", "event",
    )


def notifications(alerts: DataFrame, matches: DataFrame, config: AlertConfig) -> DataFrame:
    """One row per failed event and delivery method, ordered inside its message group.

    Who is told is worked out once per resource, and events pick it up by an equality join.
    """
    options = delivery_options(matches, config.recipients, config.delivery_methods)
    keys = [c for c in matches.columns if c != "group_name"]
    return _told(alerts, keys).join(bounded_broadcast(options), keys).select(*_MESSAGE, _message_key())


_MESSAGE = [
    "message_group_id", "event_time", "resource_type", "resource_name", "delivery_method",
    "delivery_method_type", "part", "recipients", "message_subject", "message_body",
]


def _told(alerts: DataFrame, keys: list[str]) -> DataFrame:
    """Failed events with what their messages say; a key stands for the event's text."""
    group = F.substring("resource_name", 1, C.GROUP_ID_CHARS).alias("message_group_id")
    return with_message(alerts.filter(F.col("is_alertable"))).select(
        *keys, group, "event_time", "message_subject", "message_body", F.xxhash64("event").alias("event_key")
    )


def _message_key() -> Column:
    return F.xxhash64("event_key", "delivery_method", "part").alias("message_key")


#: Bytes of settled matches whose deliveries one task holds; in recipients these are some sixty times as many.
TASK_MATCHES = 64 << 10


def _tasks(matches: DataFrame) -> int:
    most = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(most, 1 + estimated_bytes(matches) // TASK_MATCHES)


def laid_deliveries(matches: DataFrame, config: AlertConfig) -> DataFrame:
    """Deliveries dealt by resource, with their `place` from 0 in it. Read twice by `numbered_notifications`: callers persist it."""
    keys = [c for c in matches.columns if c != "group_name"]
    options = delivery_options(matches, config.recipients, config.delivery_methods, _tasks(matches))
    inside = Window.partitionBy(*keys).orderBy("delivery_method", "part", "delivery_method_type")
    return options.withColumn("place", F.row_number().over(inside) - 1)


def numbered_notifications(alerts: DataFrame, matches: DataFrame, deliveries: DataFrame, last: DataFrame) -> DataFrame:
    """`notifications` with `sequence_number`: dense in each message group by time, on from its `last_number`.

    Events take as many numbers as they have deliveries, before they meet them, so that whole messages never
    move. Deliveries stay where `laid_deliveries` put them; only for events in further ranges of a large
    message group, which are tasks of their own, they are sent along. Each file has its messages in delivery order.
    """
    keys = [c for c in matches.columns if c != "group_name"]
    sizes = deliveries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    told = settle(
        reserved(_told(alerts, keys).join(sizes, keys), ["message_group_id"], ["event_time", "event_key"], "_size", last), "told"
    ).drop("_size")
    first, more = told.filter("range_of_group = 0"), told.filter("range_of_group > 0")
    sent = more.select(*keys, "range_of_group").distinct().join(deliveries, keys)
    met = first.repartition(_tasks(matches), *keys).join(deliveries, keys).select(*first.columns, *[c for c in deliveries.columns if c not in keys])
    further = more.join(sent, [*keys, "range_of_group"]).select(*met.columns)
    number = (F.col("first_number") + F.col("place")).alias("sequence_number")
    messages = met.unionByName(further).select(*_MESSAGE, _message_key(), number)
    return messages.sortWithinPartitions("message_group_id", "sequence_number")


def matches_for(known: DataFrame, config: AlertConfig) -> DataFrame:
    """Groups of the resources that classified events name."""
    named = known.filter(F.col("resource_name").isNotNull()).select(
        "resource_type", "resource_name", "monitored_environment"
    )
    return match_groups(named, config.monitored, config.match_env)


def alert_results(known: DataFrame, config: AlertConfig, matches: DataFrame) -> DataFrame:
    """Per classified event: type, link, whether it alerts and is logged, and its messages.

    One message per delivery method, with its subject and body; who gets it stands in the rows of
    `notifications`. Events of resources outside every group come out with both flags
    false, no link and no messages.
    """
    keys = [c for c in matches.columns if c != "group_name"]
    options = delivery_options(matches, config.recipients, config.delivery_methods)
    # As many entries as there are delivery methods.
    told = options.select(*keys, "delivery_method", "delivery_method_type").distinct().groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("delivery_method", "delivery_method_type"))).alias("told")
    )
    scope = matches.select(*keys).distinct().withColumn("in_scope", F.lit(True))
    found = (
        with_message(with_flags(mapped(known)))
        .join(bounded_broadcast(scope), keys, "left")
        .join(bounded_broadcast(told), keys, "left")
        .withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))
    )
    alertable = F.col("in_scope") & F.col("is_alertable")
    message = lambda o: F.struct(
        o["delivery_method"].alias("delivery_method"), o["delivery_method_type"].alias("delivery_method_type"), "message_subject", "message_body"
    )
    messages = F.transform(F.when(alertable, F.col("told")), message)
    return found.select(
        "event",
        "resource_type",
        "resource_name",
        alertable.alias("event_is_alertable"),
        (F.col("in_scope") & F.col("is_monitorable")).alias("event_is_monitorable"),
        F.when(F.col("in_scope"), F.col("execution_info_url")).otherwise("").alias("execution_info_url"),
        F.coalesce(messages, F.slice(F.array(message(F.lit(None).cast("struct<delivery_method:string,delivery_method_type:string>"))), 1, 0)).alias("messages"),
    )


__all__ = [
    "AlertConfig", "alert_events", "alert_log", "alert_results", "classified", "event_errors",
    "laid_deliveries", "matches_for", "notifications", "numbered_notifications",
]
