"""Alerting as a stream, and the alert timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetgauge import schemas
from fleetgauge.operators.classify import event_errors
from fleetgauge.operators.explore import alerts_timeline
from fleetgauge.plans.alerting import (
    AlertConfig, alert_events, alert_log, classified, laid_deliveries, matches_for, numbered_notifications,
)
from fleetgauge.session import settle
from fleetgauge.sources.events import read_events
from fleetgauge.sources.sinks import counters_before, write_alert_log, write_event_errors, write_notifications


def run_once(writer) -> StreamingQuery:
    """Start a stream that takes what is there and stops; an outside timer repeats it."""
    return writer.trigger(availableNow=True).start()


def run_alerts(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    config: AlertConfig,
    max_files: int = 1000,
) -> StreamingQuery:
    """Follow event files and write alert log, outbox and unmapped events."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        known = classified(batch, config).persist()
        held = [known]
        try:
            # Small and used several times: worked out once, its size is then known without counting.
            matches = settle(matches_for(known, config), "matches")
            alerts = alert_events(known, matches)
            write_alert_log(alert_log(alerts), out, batch_id)
            deliveries = laid_deliveries(matches, config).persist()
            held.append(deliveries)
            before = counters_before(spark, out, batch_id)
            write_notifications(numbered_notifications(alerts, matches, deliveries, before), before, out, batch_id)
            write_event_errors(event_errors(known), out, batch_id)
        finally:
            for df in held:
                df.unpersist()

    events = read_events(spark, source, streaming=True, prefix=config.prefix, max_files=max_files)
    return run_once(
        events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    )


def late_bound(stream: DataFrame, time: str = "time", bound: str = "24 hours") -> DataFrame:
    """Drop what comes later than the store would still take."""
    return stream.withWatermark(time, bound)


def stream_timeline(
    spark: SparkSession, alert_log_path: str, minutes: int = 5, bound: str = "24 hours"
) -> DataFrame:
    """Alerts per time bin, following the alert log; a bin is final once the bound passes."""
    log = (
        spark.readStream.schema(schemas.ALERT_LOG_DDL + ", date DATE, batch_id BIGINT")
        .parquet(alert_log_path)
    )
    return alerts_timeline(late_bound(log, "event_time", bound), minutes)


def unique_records(stream: DataFrame, keys: list[str], bound: str = "24 hours") -> DataFrame:
    """Each record once, remembering keys as long as it may be repeated."""
    return late_bound(stream, "time", bound).dropDuplicatesWithinWatermark(keys)
