"""Alert log and notification outbox.

Each write has its own folder per batch id and replaces it, so repeating a batch after a
lost executor or a restart leaves one copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.sources.files import exists


def _batch_path(base: str, table: str, batch_id: int) -> str:
    return f"{base.rstrip('/')}/{table}/batch_id={batch_id}"


def write_alert_log(alerts: DataFrame, base: str, batch_id: int) -> None:
    """Alert rows, by event date."""
    alerts.withColumn("date", F.to_date("event_time")).write.mode("overwrite").partitionBy(
        "date"
    ).parquet(_batch_path(base, "alert_log", batch_id))


def ordered_outbox(notifications: DataFrame) -> DataFrame:
    """Messages in delivery order: by message group, then time.

    Ranges over both, so one group with very many messages is cut into consecutive pieces
    instead of landing in one task; reading the pieces in order gives the group in order.
    """
    order = ["message_group_id", "event_time", "message_key"]
    return notifications.repartitionByRange(*order).sortWithinPartitions(*order)


COUNTERS_DDL = "message_group_id string, last_number bigint"


def _counters_path(base: str, batch_id: int) -> str:
    """Where a batch leaves the counters: the place of the batch before the last one."""
    return f"{base.rstrip('/')}/outbox_counters/version={batch_id % 2}"


def counters_before(spark: SparkSession, base: str, batch_id: int) -> DataFrame:
    """The last number of each message group (message_group_id, last_number) before a batch."""
    if batch_id > 0 and exists(spark, _counters_path(base, batch_id - 1)):
        return spark.read.schema(COUNTERS_DDL).parquet(_counters_path(base, batch_id - 1))
    return spark.createDataFrame([], COUNTERS_DDL)


def write_notifications(numbered: DataFrame, before: DataFrame, base: str, batch_id: int) -> None:
    """Messages of one batch, numbered inside their groups on from the batch before, and the counters after it.

    The counters lie beside the outbox in two versions that batches write in turn, after
    their messages: a repeated batch starts from the counters of the batch before it and gives the
    same numbers. Readers sort a group by its number over all batches; there is no gap in it.
    """
    spark = numbered.sparkSession
    path = _batch_path(base, "outbox", batch_id)
    numbered.write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path).select("message_group_id", F.col("sequence_number").alias("last_number"))
    counters = before.unionByName(written).groupBy("message_group_id").agg(F.max("last_number").alias("last_number"))
    counters.write.mode("overwrite").parquet(_counters_path(base, batch_id))


def write_event_errors(errors: DataFrame, base: str, batch_id: int) -> None:
    """Events that could not be mapped."""
    errors.write.mode("overwrite").parquet(_batch_path(base, "event_errors", batch_id))
