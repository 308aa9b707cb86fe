"""Function logs as a stream.

A batch of new lines is put together with the lines of invocations that were still open
and sessionised like any log; what stays open is written for the next batch. The open lines
live in a table below the shared folder, in two versions that batches write in turn, so a
repeated batch finds what it needs and no older version stays. Lines expire once they lie
further behind the newest line of their own stream than the store takes records, or once their stream
has been silent for that long, so the table holds a bounded time and a wrong clock in one stream
changes nothing in others.
State is plain rows: a stream with a large share of the lines is split over slices exactly as
in a batch run.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetgauge import constants as C
from fleetgauge import schemas
from fleetgauge.functions.timefn import moment
from fleetgauge.operators.logs import OWNER, SLICE_MINUTES, _attempts, _invocations, still_open, with_active_request
from fleetgauge.streaming.alerts import run_once


def _open_lines(spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    """Open lines the batch before left, and when their stream last had a line."""
    schema = schemas.ddl(schemas.LOG_DDL).add("revives", "boolean").add("seen_on", "timestamp")
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_version(state, batch_id - 1))


def _version(state: str, batch_id: int) -> str:
    """Where a batch leaves its open lines: the place of the batch before the last one."""
    return f"{state}/version={batch_id % 2}"


def _unexpired(opened: DataFrame, fresh: DataFrame, before: DataFrame, now: datetime, keep_hours: int) -> DataFrame:
    """Open lines that may still be closed in time, with when their stream last had a line.

    Each stream has a clock of its own, its newest line; a stream that has fallen silent is given up
    so many hours after its last line came in, whatever that line says.
    """
    streams = (
        fresh.select(*OWNER, "ts", moment(now).alias("seen_on"))
        .unionByName(before.select(*OWNER, "ts", "seen_on"))
        .groupBy(*OWNER)
        .agg(F.max(F.unix_micros("ts")).alias("newest"), F.max("seen_on").alias("seen_on"))
    )
    kept = opened.join(streams, OWNER)
    return kept.filter(
        (F.unix_micros("ts") >= F.col("newest") - keep_hours * 3_600_000_000)
        & (F.col("seen_on") >= moment(now - timedelta(hours=keep_hours)))
    ).drop("newest")


def sessionise_step(
    lines: DataFrame, state: str, batch_id: int, slice_minutes: int = SLICE_MINUTES,
    keep_hours: int = C.WRITABLE_HOURS, now: datetime | None = None,
) -> DataFrame:
    """Invocations closed by a batch of lines; leaves the open ones for the next batch.

    A START that is still open `keep_hours` after it in its stream, or in a stream without a line for
    that long, is given up: its record would be too old to be stored. `now` is when the batch came in.
    """
    spark = lines.sparkSession
    fresh = lines.select(
        *[f.name for f in schemas.ddl(schemas.LOG_DDL)], F.lit(True).alias("revives")
    )
    before = _open_lines(spark, state, batch_id)
    owned = with_active_request(fresh.unionByName(before.drop("seen_on")), slice_minutes)
    opened = _unexpired(still_open(owned), fresh, before, now or datetime.now(timezone.utc), keep_hours)
    opened.write.mode("overwrite").parquet(_version(state, batch_id))
    return _invocations(_attempts(owned))


def sessionise_stream(
    log: DataFrame, out: str, checkpoint: str, state: str | None = None,
    slice_minutes: int = SLICE_MINUTES, keep_hours: int = C.WRITABLE_HOURS,
) -> StreamingQuery:
    """Follow a log (columns of `schemas.LOG_DDL`) and write closed invocations.

    `state` belongs to the checkpoint: keep the two together. Unless given it lies beside it.
    """
    folder = state or f"{checkpoint.rstrip('/')}-open-lines"

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            closed = sessionise_step(batch, folder, batch_id, slice_minutes, keep_hours)
            closed.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return run_once(log.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint))
