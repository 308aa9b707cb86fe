"""Metrics tables: scan, append, retention and small look-ups."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from fleetgauge import constants as C
from fleetgauge import schemas
from fleetgauge.functions.timefn import in_utc, moment
from fleetgauge.session import bounded_broadcast, is_small, never_sent, settle
from fleetgauge.sources import commits, files

#: Kinds of storage a metrics table can be kept in: file formats Spark reads and writes with pruning.
STORAGE_KINDS = ("parquet", "orc")

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def table_path(base: str, resource_type: str) -> str:
    return f"{base.rstrip('/')}/{resource_type}_metrics"


def storage_format(kind: str) -> str:
    """The format behind a storage kind; an unknown kind is an error."""
    if kind not in STORAGE_KINDS:
        raise ValueError(f"no storage kind {kind!r}; known kinds are {', '.join(STORAGE_KINDS)}")
    return kind


def metrics(spark: SparkSession, base: str, resource_type: str, storage: str = "parquet") -> DataFrame:
    """One metrics table. A table nobody has written yet reads as empty.

    The files are partitioned by `date`; filter with `in_period`, which prunes on it.
    """
    schema = schemas.metrics_schema(resource_type).add("date", "date")
    try:
        return spark.read.schema(schema).format(storage_format(storage)).load(table_path(base, resource_type))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def in_period(df: DataFrame, start: datetime, end: datetime, time: str = "time") -> DataFrame:
    """Rows between two times, both included. Prunes date partitions when there are any."""
    kept = df.filter(F.col(time).between(moment(start), moment(end)))
    if "date" in df.columns:
        kept = kept.filter(F.col("date").between(F.lit(in_utc(start).date()), F.lit(in_utc(end).date())))
    return kept


def key_columns(resource_type: str) -> list[str]:
    """What makes a stored run unique (within its own type's table)."""
    return ["monitored_environment", "resource_name", C.RUN_ID[resource_type], "time"]


def same_key(left: str, right: str, keys: list[str]) -> Column:
    """Equal keys of two aliased tables; missing parts compare equal."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def missing_keys(new_keys: DataFrame, stored: DataFrame, resource_type: str) -> DataFrame:
    """Keys of new records that no stored record has, each once, worked out once. Missing key parts compare equal.

    Keys alone move. Where the new records are few by count, stored keys are first cut to their run ids by a broadcast.
    """
    keys, run_id = key_columns(resource_type), [C.RUN_ID[resource_type]]
    fresh, known = new_keys.select(*keys).distinct(), stored.select(*keys)
    ids = new_keys.select(*run_id).distinct()
    if is_small(ids):
        known = known.alias("s").join(F.broadcast(ids).alias("i"), same_key("s", "i", run_id), "left_semi")
    return settle(fresh.alias("n").join(never_sent(known).alias("s"), same_key("n", "s", keys), "left_anti"), "missing")


def unseen(new: DataFrame, stored: DataFrame, resource_type: str) -> DataFrame:
    """New records that are not stored yet, each once. Missing key parts compare equal.

    Which ones these are is told from the keys; known records do not move.
    """
    keys = key_columns(resource_type)
    if is_empty(stored):
        return new.dropDuplicates(keys)
    missing = missing_keys(new, stored, resource_type)
    return new.alias("n").join(bounded_broadcast(missing).alias("m"), same_key("n", "m", keys), "left_semi").dropDuplicates(keys)


def stored_near(spark: SparkSession, base: str, resource_type: str, new: DataFrame, storage: str = "parquet") -> DataFrame | None:
    """Stored records on the dates that the new ones (column `time`) touch; None if there are no new ones."""
    micros = F.unix_micros("time")
    span = new.agg(F.min(micros), F.max(micros)).first()
    if span[0] is None:
        return None
    first, last = (EPOCH + timedelta(microseconds=m) for m in span)
    return in_period(metrics(spark, base, resource_type, storage), first, last)


def stored_last_times(spark: SparkSession, base: str, storage: str = "parquet") -> DataFrame:
    """Last stored time of every resource: the marks of the newest pass, else from the tables once."""
    known = commits.marks(spark, base)
    if known is not None:
        return known
    slim = [
        metrics(spark, base, kind, storage).select(F.lit(kind).alias("resource_type"), "resource_name", "time") for kind in C.RESOURCE_TYPES
    ]
    return reduce(DataFrame.unionByName, slim).groupBy("resource_type", "resource_name").agg(F.max("time").alias("last_update_time"))


def stage_metrics(
    df: DataFrame, step: commits.Pass, resource_type: str, dedupe: bool = True, storage: str = "parquet"
) -> None:
    """Write records aside that the pass will append to their table, leaving out those already there.

    Only the stored dates the new records touch are read back. The rebalance hint spreads a
    hot date over several files and packs small ones together, so neither a busy day nor
    many quiet ones makes one slow task.
    """
    path = step.stage(f"metrics-{resource_type}", table_path(step.base, resource_type))
    new = df.select(*schemas.metrics_schema(resource_type).fieldNames())
    if dedupe:
        stored = stored_near(df.sparkSession, step.base, resource_type, new, storage)
        if stored is None:
            return
        new = unseen(new, stored, resource_type)
    dated = new.withColumn("date", F.to_date("time"))
    dated.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").format(storage_format(storage)).save(path)


def commit_metrics(step: commits.Pass, storage: str = "parquet") -> None:
    """Make a pass visible; its high-water marks are the ones before, raised by what it adds."""
    spark, raised = step.spark, stored_last_times(step.spark, step.base, storage)
    for label in [x for x in step.targets if x.startswith("metrics-") and step.staged(x)]:
        kind = label.removeprefix("metrics-")
        added = spark.read.schema(schemas.metrics_schema(kind)).format(storage_format(storage)).load(f"{step.folder}/{label}")
        new = added.groupBy("resource_name").agg(F.max("time").alias("last_update_time"))
        raised = commits.merged(raised, new.withColumn("resource_type", F.lit(kind)))
    step.commit(raised)


def write_metrics(
    df: DataFrame, base: str, resource_type: str, dedupe: bool = True, storage: str = "parquet"
) -> None:
    """Append records to the type's table in a pass of their own, leaving out those already there."""
    step = commits.Pass(df.sparkSession, base)
    stage_metrics(df, step, resource_type, dedupe, storage)
    commit_metrics(step, storage)


def prune(df: DataFrame, now: datetime, days: int = C.RETENTION_DAYS) -> DataFrame:
    """Rows still inside the retention time."""
    floor = now - timedelta(days=days)
    kept = df.filter(F.col("time") >= moment(floor))
    return kept.filter(F.col("date") >= F.lit(in_utc(floor).date())) if "date" in df.columns else kept


def drop_expired(
    spark: SparkSession, base: str, now: datetime, days: int = C.RETENTION_DAYS, grace_days: int = 1
) -> list[str]:
    """Remove folders of dates that lie wholly behind the retention time; returns what went.

    Readers that `prune` at `now` plan none of these folders, and `grace_days` more stay for
    those that planned a while ago. An expired folder first leaves its table in one move, so that no
    listing sees half of it, and its files go afterwards; what an earlier run left behind in
    between goes as well. Repeating it does no harm.
    """
    floor = in_utc(now - timedelta(days=days + grace_days)).date()
    bin_ = f"{base.rstrip('/')}/_expired"
    gone = []
    for kind in C.RESOURCE_TYPES:
        for name, is_folder, _ in files.children(spark, table_path(base, kind)):
            if is_folder and name.startswith("date=") and name[5:] < floor.isoformat():
                files.move(spark, f"{table_path(base, kind)}/{name}", f"{bin_}/{kind}-{name}")
                gone.append(f"{kind}/{name}")
    files.remove(spark, bin_)
    return gone


def accept_writes(df: DataFrame, now: datetime, hours: int = C.WRITABLE_HOURS) -> DataFrame:
    """Rows recent enough to be written."""
    return df.filter(F.col("time") >= moment(now - timedelta(hours=hours)))


def is_empty(df: DataFrame) -> bool:
    """Whether a table has no row (reads at most one)."""
    return df.isEmpty()


def scalar(df: DataFrame):
    """First column of the first row; None when there is no row."""
    row = df.first()
    return row[0] if row is not None else None
