"""Session defaults and shared-folder lookup."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "fleetgauge", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the package counts on (UTC above all)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset in a single-machine session, as in tests, is a temporary folder
    made, once per application; on a cluster executors would not see it, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="fleetgauge-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Work a small derived table out once: write it to the shared folder and read it back.

    Whatever joins it then sees its true size and does not repeat the work behind it, also
    when an executor is lost.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows up to which a side is sent to every executor; the driver holds them as well.
MAX_SENT_BYTES = 16 << 20
#: Estimates up to this are taken as they are. Beyond, rows are counted: files of repeated values are many times
#: smaller than their rows, and what is exploded from them has Spark's estimate of the files.
TRUSTED_BYTES = 2 << 20


def estimated_bytes(df: DataFrame) -> int:
    """What Spark makes of a table's size before running it: from the bytes of its files, joins as products."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def counted_bytes(df: DataFrame) -> int:
    """The size of a table's rows as texts, which is about that in memory; one job."""
    row = F.to_json(F.struct(*[df[c] for c in df.columns]))
    return df.agg(F.sum(F.octet_length(row))).first()[0] or 0


def is_small(df: DataFrame, max_bytes: int = MAX_SENT_BYTES) -> bool:
    """Whether a table may be sent to every executor. Only where the estimate cannot tell, its rows are counted."""
    guess = estimated_bytes(df)
    return guess <= max_bytes and (guess <= TRUSTED_BYTES or counted_bytes(df) <= max_bytes)


def never_sent(df: DataFrame) -> DataFrame:
    """A side whose size nothing bounds: it is sorted and merged, whatever Spark takes its size to be from files."""
    return df.hint("merge")


def bounded_broadcast(df: DataFrame, max_bytes: int = MAX_SENT_BYTES) -> DataFrame:
    """Hint a broadcast only where the side is small enough, in bytes of rows; where files make it look so, forbid one.

    A side that is estimated to be large is returned without a hint: the join is then an ordinary shuffled one, with
    adaptive skew handling, that adaptive execution may still turn round once the true size is known.
    """
    if estimated_bytes(df) > max_bytes:
        return df
    return F.broadcast(df) if is_small(df, max_bytes) else never_sent(df)
