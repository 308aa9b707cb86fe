"""Where queries are registered: a Spark function of the views, and the SQL to match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.session import bounded_broadcast, settle
from workbench.sql_views import with_views
from workbench.views import Views

SPARK: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    """Register a query once."""
    if name in SPARK:
        raise ValueError(f"query {name} is registered twice")
    SPARK[name] = run
    if sql is not None:
        SQL[name] = with_views(sql)


def ms(df: DataFrame, *columns: str) -> DataFrame:
    """Show timestamps as epoch milliseconds, which every engine prints alike."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({n: F.unix_millis(n) for n in names})


def joined(df: DataFrame, *columns: str, sep: str = ",") -> DataFrame:
    """Show lists of texts as one text."""
    return df.withColumns({n: F.array_join(n, sep) for n in columns})


def in_emitted_order(df: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """Mark rows that come no earlier than the row emitted before them in their group.

    Numbers follow the order in which the rows were given out. Without a group the row before is
    looked for inside the partition, and the first row of each partition against the partition
    before it.
    """
    now = F.struct(*keys)
    given = settle(df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "given")
    if group:
        last = F.lag(now).over(Window.partitionBy(*group).orderBy("_at"))
        return given.withColumn("in_order", F.coalesce(now >= last, F.lit(True))).drop("_at", "_part")
    # Only keys move; rows out of order, normally none, are looked up where the rows lie.
    places = given.select("_at", "_part", *keys)
    last = F.lag(now).over(Window.partitionBy("_part").orderBy("_at"))
    # One row per partition: the highest key of all partitions before it.
    ends = given.groupBy("_part").agg(F.max(now).alias("_end")).select(
        "_part", F.max("_end").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_end"))
    late = settle(
        places.withColumn("_last", last).join(F.broadcast(ends), "_part").filter(~F.coalesce(now >= F.coalesce("_last", "_end"), F.lit(True)))
        .select("_at", F.lit(True).alias("_late")),
        "late",
    )
    return given.join(bounded_broadcast(late), "_at", "left").withColumn("in_order", F.col("_late").isNull()).drop("_at", "_part", "_late")
