"""Passes: what a collection pass writes becomes visible once, whatever fails in between.

A pass first writes all of it aside: new records of every type, events, and the last times of
all resources after it. Then a manifest lists where each file goes; from that moment on the
pass counts. Files are then moved to their places under names of their own, and a mark ends
the pass. A pass that failed before its manifest left nothing to see and is thrown away; one
that failed later is brought to its end by whoever begins the next one. Moving a file that has
been moved does nothing, so no record and no event comes twice.

The log keeps the newest finished pass: its last times are the high-water marks that the next
pass reads instead of the tables. One collector writes to a store at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.sources import files

LOG = "_passes"
PREPARED, DONE = "_PREPARED", "_DONE"
MARKS = "last_times"
MARKS_DDL = "resource_type string, resource_name string, last_update_time timestamp"


def _folder(base: str, number: int) -> str:
    return f"{base.rstrip('/')}/{LOG}/{number:012d}"


def numbers(spark: SparkSession, base: str) -> list[int]:
    """Passes of the log, oldest first."""
    return [int(name) for name, is_folder, _ in files.children(spark, f"{base.rstrip('/')}/{LOG}") if is_folder and name.isdigit()]


def marks(spark: SparkSession, base: str) -> DataFrame | None:
    """Last stored time of every resource as the newest pass left it; None in a store without passes."""
    for number in reversed(numbers(spark, base)):
        folder = _folder(base, number)
        if files.exists(spark, f"{folder}/{PREPARED}"):
            return spark.read.schema(MARKS_DDL).parquet(f"{folder}/{MARKS}")
    return None


def _finish(spark: SparkSession, folder: str) -> None:
    """Move what the manifest lists and end the pass."""
    for source, target in json.loads(files.read_text(spark, f"{folder}/{PREPARED}")):
        files.move(spark, source, target)
    files.write_text(spark, f"{folder}/{DONE}", "")


def recover(spark: SparkSession, base: str) -> int:
    """End passes that have their manifest, drop the others; the number of the newest pass."""
    newest = 0
    for number in numbers(spark, base):
        folder = _folder(base, number)
        if not files.exists(spark, f"{folder}/{PREPARED}"):
            files.remove(spark, folder)
            continue
        if not files.exists(spark, f"{folder}/{DONE}"):
            _finish(spark, folder)
        newest = number
    return newest


class Pass:
    """One pass over a store."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self.number = recover(spark, self.base) + 1
        self.folder = _folder(self.base, self.number)
        self.targets: dict[str, str] = {}

    def stage(self, label: str, target: str) -> str:
        """Where to write files aside that belong into the folder `target`."""
        self.targets[label] = target.rstrip("/")
        return f"{self.folder}/{label}"

    def staged(self, label: str) -> list[str]:
        return files.files_below(self.spark, f"{self.folder}/{label}")

    def commit(self, last_times: DataFrame) -> None:
        """Make the pass count and put its files in their places."""
        last_times.select("resource_type", "resource_name", "last_update_time").write.mode("overwrite").parquet(f"{self.folder}/{MARKS}")
        moves = []
        for label, target in self.targets.items():
            for name in self.staged(label):
                inside, _, file = name.rpartition("/")
                place = f"{target}/{inside}" if inside else target
                moves.append((f"{self.folder}/{label}/{name}", f"{place}/pass-{self.number:012d}-{file}"))
        files.write_text(self.spark, f"{self.folder}/{PREPARED}", json.dumps(moves))
        _finish(self.spark, self.folder)
        for older in numbers(self.spark, self.base):
            if older < self.number:
                files.remove(self.spark, _folder(self.base, older))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The later time of both for every resource."""
    keys = ["resource_type", "resource_name"]
    both = old.select(*keys, "last_update_time").unionByName(new.select(*keys, "last_update_time"))
    return both.groupBy(*keys).agg(F.max("last_update_time").alias("last_update_time"))
