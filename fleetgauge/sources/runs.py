"""Readers of landed run records, catalog listings and function logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge import schemas

# Where the records sit inside one landed document.
_RECORDS = {
    C.GLUE_JOBS: "JobRuns",
    C.GLUE_WORKFLOWS: "Runs",
    C.GLUE_CRAWLERS: "Crawls",
    C.GLUE_DATA_QUALITY: "Results",
    C.STEP_FUNCTIONS: "executions",
}


def read_runs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Landed JSON of one kind as one row per record.

    `kind` is a resource type with runs, or `lambda_logs`. Schemas are fixed, so nothing is
    inferred and the scan is one pass.
    """
    raw = spark.read.schema(schemas.RAW_DDL[kind]).json(path)
    return flatten_runs(raw, kind)


def flatten_runs(raw: DataFrame, kind: str) -> DataFrame:
    """One row per record of a raw document table."""
    if kind == "lambda_logs":
        return _flat_log(raw)
    if kind == C.EMR_SERVERLESS:
        return raw.select("monitored_environment", "jobRun.*")
    outer = [c for c in raw.columns if c != _RECORDS[kind]]
    return raw.select(*outer, F.explode(_RECORDS[kind]).alias("r")).select(*outer, "r.*")


def _field(entry: Column, name: str) -> Column:
    """The first value of a named field of a log entry."""
    return F.try_element_at(F.filter(entry, lambda p: p["field"] == name), F.lit(1))["value"]


def _flat_log(raw: DataFrame) -> DataFrame:
    entry = F.col("entry")
    return raw.select(
        "monitored_environment",
        "function_name",
        F.try_to_timestamp(_field(entry, "@timestamp")).alias("ts"),
        _field(entry, "@logStream").alias("log_stream"),
        _field(entry, "@message").alias("message"),
        _field(entry, "@requestId").alias("request_id"),
    )


def read_catalog_listing(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four levels of a landed catalog listing, each from its own folder."""
    return {
        level: spark.read.schema(ddl).json(f"{path.rstrip('/')}/{level}")
        for level, ddl in schemas.CATALOG_DDL.items()
    }
