"""Collection and alerting end to end."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge import schemas
from fleetgauge.operators import classify as K
from fleetgauge.operators.progress import last_update_times
from fleetgauge.plans import alerting as A
from fleetgauge.plans.collect import collect
from fleetgauge.sources.events import parse_envelope, publish_events
from fleetgauge.sources.tables import STORAGE_KINDS, metrics, unseen
from fleetgauge.streaming.alerts import run_alerts

NOW = datetime(2024, 1, 22, 12)


def envelope(source, detail_type, **detail):
    return json.dumps({"version": "0", "id": "1", "detail-type": detail_type, "source": source, "account": "11",
                       "time": "2024-01-22T10:00:00Z", "region": "r", "detail": detail})


def alert_config(spark, **more):
    return A.AlertConfig(
        spark.createDataFrame([("prod", "11", "r")], "name string, account_id string, region string"),
        spark.createDataFrame([("g", C.GLUE_JOBS, "job-*", "prod", 0, 0, 1), ("g", C.GLUE_DATA_QUALITY, "*", "prod", 0, 0, 2),
                               ("g", C.EMR_SERVERLESS, "*", "prod", 0, 0, 3)], schemas.MONITORED_DDL),
        spark.createDataFrame([("a", "mail", [("g", True, True)])],
                              "recipient string, delivery_method string, subscriptions array<struct<monitoring_group:string,alerts:boolean,digest:boolean>>"),
        spark.createDataFrame([("mail", "AWS_SES")], "name string, delivery_method_type string"), **more)


def job(state, name="job-1"):
    return envelope("aws.glue", "Glue Job State Change", jobName=name, jobRunId="r1", state=state, message="m")


def dq(**detail):
    return envelope("aws.glue-dataquality", "Data Quality Evaluation Results Available", state="FAILED", **detail)


def test_malformed_events_become_error_rows(spark):
    texts = [
        dq(rulesetNames=[], context={"contextType": "GLUE_JOB", "jobId": "j"}), dq(rulesetNames=["x"], context={"contextType": "OTHER"}),
        dq(rulesetNames=["x"], context={"contextType": "GLUE_JOB"}), dq(rulesetNames=["x"], context={"contextType": "GLUE_JOB", "jobId": "j"}),
        envelope("aws.emr-serverless", "EMR Serverless Job Run State Change", state="FAILED"),
        envelope("aws.emr-serverless", "EMR Serverless Job Run State Change", state="FAILED", applicationId="app"),
        envelope("aws.glue", "Unheard Of", state="FAILED"), "not json",
    ]
    known = A.classified(parse_envelope(spark.createDataFrame([(t,) for t in texts], "value string")), alert_config(spark))
    reasons = sorted(r["error"].split(":")[0] for r in K.event_errors(known).collect())
    assert reasons == [
        "EMR Job Run ID is not defined in the event", "EMR Serverless Application ID is not defined in the event",
        "Missing run ID for context type GLUE_JOB in the DQ event", "Required GLue DQ Ruleset name is not defined in the DQ event",
        "Unknown or missing context type in the DQ event"]
    assert K.mapped(known).count() == 1


def test_alert_stream_writes_once_per_batch(spark, tmp_path):
    out, source = str(tmp_path / "out"), str(tmp_path / "events")
    events = [job("FAILED"), job("SUCCEEDED"), job("RUNNING"), job("FAILED", "elsewhere")]
    publish_events(spark.createDataFrame([(e,) for e in events], "value string"), source)
    start = lambda: run_alerts(spark, source, out, str(tmp_path / "cp"), alert_config(spark)).awaitTermination()
    start()
    start()
    log = spark.read.parquet(f"{out}/alert_log").collect()
    assert sorted((r["event_status"], r["event_result"], r["monitored_environment"]) for r in log) == [
        ("FAILED", "FAILURE", "prod"), ("SUCCEEDED", "SUCCESS", "prod")]
    (note,) = spark.read.parquet(f"{out}/outbox").collect()
    assert note["message_subject"] == "prod: FAILED - glue_jobs : job-1" and note["recipients"] == ["a"]
    assert note["message_body"][5]["style"] == "error"
    publish_events(spark.createDataFrame([(job("ERROR", "job-2"),)], "value string"), source)
    start()
    assert spark.read.parquet(f"{out}/alert_log").count() == 3


def raw_jobs(spark, *rows):
    fields = schemas.ddl(schemas.RAW_DDL[C.GLUE_JOBS])["JobRuns"].dataType.elementType
    full = [("env", *[{"JobName": "j", "ExecutionTime": 10, "MaxCapacity": 2.0, **r}.get(f.name) for f in fields]) for r in rows]
    schema = schemas.ddl("monitored_environment string")
    for f in fields:
        schema = schema.add(f.name, f.dataType)
    return spark.createDataFrame(full, schema)


def test_collect_in_two_rounds_equals_one(spark, tmp_path):
    at = lambda h: NOW - timedelta(hours=h)
    quick = {"Id": "quick", "StartedOn": at(2), "JobRunState": "SUCCEEDED", "DPUSeconds": 0.0}
    slow = {"Id": "slow", "StartedOn": at(5), "JobRunState": "RUNNING"}
    config = spark.createDataFrame([(C.GLUE_JOBS, "j")], "resource_type string, name string")
    envs = spark.createDataFrame([("env", "1", "r")], "name string, account_id string, region string")
    base = str(tmp_path)
    go = lambda *rows, strict=False: collect(
        spark, {C.GLUE_JOBS: raw_jobs(spark, *rows)}, base, config, envs, None, NOW, strict)
    go(quick, slow, {"Id": "old", "StartedOn": at(30), "JobRunState": "FAILED"}, {"Id": "alien", "JobName": "k", "StartedOn": at(1), "JobRunState": "FAILED"})
    assert [(r["job_run_id"], r["dpu_seconds"]) for r in metrics(spark, base, C.GLUE_JOBS).collect()] == [("quick", 20.0)]
    # The slow run began before the stored one but ended later.
    done = slow | {"JobRunState": "FAILED"}
    go(quick, done, strict=True)
    assert metrics(spark, base, C.GLUE_JOBS).count() == 1
    go(quick, done)
    go(quick, done)
    assert sorted(r["job_run_id"] for r in metrics(spark, base, C.GLUE_JOBS).collect()) == ["quick", "slow"]
    last = last_update_times({k: metrics(spark, base, k) for k in C.RESOURCE_TYPES}).collect()
    assert [(r["resource_name"], r["last_update_time"]) for r in last] == [("j", at(2))]


def test_unseen_compares_missing_keys_as_equal(spark):
    ddl = "monitored_environment string, resource_name string, catalog_id string, time timestamp"
    rows = spark.createDataFrame([("e", "x", None, NOW), ("e", "x", None, NOW), ("e", "y", None, NOW)], ddl)
    left = unseen(rows, rows.filter("resource_name = 'x'"), C.GLUE_CATALOGS)
    assert [r["resource_name"] for r in left.collect()] == ["y"]


@pytest.mark.parametrize("storage", STORAGE_KINDS)
def test_collect_takes_catalog_snapshots(spark, tmp_path, storage):
    make = spark.createDataFrame
    databases = make([("e", "d1", "1"), ("e", "other", "1")], "monitored_environment string, DatabaseName string, AccountId string")
    tables = make([("e", "d1", "t1", "1"), ("e", "d1", "t2", "1")], "monitored_environment string, DatabaseName string, Name string, CatalogId string")
    parts = make([("e", "d1", "t1")] * 3, "monitored_environment string, DatabaseName string, TableName string")
    config = make([(C.GLUE_CATALOGS, "d1")], "resource_type string, name string")
    envs = make([("e", "1", "r")], "name string, account_id string, region string")
    collect(spark, {C.GLUE_CATALOGS: (databases, tables, parts, parts.limit(1))}, str(tmp_path), config, envs, None, NOW, storage=storage)
    got = metrics(spark, str(tmp_path), C.GLUE_CATALOGS, storage).collect()
    assert [(r["resource_name"], r["tables_count"], r["partitions_count"], r["indexes_count"]) for r in got] == [("d1", 2, 3, 1)]


def test_unknown_storage_kinds_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no storage kind"):
        metrics(spark, str(tmp_path), C.GLUE_JOBS, "tape")
