"""Configuration files, checks, wildcards and recipients."""

import json

import pytest
from pyspark.sql.utils import AnalysisException

from fleetgauge import constants as C
from fleetgauge import schemas
from fleetgauge.operators import checks as K
from fleetgauge.operators import matching as M
from fleetgauge.sources.settings import load_settings

GENERAL = {
    "tooling_environment": {"name": "t [<<env>>]", "account_id": "1", "region": "r", "metrics_collection_cron_expression": "c"},
    "monitored_environments": [{"name": "m1 [<<env>>]", "account_id": "11", "region": "r"},
                               {"name": "m2 [<<env>>]", "account_id": "22", "region": "r"}],
    "delivery_methods": [{"name": "mail", "delivery_method_type": "AWS_SES"}],
}
GROUPS = {"monitoring_groups": [{"group_name": "g1", "glue_jobs": [
    {"name": "job-*", "monitored_environment_name": "m1 [<<env>>]", "sla_seconds": 5}]}]}
RECIPIENTS = {"recipients": [{"recipient": "a", "delivery_method": "mail", "subscriptions": [
    {"monitoring_group": "g1", "alerts": True, "digest": False}]}]}


def write(path, replacements={"<<env>>": "dev"}, **files):
    for name, content in ({"general": GENERAL, "monitoring_groups": GROUPS, "recipients": RECIPIENTS} | files).items():
        if content is not None:
            (path / f"{name}.json").write_text(content if isinstance(content, str) else json.dumps(content, indent=1))
    if replacements is not None:
        (path / "replacements.json").write_text(json.dumps(replacements))
    return str(path)


def test_load(spark, tmp_path):
    s = load_settings(spark, write(tmp_path))
    entry = s.monitored.first()
    assert (entry["name"], entry["monitored_environment"], entry["sla_seconds"], entry["minimum_number_of_runs"]) == (
        "job-*", "m1 [dev]", 5, 0)
    tool = s.tooling.first()
    assert (tool["digest_report_period_hours"], tool["digest_cron_expression"]) == (24, "cron(0 8 * * ? *)")
    K.validate(s)


def test_files_that_are_missing_or_broken(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir(), (tmp_path / "c").mkdir()
    plain = load_settings(spark, write(tmp_path / "a", replacements=None))
    assert plain.monitored.first()["monitored_environment"] == "m1 [<<env>>]"
    with pytest.raises(AnalysisException):
        load_settings(spark, write(tmp_path / "b", recipients=None))
    with pytest.raises(Exception, match="Error parsing JSON"):
        load_settings(spark, write(tmp_path / "c", general="{bad")).environments.collect()


def test_all_broken_rules_are_reported_together(spark, tmp_path):
    general = json.loads(json.dumps(GENERAL))
    general["monitored_environments"].append({"name": "m1 [<<env>>]", "account_id": "11", "region": "r"})
    recipients = {"recipients": [{"recipient": "a", "delivery_method": "post", "subscriptions": [
        {"monitoring_group": "gone", "alerts": True, "digest": True}]}, {"delivery_method": "mail", "subscriptions": []}]}
    s = load_settings(spark, write(tmp_path, general=general, recipients=recipients))
    with pytest.raises(K.SettingsError) as caught:
        K.validate(s)
    said = str(caught.value)
    for part in ("name is used twice", "two environments", "gone", "post", "recipients.recipient"):
        assert part in said


def monitored(spark, *rows):
    return spark.createDataFrame([(*r, 0, 0, i) for i, r in enumerate(rows)], schemas.MONITORED_DDL)


def test_wildcards(spark):
    entries = monitored(
        spark, ("g", C.GLUE_JOBS, "job-*", "e1"), ("g", C.GLUE_JOBS, "other", "e1"), ("g", C.GLUE_JOBS, "gone", "e1"),
        ("h", C.GLUE_JOBS, "nothing-*", "e1"), ("g", C.GLUE_DATA_QUALITY, "in-a-job", "e1"), ("g", C.STEP_FUNCTIONS, "job-*", "e2"))
    there = spark.createDataFrame(
        [(C.GLUE_JOBS, "e1", n) for n in ("job-1", "job-2", "other", "x")] + [(C.GLUE_JOBS, "e2", "job-9")],
        "resource_type string, monitored_environment string, name string")
    got = {(r["group_name"], r["resource_type"], r["name"], r["resolved"]) for r in M.expand_wildcards(entries, there).collect()}
    assert got == {
        ("g", C.GLUE_JOBS, "job-1", True), ("g", C.GLUE_JOBS, "job-2", True), ("g", C.GLUE_JOBS, "other", True),
        ("h", C.GLUE_JOBS, "nothing-*", False), ("g", C.GLUE_DATA_QUALITY, "in-a-job", True),
        ("g", C.STEP_FUNCTIONS, "job-*", False)}


def test_recipients_and_audiences(spark):
    recipients = spark.createDataFrame(
        [("all", "m", [("g1", True, True), ("g2", True, True)]), ("all2", "m", [("g2", False, True), ("g1", False, True)]),
         ("none", "m", []), ("alerts", "m", [("g2", True, False)])],
        "recipient string, delivery_method string, subscriptions array<struct<monitoring_group:string,alerts:boolean,digest:boolean>>")
    methods = spark.createDataFrame([("m", "AWS_SES")], "name string, delivery_method_type string")
    groups = spark.createDataFrame([("g2",)], "group_name string")
    assert {r["recipient"] for r in M.recipients_for(groups, recipients, "alert").collect()} == {"all", "alerts"}
    audiences = {tuple(r["monitoring_groups"]): r["recipients"] for r in M.group_recipients(recipients, methods).collect()}
    assert audiences == {("g1", "g2"): ["all", "all2"], (): ["alerts", "none"]}
