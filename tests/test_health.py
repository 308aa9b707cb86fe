"""Digest health, comments and reports on known cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.operators import digest_runs as D
from fleetgauge.operators import health as H
from fleetgauge.operators import matching as M
from fleetgauge.plans import digest as P

RUNS = ", ".join(f"{n} {t}" for n, t in D.COMMON.items())
CONFIG = """group_name string, resource_type string, monitored_environment string, name string, sla_seconds int,
    minimum_number_of_runs int, entry_order bigint, account_id string, region_name string"""


def runs(spark, kind, *rows):
    full = []
    for r in rows:
        base = dict.fromkeys(D.COMMON) | {
            "resource_type": kind, "monitored_environment": "e", "resource_name": "x", "execution": 1, "failed": 0,
            "succeeded": 0, "execution_time_sec": 1.0, "error_message": "", "failed_attempts": 0, "job_run_id": ""}
        full.append(tuple((base | r).values()))
    return spark.createDataFrame(full, RUNS)


def config(spark, kind, sla=0, minimum=0, name="x", order=1, group="g"):
    return spark.createDataFrame([(group, kind, "e", name, sla, minimum, order, "123", "r")], CONFIG)


def health(spark, kind, data, cfg):
    row = H.resource_health(data, cfg).first()
    notes = H.comments(H.comment_lines(H.resource_health(data, cfg), H.run_comments(data, cfg))).collect()
    return row, "<br/>".join(r["comments"] for r in sorted(notes, key=lambda r: r["piece"]))


def test_no_runs(spark):
    row, notes = health(spark, C.LAMBDA_FUNCTIONS, runs(spark, C.LAMBDA_FUNCTIONS), config(spark, C.LAMBDA_FUNCTIONS))
    assert (row["status"], row["executions"], notes) == ("ok", 0, "")
    row, notes = health(spark, C.GLUE_JOBS, runs(spark, C.GLUE_JOBS), config(spark, C.GLUE_JOBS, minimum=1))
    assert row["status"] == "error" and row["insufficient_runs"]
    assert notes == "Insufficient runs: 0 run(s) during the monitoring period (at least 1 expected)."


def test_no_config_gives_nothing(spark):
    data = runs(spark, C.STEP_FUNCTIONS, {"succeeded": 1})
    assert H.resource_health(data, config(spark, C.STEP_FUNCTIONS).limit(0)).count() == 0


@pytest.mark.parametrize(
    "rows, sla, want",
    [
        ([{"succeeded": 1}, {"succeeded": 1}], 0, ("ok", 2, 2, 0, 0)),
        ([{"failed": 1}, {"failed": 1, "error_message": None}], 0, ("error", 2, 0, 2, 0)),
        ([{"succeeded": 1}, {"failed": 1, "error_message": "Failed"}], 0, ("error", 2, 1, 1, 0)),
        ([{"succeeded": 1, "execution_time_sec": 20.0}], 10, ("warning", 1, 1, 0, 1)),
        ([{"failed": 1, "execution_time_sec": 15.0}], 10, ("error", 1, 0, 1, 1)),
        ([{"succeeded": 1, "execution_time_sec": 10.0}], 10, ("ok", 1, 1, 0, 0)),
        ([{"succeeded": 1, "failed_attempts": 2, "execution_time_sec": 20.0}], 10, ("warning", 1, 1, 0, 2)),
    ],
)
def test_statuses(spark, rows, sla, want):
    row, notes = health(spark, C.GLUE_CRAWLERS, runs(spark, C.GLUE_CRAWLERS, *rows), config(spark, C.GLUE_CRAWLERS, sla))
    assert tuple(row[n] for n in ("status", "executions", "success", "errors", "warnings")) == want
    assert ("Some runs have failed:" in notes) == (want[3] > 0)
    assert ("SLA (=10 sec)" in notes) == row["has_sla_breach"]


def test_equal_lines_show_once_and_later_entry_wins(spark):
    data = runs(spark, C.GLUE_CRAWLERS, *[{"failed": 1, "error_message": "boom"}] * 3)
    both = config(spark, C.GLUE_CRAWLERS, minimum=9).unionAll(config(spark, C.GLUE_CRAWLERS, minimum=2, order=2))
    row, notes = health(spark, C.GLUE_CRAWLERS, data, both)
    assert row["executions"] == 3 and not row["insufficient_runs"] and notes.count("boom") == 1


def test_comments_of_a_resource_with_very_many_failures_are_whole(spark):
    data = runs(spark, C.GLUE_JOBS, *[{"failed": 1, "job_run_id": f"r{i}", "error_message": f"m{i}"} for i in range(2000)])
    cfg = config(spark, C.GLUE_JOBS)
    texts = H.comments(H.comment_lines(H.resource_health(data, cfg), H.run_comments(data, cfg))).orderBy("piece").collect()
    assert [r["piece"] for r in texts] == list(range(21))
    assert sum(r["comments"].count(" - <a href=") for r in texts) == 2000 and max(len(r["comments"]) for r in texts) < 100_000
    assert texts[0]["comments"].startswith("Some runs have failed:")


def test_catalog_totals_and_deletion_warning(spark):
    ddl = "resource_type string, monitored_environment string, resource_name string, " + ", ".join(
        f"{m} bigint" for m in H.CATALOG_MEASURES)
    deltas = spark.createDataFrame([(C.GLUE_CATALOGS, "e", "x", 5, 10, 2, -1, 3, 0)], ddl)
    row = H.catalog_health(deltas, config(spark, C.GLUE_CATALOGS)).first()
    assert row["status"] == "warning"
    assert row["comments"] == "WARNING: Some Glue Data Catalog Tables have been deleted."
    summary = H.catalog_summary(H.catalog_health(deltas, config(spark, C.GLUE_CATALOGS))).first()
    assert (summary["total_tables_count"], summary["total_tables_added"], summary["status"]) == (5, -1, "warning")


def test_unknown_types_are_errors(spark):
    with pytest.raises(ValueError):
        H.aggregate_health("nothing", None, None)
    with pytest.raises(ValueError):
        D.digest_runs(None, "nothing", None, None)


def test_reports_go_to_audiences_with_data_only(spark):
    start, end = datetime(2024, 1, 1), datetime(2024, 1, 2)
    metrics = spark.createDataFrame(
        [("e", "x", datetime(2024, 1, 1, 5), "r1", 1, 0, 1, 3.0, "bad", 1.0)],
        "monitored_environment string, resource_name string, time timestamp, job_run_id string, execution bigint, "
        "succeeded bigint, failed bigint, execution_time_sec double, error_message string, dpu_seconds double")
    recipients = spark.createDataFrame(
        [("a", "mail", [("g", True, True)]), ("b", "mail", [("g", False, True)]), ("c", "mail", [("other", True, True)]),
         ("d", "mail", [])],
        "recipient string, delivery_method string, subscriptions array<struct<monitoring_group:string,alerts:boolean,digest:boolean>>")
    methods = spark.createDataFrame([("mail", "AWS_SES")], "name string, delivery_method_type string")
    (report,) = P.digest({C.GLUE_JOBS: metrics}, config(spark, C.GLUE_JOBS), recipients, methods, start, end).collect()
    assert report["recipients"] == ["a", "b"] and report["message_subject"] == "Digest Report 2024-01-02"
    body = [(r["kind"], r["values"], r["style"]) for r in report["message_body"]]
    assert body[0] == ("text", ["Digest Summary"], "header") and body[4] == ("text", ["g: Glue Jobs"], "header")
    assert body[2][1] == C.SUMMARY_HEADER and body[3][1] == ["g", "Glue Jobs", "1", "0", "1", "0"]
    assert body[5][:2] == ("header", C.RESOURCE_HEADER) and body[6][2] == "error" and body[7][:2] == ("comment", ["Some runs have failed:"])
    assert (report["piece"], report["part"]) == (0, 0)


def test_reports_of_very_many_resources_are_messages_of_bounded_size(spark):
    """Lines are dense and in order over many tasks; no value holds a report."""
    n = 30_000
    rows = spark.range(n).selectExpr(
        "3 AS section", "'g' AS group_name", f"'{C.GLUE_JOBS}' AS resource_type", "lpad(CAST(id AS STRING), 9, '0') AS row_order", "0 AS line_section",
        "'' AS line_text", "'row' AS kind", "array(lpad(CAST(id AS STRING), 9, '0'), repeat('x', 200)) AS values", "'ok' AS style").repartition(7)
    people = spark.range(120).selectExpr("concat('p', lpad(CAST(id AS STRING), 3, '0')) AS recipient", "'mail' AS delivery_method",
                                         "array(named_struct('monitoring_group', 'g', 'alerts', true, 'digest', true)) AS subscriptions")
    methods = spark.createDataFrame([("mail", "AWS_SES")], "name string, delivery_method_type string")
    audiences = P.with_audience(M.group_recipients(people, methods))
    start, end = datetime(2024, 1, 1), datetime(2024, 1, 2)
    lines = P.report_lines(rows, audiences, start, end)
    got = P.reports(lines, audiences, end).select("piece", "part", "recipients", "message_body").collect()
    assert {(r["piece"], r["part"]) for r in got} == {(p, q) for p in range(-(-(n + 4) // P.LINES)) for q in range(3)}
    assert max(len(r["recipients"]) for r in got) == M.RECIPIENTS
    body = [b for r in sorted((r for r in got if r["part"] == 0), key=lambda r: r["piece"]) for b in r["message_body"]]
    assert [b["ordinal"] for b in body] == list(range(1, n + 5)) and [b["values"][0] for b in body[4:]] == [f"{i:09}" for i in range(n)]
    assert max(sum(len(v) for b in r["message_body"] for v in b["values"]) for r in got) < 1_000_000
