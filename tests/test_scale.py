"""Work that must not be repeated or moved more often than needed."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge import session
from fleetgauge.llm.common import in_slices
from fleetgauge.operators import health as H
from fleetgauge.operators import matching as M
from fleetgauge.operators import ordinals as O
from fleetgauge.plans import alerting as A
from fleetgauge.plans import digest as P
from fleetgauge.session import bounded_broadcast, settle
from workbench.registry import in_emitted_order
from fleetgauge.sources import tables as TB
from fleetgauge.sources.events import known_sources, parse_envelope


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_on_event_fields_do_not_parse_again(spark):
    texts = spark.createDataFrame([('{"source":"aws.x","detail-type":"d"}',), ("{broken",), (None,), ('{"source":"other"}',)], "value string")
    parsed = parse_envelope(texts)
    assert _plan(known_sources(parsed).filter("is_readable")).count("from_json(") == 1
    assert [r["source"] for r in known_sources(parsed).collect()] == ["aws.x"]
    assert parsed.count() == 4 and parsed.filter("event IS NULL AND source IS NULL AND NOT is_readable").count() == 1


def test_resources_are_read_once_for_matching(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    resources = spark.createDataFrame([("t", f"job-{i}") for i in range(10)], "resource_type string, resource_name string").mapInArrow(
        seen, "resource_type string, resource_name string")
    monitored = spark.createDataFrame([("t", "g", "job-*"), ("t", "h", "job-1"), ("t", "k", "*")], "resource_type string, group_name string, name string")
    assert M.match_groups(resources, monitored).count() == 21
    assert read.value == 10


def _options(spark, monkeypatch, listed):
    monkeypatch.setattr(M, "LISTED", listed)
    names = [None, *[f"r{i:03}" for i in range(120)]]
    subscriptions = lambda i: [("g", True, False)] * (i % 2 == 0) + [("h", True, False)] * (i % 3 == 0) + [("k", i % 5 == 0, True)]
    recipients = spark.createDataFrame(
        [(n, ["mail", "sms", None][i % 7 % 3], subscriptions(i)) for i, n in enumerate(names)],
        "recipient string, delivery_method string, subscriptions array<struct<monitoring_group: string, alerts: boolean, digest: boolean>>")
    matches = spark.createDataFrame(
        [("t", "a", "g"), ("t", "a", "h"), ("t", "b", "g"), ("t", "b", "g"), ("t", "c", "k"), ("t", "d", "none"), ("t", "e", None)],
        "resource_type string, resource_name string, group_name string")
    methods = spark.createDataFrame([("mail", "SES")], "name string, delivery_method_type string")
    plain = M.in_deliveries(M.recipients_for(matches, recipients, "alert"), ["resource_type", "resource_name", "delivery_method"], methods)
    return M.delivery_options(matches, recipients, methods), plain


def test_deliveries_cut_from_lists_equal_numbered_rows(spark, monkeypatch):
    for listed in (10_000, 70, 0):
        found, plain = _options(spark, monkeypatch, listed)
        rows = lambda df: sorted(map(repr, df.select(*plain.columns).collect()))
        assert rows(found) == rows(plain) and dict(found.dtypes) == dict(plain.dtypes)
        assert found.count() > 8


def test_deliveries_of_small_groups_move_lists_and_number_no_rows(spark, monkeypatch):
    calls = []
    numbered = M.pieces
    monkeypatch.setattr(M, "pieces", lambda *a: calls.append(1) or numbered(*a))
    recipients = spark.createDataFrame(
        [("r", "mail", [("g", True, False)])],
        "recipient string, delivery_method string, subscriptions array<struct<monitoring_group: string, alerts: boolean, digest: boolean>>")
    matches = spark.createDataFrame([("t", "a", "g")], "resource_type string, resource_name string, group_name string")
    methods = spark.createDataFrame([("mail", "SES")], "name string, delivery_method_type string")
    assert M.delivery_options(matches, recipients, methods).select(F.explode("recipients")).collect() == [("r",)]
    assert not calls


def test_text_batches_are_taken_in_bounded_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["é" * 10, None, "b" * 30, "c", "", "d" * 5])], names=["text"])
    parts = [p.column(0).to_pylist() for p in in_slices(batch, 0, rows=2, n_bytes=25)]
    assert sum(parts, []) == batch.column(0).to_pylist()
    assert parts == [["é" * 10, None], ["b" * 30], ["c", ""], ["d" * 5]]
    assert [p.num_rows for p in in_slices(batch, 0)] == [6] and list(in_slices(batch.slice(0, 0), 0)) == []


def _alerts_and_deliveries(spark, monkeypatch, hot):
    matches = settle(spark.createDataFrame([("glue_jobs", n, "g") for n in ("a", "b", "é")] + [("step_functions", "a", "g"), ("glue_jobs", "a", "h")],
                                           "resource_type string, resource_name string, group_name string"))
    recipients = spark.createDataFrame(
        [(f"r{i:03}", ["mail", "sms"][i % 2], [("g", True, False)] if i < 130 else [("h", True, False)]) for i in range(140)],
        "recipient string, delivery_method string, subscriptions array<struct<monitoring_group: string, alerts: boolean, digest: boolean>>")
    methods = spark.createDataFrame([("mail", "SES"), ("sms", "SNS"), ("sms", "SMS")], "name string, delivery_method_type string")
    monkeypatch.setattr(A, "with_message", lambda df: df.withColumns({"message_subject": F.lit("s"), "message_body": F.array(F.lit("b"))}))
    rows = [("glue_jobs", "a", i // 7, f"e{i // 2}") for i in range(hot)] + [("step_functions", "a", 3, "x"), ("glue_jobs", "b", 1, "y"), ("glue_jobs", "no", 1, "z")]
    alerts = spark.createDataFrame([(t, n, at, e, True) for t, n, at, e in rows], "resource_type string, resource_name string, event_time long, event string, is_alertable boolean")
    config = A.AlertConfig(None, None, recipients, methods)
    return alerts, matches, config, A.laid_deliveries(matches, config).persist()


def test_messages_numbered_by_event_equal_the_notifications(spark, monkeypatch):
    """Numbers are dense in a group that several kinds, ranges and repeated events share, and go on from the last one."""
    alerts, matches, config, deliveries = _alerts_and_deliveries(spark, monkeypatch, 400)
    last = spark.createDataFrame([("a", 10), (None, 5)], "message_group_id string, last_number long")
    found = A.numbered_notifications(alerts, matches, deliveries, last)
    plain = A.notifications(alerts, matches, config)
    assert sorted(map(repr, found.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
    rows = sorted(found.collect(), key=lambda r: r["sequence_number"])
    assert {r["resource_type"] for r in rows if r["message_group_id"] == "a"} == {"glue_jobs", "step_functions"}
    for group, before in (("a", 10), ("b", 0)):
        mine = [r for r in rows if r["message_group_id"] == group]
        assert [r["sequence_number"] for r in mine] == list(range(before + 1, before + 1 + len(mine)))
        assert [r["event_time"] for r in mine] == sorted(r["event_time"] for r in mine)
    deliveries.unpersist()


def test_numbering_moves_no_recipients(spark, monkeypatch):
    """Deliveries stay where they were laid; only those of groups in several ranges are sent along."""
    alerts, matches, config, deliveries = _alerts_and_deliveries(spark, monkeypatch, 5)
    monkeypatch.setattr(A, "_tasks", lambda m: 3)
    laid = A.laid_deliveries(matches, config).persist()
    laid.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = A.numbered_notifications(alerts, matches, laid, spark.createDataFrame([], "message_group_id string, last_number long"))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    first = plan[: plan.index("InMemoryTableScan")].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    above, at = [], depth(plan.splitlines()[len(first) - 1])
    for line in reversed(first[:-1]):
        if depth(line) < at:
            above, at = [*above, line], depth(line)
    assert any("SortMergeJoin" in line for line in above) and not any("Exchange" in line for line in above), plan
    assert found.count() == found.select("message_group_id", "sequence_number").distinct().count() > 20
    for df in (deliveries, laid):
        df.unpersist()


def test_runs_meet_limits_and_not_every_entry(spark):
    """A run of a resource in fifty groups with two limits is counted twice on the way, and whole in each group."""
    config = spark.createDataFrame(
        [(f"g{i}" if i else None, "glue_jobs", "e", "j", "1", "r", [None, 5][i % 2], 0, i) for i in range(50)],
        "group_name string, resource_type string, monitored_environment string, name string, account_id string, region_name string, "
        "sla_seconds int, minimum_number_of_runs int, entry_order long")
    runs = spark.createDataFrame([("glue_jobs", "e", "j", 1, 0, 1, float(s), 0) for s in range(10)],
        "resource_type string, monitored_environment string, resource_name string, execution long, failed long, succeeded long, "
        "execution_time_sec double, failed_attempts long")
    for match_env in (True, False):
        moved = []
        joined = H._with_config
        H._with_config = lambda *a: moved.append(joined(*a)) or moved[-1]
        try:
            health = H.resource_health(runs, config, match_env).collect()
        finally:
            H._with_config = joined
        assert moved[0].count() == 20
        assert len(health) == 50 and all(r["executions"] == (10 if r["group_name"] else 0) for r in health)
        assert all(r["warnings"] == (4 if r["sla_seconds"] else 0) for r in health if r["group_name"])


def test_order_check_moves_keys_alone(spark):
    rows = spark.range(0, 1000, 1, 4).selectExpr("id", "IF(id = 700, 3, id) AS k", "repeat('x', 50) AS wide")
    marked = in_emitted_order(rows, [], ["k"])
    assert [r["id"] for r in marked.filter("NOT in_order").collect()] == [700] and marked.count() == 1000
    assert "Window" not in _plan(marked) and marked.columns == ["id", "k", "wide", "in_order"]


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_that_files_make_look_few_are_counted_before_they_are_sent(spark):
    text = F.concat(F.repeat(F.lit("x"), F.lit(100)), F.col("id").cast("string"))
    wide = settle(spark.range(300_000).select(text.alias("key")))
    assert 2 << 20 < session.estimated_bytes(wide) < 16 << 20
    assert "Broadcast" not in _physical(wide.join(bounded_broadcast(wide.withColumn("n", F.lit(1))), "key"))
    few = settle(spark.range(400_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))).filter("key < 'k2'").limit(10)
    assert "BroadcastHashJoin" in _physical(wide.join(bounded_broadcast(few), "key"))


def test_names_and_grams_are_never_sent_and_patterns_only_where_they_are_few(spark, monkeypatch):
    monkeypatch.setattr(session, "is_small", lambda *a: False, raising=False)
    monkeypatch.setattr(M, "is_small", lambda *a: False, raising=False)
    names = settle(spark.createDataFrame([("t", f"job-{i}") for i in range(300)], "kind string, name string"))
    written = ["job-1*", "job-?", "*", "job-77", "none*", "*-2[0-4]"]
    patterns = settle(spark.createDataFrame([("t", p) for p in written], "kind string, pattern string"))
    found = M.glob_join(names, patterns, "name", "pattern", ["kind"])
    assert "Broadcast" not in _physical(found)
    sizes = dict(found.groupBy("pattern").count().collect())
    assert sizes == {"job-1*": 111, "job-?": 10, "*": 300, "job-77": 1, "*-2[0-4]": 5}


def test_numbers_send_their_offsets_only_where_groups_are_few(spark, monkeypatch):
    monkeypatch.setattr(session, "is_small", lambda *a: False, raising=False)
    rows = settle(spark.range(200).select((F.col("id") % 7).alias("g"), "id"))
    numbered = O.numbered(rows, ["g"], ["id"])
    assert "Broadcast" not in _physical(numbered)
    assert numbered.filter(F.col("ordinal") != F.floor(F.col("id") / 7) + 1).count() == 0


def test_rows_of_a_report_are_worked_out_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = """section int, group_name string, resource_type string, row_order string, line_section int, line_text string,
        kind string, values array<string>, style string"""
    rows = spark.createDataFrame([(3, "g", "glue_jobs", f"r{i}", 0, "", "row", [f"r{i}"], "ok") for i in range(6)], schema).mapInArrow(seen, schema)
    audiences = spark.createDataFrame([("a", ["g", "h"]), ("b", ["g", "g"]), ("c", ["k"])], "audience string, monitoring_groups array<string>")
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    lines = P.report_lines(rows, audiences, at, at).collect()
    assert sorted((r["audience"], r["ordinal"]) for r in lines) == [(a, i) for a in "ab" for i in range(1, 11)]
    assert read.value == 6


def test_matching_entries_are_worked_out_once(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(M, "settle", lambda df, label="settled": labels.append(label) or settle(df, label))
    schema = "group_name string, resource_type string, name string, monitored_environment string, sla_seconds int, minimum_number_of_runs int, entry_order bigint"
    monitored = spark.createDataFrame([("g", "t", "a*", "e", 1, 1, 1), ("h", "t", "b*", "e", 1, 1, 2), (None, "t", "c", "e", 1, 1, 3)], schema)
    inventory = spark.createDataFrame([("t", "e", n) for n in ("a1", "a2", None)], "resource_type string, monitored_environment string, name string")
    got = sorted(M.expand_wildcards(monitored, inventory).select("group_name", "name", "resolved").collect(), key=repr)
    assert got == sorted([("g", "a1", True), ("g", "a2", True), ("h", "b*", False), (None, "c", False)], key=repr)
    assert labels.count("kept") == 1


def test_known_records_are_told_by_keys_alone_and_sent_only_where_few(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(session, "is_small", lambda *a: False, raising=False)
    monkeypatch.setattr(TB, "is_small", lambda *a: False, raising=False)
    monkeypatch.setattr(TB, "settle", lambda df, label="settled": plans.append(_physical(df)) or settle(df, label), raising=False)
    schema = "monitored_environment string, resource_name string, job_run_id string, time timestamp, error_message string"
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    keys = [("e", "a", "r1"), (None, "a", "r1"), ("e", None, None), ("e", "b", "r2")]
    stored = settle(spark.createDataFrame([(*k, at, "old") for k in keys[:3]], schema))
    new = settle(spark.createDataFrame([(*k, at, "text") for k in keys + keys[3:]], schema))
    left = TB.unseen(new, stored, C.GLUE_JOBS)
    assert "Broadcast" not in "".join(plans) and "error_message" not in "".join(plans) and len(plans) == 1
    assert "Broadcast" not in _physical(left)
    assert [tuple(r)[:3] for r in left.collect()] == [("e", "b", "r2")]
    assert TB.unseen(new, stored.limit(0), C.GLUE_JOBS).count() == 4
