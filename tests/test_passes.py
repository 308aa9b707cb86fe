"""Passes that fail anywhere, high-water marks, pruned look-ups, retention."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge import schemas
from fleetgauge.operators.progress import last_update_times
from fleetgauge.plans.collect import _not_stored, collect
from fleetgauge.sources import commits, files, tables
from fleetgauge.sources.events import publish_events

NOW = datetime(2024, 1, 22, 12, tzinfo=timezone.utc)


def facts(spark, *rows):
    """Function facts (name, request id, time)."""
    schema = schemas.metrics_schema(C.LAMBDA_FUNCTIONS)
    full = [tuple({"monitored_environment": "e", "resource_name": n, C.RUN_ID[C.LAMBDA_FUNCTIONS]: i, "time": t}.get(f) for f in schema.fieldNames()) for n, i, t in rows]
    return spark.createDataFrame(full, schema)


def one_pass(spark, base, events):
    """A record and its event, published only if the record is not stored yet."""
    step = commits.Pass(spark, base)
    new = facts(spark, ("f", "r1", NOW))
    tables.stage_metrics(new, step, C.LAMBDA_FUNCTIONS)
    stored = tables.stored_near(spark, base, C.LAMBDA_FUNCTIONS, new)
    publish_events(tables.unseen(new, stored, C.LAMBDA_FUNCTIONS).select(F.col("resource_name").alias("value")), step.stage("events", events))
    tables.commit_metrics(step)


class Crash(Exception):
    pass


def test_a_pass_that_fails_after_any_step_ends_with_one_record_and_one_event(spark, tmp_path, monkeypatch):
    steps = {name: getattr(files, name) for name in ("move", "write_text", "remove")}
    failed, at = True, 0
    while failed:
        failed, done = False, 0
        base, events = str(tmp_path / f"store{at}"), str(tmp_path / f"events{at}")
        one_pass(spark, base, events)  # an older pass, so that cleaning up is a step as well
        facts_before = tables.metrics(spark, base, C.LAMBDA_FUNCTIONS).count()
        tables.write_metrics(facts(spark, ("g", "r0", NOW)), base, C.LAMBDA_FUNCTIONS)
        base2, events2 = f"{base}-x", f"{events}-x"

        def counted(name):
            def run(*args):
                nonlocal done
                if done == at:
                    raise Crash
                done += 1
                return steps[name](*args)

            return run

        for name in steps:
            monkeypatch.setattr(files, name, counted(name))
        try:
            one_pass(spark, base2, events2)
        except Crash:
            failed = True
        monkeypatch.undo()
        one_pass(spark, base2, events2)
        one_pass(spark, base2, events2)
        assert facts_before == 1 and tables.metrics(spark, base2, C.LAMBDA_FUNCTIONS).count() == 1, at
        assert spark.read.text(events2).count() == 1, at
        assert spark.read.text(events).count() == 1
        assert [(r["resource_name"], r["last_update_time"]) for r in commits.marks(spark, base2).collect()] == [("f", NOW.replace(tzinfo=None))]
        at += 1
    assert at > 4


def test_marks_equal_the_times_over_full_tables(spark, tmp_path):
    base = str(tmp_path)
    assert commits.marks(spark, base) is None and tables.stored_last_times(spark, base).count() == 0
    hours = lambda *hs: [(f"f{h % 3}", f"r{h}", NOW - timedelta(hours=h)) for h in hs]
    for rows in (hours(5, 6, 7), hours(9, 1), hours(9, 1), hours(2)):
        tables.write_metrics(facts(spark, *rows), base, C.LAMBDA_FUNCTIONS)
        want = last_update_times({k: tables.metrics(spark, base, k) for k in C.RESOURCE_TYPES})
        assert sorted(map(tuple, commits.marks(spark, base).collect())) == sorted(map(tuple, want.collect()))
    assert len(commits.numbers(spark, base)) == 1  # older passes are gone


def read_files(df):
    """Files that the scans of a plan read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    found = [leaves.apply(i).metrics().get("numFiles") for i in range(leaves.size())]
    return sum(m.get().value() for m in found if m.isDefined())


def test_known_runs_are_looked_up_on_their_dates_only(spark, tmp_path):
    base = str(tmp_path)
    tables.write_metrics(facts(spark, *[(f"f{d % 2}", f"r{d}", NOW - timedelta(days=d)) for d in range(40)]), base, C.LAMBDA_FUNCTIONS)
    fresh = spark.createDataFrame([("e", "f1", "r3", NOW - timedelta(days=3)), ("e", "f1", "new", NOW - timedelta(days=3))],
                                  "monitored_environment string, function_name string, request_id string, started_on timestamp")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = _not_stored(spark, fresh, C.LAMBDA_FUNCTIONS, base)
        assert [r["request_id"] for r in left.collect()] == ["new"]
        assert 1 <= read_files(left) <= 2 and read_files(tables.metrics(spark, base, C.LAMBDA_FUNCTIONS)) >= 40
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_expired_dates_leave_the_disk(spark, tmp_path):
    base = str(tmp_path)
    tables.write_metrics(facts(spark, *[("f", f"r{d}", NOW - timedelta(days=d)) for d in (0, 5, 10, 11, 12, 400)]), base, C.LAMBDA_FUNCTIONS)
    planned = tables.prune(tables.metrics(spark, base, C.LAMBDA_FUNCTIONS), NOW, days=10)
    gone = tables.drop_expired(spark, base, NOW, days=10)
    assert gone == ["lambda_functions/date=2022-12-18", "lambda_functions/date=2024-01-10"]
    assert planned.count() == 3  # a reader that planned before is unharmed
    assert tables.metrics(spark, base, C.LAMBDA_FUNCTIONS).count() == 4
    assert not files.exists(spark, f"{base}/_expired") and tables.drop_expired(spark, base, NOW, days=10) == []


def test_listed_results_only(spark, tmp_path):
    """Of the landed results of rulesets those on the listing are collected."""
    fields = schemas.ddl(schemas.RAW_DDL[C.GLUE_DATA_QUALITY])["Results"].dataType.elementType
    rows = [{"ResultId": f"x{i}", "RulesetName": "rules", "StartedOn": NOW - timedelta(hours=i), "CompletedOn": NOW, "RuleResults": []} for i in (1, 2, 3)]
    schema = schemas.ddl("monitored_environment string")
    for f in fields:
        schema = schema.add(f.name, f.dataType)
    results = spark.createDataFrame([("e", *[r.get(f.name) for f in fields]) for r in rows], schema)
    listing = spark.createDataFrame([("x1", NOW - timedelta(hours=1)), ("x3", NOW - timedelta(hours=3)), ("x2", NOW - timedelta(days=9))], "ResultId string, StartedOn timestamp")
    config = spark.createDataFrame([(C.GLUE_DATA_QUALITY, "rules")], "resource_type string, name string")
    envs = spark.createDataFrame([("e", "1", "r")], "name string, account_id string, region string")
    for strict in (False, True):
        collect(spark, {C.GLUE_DATA_QUALITY: (results, listing)}, str(tmp_path), config, envs, None, NOW, strict)
        got = tables.metrics(spark, str(tmp_path), C.GLUE_DATA_QUALITY).collect()
        assert sorted(r[C.RUN_ID[C.GLUE_DATA_QUALITY]] for r in got) == ["x1", "x3"]


def test_unknown_types_are_refused_before_anything_is_written(spark, tmp_path):
    config = spark.createDataFrame([("x", "y")], "resource_type string, name string")
    with pytest.raises(ValueError, match="no normaliser"):
        collect(spark, {"x": config}, str(tmp_path / "s"), config, config, None, NOW)
    assert not (tmp_path / "s").exists()
