"""Sizes at which results once changed or failed."""

import json
from datetime import datetime, timedelta, timezone
from fnmatch import fnmatchcase

from hypothesis import Phase, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.operators.digest_runs import request_errors
from fleetgauge.operators.matching import glob_candidates, glob_join
from fleetgauge.plans.collect import _not_stored
from fleetgauge.sources.settings import load_settings

NOW = datetime(2024, 1, 2, tzinfo=timezone.utc)


def test_all_error_texts_of_a_request_in_order(spark):
    rows = [("r", NOW + timedelta(seconds=i), f"e{i}") for i in range(1500)] + [("quiet", NOW, None)]
    df = spark.createDataFrame(rows, "lambda_function_request_id string, time timestamp, error_message string")
    got = dict(map(tuple, request_errors(df, NOW - timedelta(days=1), NOW + timedelta(days=1)).collect()))
    assert got == {"r": ", ".join(f"e{i}" for i in range(1500)), "quiet": ""}


def test_many_groups_in_one_document(spark, tmp_path):
    entry = [{"name": "n", "monitored_environment_name": "e"}] * 3
    groups = [{"group_name": f"g{i}", **{k: entry for k in C.RESOURCE_TYPES}} for i in range(5)]
    for name, text in (("general", {}), ("recipients", {}), ("monitoring_groups", {"monitoring_groups": groups})):
        (tmp_path / f"{name}.json").write_text(json.dumps(text))
    got = load_settings(spark, str(tmp_path)).monitored.orderBy("entry_order").collect()
    assert [r["group_name"] for r in got] == [f"g{i}" for i in range(5) for _ in range(3 * len(C.RESOURCE_TYPES))]


def test_names_meet_only_patterns_with_their_stem(spark):
    names = spark.createDataFrame([(f"crawler-{a}{b}",) for a in "abc" for b in "xy"], "name string")
    patterns = spark.createDataFrame([("crawler-a*",), ("crawler-bx",), ("crawler-?y",), ("*",), ("crawler-a[xz]",)], "pattern string")
    got = sorted(map(tuple, glob_join(names, patterns, "name", "pattern", []).collect()))
    want = [(f"crawler-{a}{b}", p) for a in "abc" for b in "xy" for p, fits in (
        ("crawler-a*", a == "a"), ("crawler-bx", a + b == "bx"), ("crawler-?y", b == "y"), ("*", True), ("crawler-a[xz]", a + b == "ax")) if fits]
    assert got == sorted(want)


def test_runs_without_an_id_are_known_once_stored(spark, monkeypatch):
    from fleetgauge.plans import collect as plan

    stored = spark.createDataFrame([(None, NOW, "e", "f")], f"{C.RUN_ID[C.LAMBDA_FUNCTIONS]} string, time timestamp, monitored_environment string, resource_name string")
    monkeypatch.setattr(plan, "stored_near", lambda *_: stored)
    fresh = spark.createDataFrame([(None, NOW, "e", "f"), (None, NOW, "e", "g")], "request_id string, started_on timestamp, monitored_environment string, function_name string")
    assert [r["function_name"] for r in _not_stored(spark, fresh, C.LAMBDA_FUNCTIONS, "").collect()] == ["g"]


def test_deliveries_of_bounded_size_name_all_recipients(spark):
    from fleetgauge.operators.matching import RECIPIENTS, delivery_options

    subs = "array<struct<monitoring_group: string, alerts: boolean, digest: boolean>>"
    people = spark.createDataFrame([(f"p{i:03}", "mail", [("g", True, True)]) for i in range(500)], f"recipient string, delivery_method string, subscriptions {subs}")
    methods = spark.createDataFrame([("mail", "SES")], "name string, delivery_method_type string")
    matches = spark.createDataFrame([("t", "r", "g")], "resource_type string, resource_name string, group_name string")
    rows = sorted(delivery_options(matches, people, methods).collect(), key=lambda r: r["part"])
    assert [r["part"] for r in rows] == list(range(10)) and max(len(r["recipients"]) for r in rows) == RECIPIENTS
    assert [x for r in rows for x in r["recipients"]] == [f"p{i:03}" for i in range(500)]


def test_patterns_without_a_beginning_meet_by_their_rarest_piece(spark):
    """1,000 patterns, candidates within twice the matches."""
    names = spark.createDataFrame([(f"team{i % 7}-load-{i}-env{i % 1000}",) for i in range(4000)], "name string")
    patterns = spark.createDataFrame([(f"*-env{k}",) for k in range(990)] + [(f"?eam{k}-*-env{k}",) for k in range(5)] + [(f"*load-{k}0-*",) for k in range(5)], "pattern string")
    pairs = glob_candidates(names, patterns, "name", "pattern", [])
    matches = glob_join(names, patterns, "name", "pattern", []).count()
    assert matches > 3900 and pairs.count() <= 2 * matches


@settings(max_examples=3, deadline=None, phases=[Phase.explicit, Phase.generate])
@example({"a", "b", "-", "[b-a]", "ab", "[!]"}, {"[b-a]", "[!b-a]", "[!]", "[]", "[]-a]*", "[a-]", "a["})
@given(
    st.sets(st.text("ab-[]\\x01\\x02é", max_size=9), min_size=1, max_size=12),
    st.sets(st.text("ab-*?[!]\\x01é", min_size=1, max_size=9), min_size=1, max_size=12),
)
def test_gram_index_equals_testing_every_pair(spark, names, patterns):
    got = glob_join(
        spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"),
        "name", "pattern", [],
    )
    want = sorted((n, p) for n in names for p in patterns if fnmatchcase(n, p))
    assert sorted(map(tuple, got.select("name", "pattern").collect())) == want
