"""Log sessionising: known cases, a plain state machine, slices and streams."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from fleetgauge import schemas
from fleetgauge.operators import logs as L
from fleetgauge.operators.normalise import normalise_lambda
from fleetgauge.streaming.logs import sessionise_step

T0 = datetime(2024, 9, 30, 9, 41, 25, 893000)


def line(ms, message, request, stream="s1", function="f"):
    return ("env", function, T0 + timedelta(milliseconds=ms), stream, message, request)


def report(request, used=80):
    return (f"REPORT RequestId: {request}\tDuration: 2758.71 ms\tBilled Duration: 2759 ms\tMemory Size: 128 MB\t"
            f"Max Memory Used: {used} MB\tInit Duration: 261.91 ms\t\n")


def run(spark, lines, **options):
    out = L.sessionise(spark.createDataFrame(lines, schemas.LOG_DDL), **options)
    return sorted(out.select("log_stream", "request_id", "started_on", "status", "error_count", "error_message").collect())


def test_success(spark):
    lines = [line(0, "START RequestId: a\n", "a"), line(2768, "[INFO] a ok\n", "a"), line(2769, "END RequestId: a\n", "a"),
             line(2770, report("a"), "a")]
    fact = normalise_lambda(L.sessionise(spark.createDataFrame(lines, schemas.LOG_DDL))).first()
    assert (fact["succeeded"], fact["failed"], fact["duration_ms"], fact["billed_duration_ms"]) == (1, 0, 2758.71, 2759.0)
    assert (fact["memory_size_mb"], fact["max_memory_used_mb"], fact["error_message"]) == (128.0, 80.0, None)


def test_failure_with_an_error_that_names_no_request(spark):
    lines = [
        line(0, "START RequestId: b\n", "b"), line(1, "[ERROR] Exception: intentional failure - lambda dq\n", None),
        line(2, "[ERROR]\t2024-09-30T09:41:25.895Z\tb\tSecond failure - lambda dq\n", "b"),
        line(9, "END RequestId: b\n", "b"), line(9, report("b"), "b"),
    ]
    (got,) = run(spark, lines)
    assert got["status"] == "FAILED" and got["error_count"] == 2
    assert got["error_message"] == "[ERROR] Exception: intentional failure - lambda dq\n<br/>Second failure - lambda dq"


def test_retries_are_separate_and_open_ones_are_not_emitted(spark):
    one = lambda at: [line(at, "START RequestId: a\n", "a"), line(at + 5, "END RequestId: a\n", "a"), line(at + 5, report("a"), "a")]
    lines = one(0) + one(3_600_000) + [
        line(7_200_000, "START RequestId: z\n", "z"), line(3_600_100, "[ERROR] late", None), line(3_600_101, "[ERROR] late", "a"),
    ]
    got = run(spark, lines)
    assert [(r["request_id"], r["status"]) for r in got] == [("a", "SUCCEEDED")] * 2


def machine(lines):
    """What one pass over each stream gives."""
    out = []
    for owner in {(x[1], x[3]) for x in lines}:
        active, no, is_open = None, False, {}
        mine = [x for x in lines if (x[1], x[3]) == owner]
        for _, function, ts, stream, message, request in sorted(mine, key=lambda x: (x[2], kind(x[4]) or 9, x[4])):
            k = kind(message)
            if k is None:
                continue
            orphan = k == L.ERROR and request is None
            key = active if orphan else request
            if orphan and active is None:
                continue
            if k == L.START:
                is_open[key] = {"ts": ts, "errors": 0, "ended": False}
                active = key
            elif key in is_open:
                record = is_open[key]
                if k == L.ERROR:
                    record["errors"] += 1
                elif k == L.END:
                    record["ended"] = True
                else:
                    status = "FAILED" if record["errors"] else "SUCCEEDED" if record["ended"] else "RUNNING"
                    out.append((stream, key, record["ts"], status, record["errors"]))
                    del is_open[key]
                    active = None
    return sorted(out)


def kind(message):
    for marker, k in (("START", L.START), ("[ERROR]", L.ERROR), ("END", L.END), ("REPORT RequestId:", L.REPORT)):
        if marker in message:
            return k
    return None


def random_log(seed, n=400):
    """Interleaved requests, lost lines, idle gaps, one stream with most of the lines."""
    rng, at, lines = random.Random(seed), 0, []
    for _ in range(n):
        at += rng.choice([1, 1, 5, 40_000, 700_000])
        stream = rng.choice(["hot"] * 6 + ["a", "b"])
        request = rng.choice("pqrst")
        message, who = rng.choice([
            (f"START RequestId: {request}", request), (f"START RequestId: {request}", request),
            (f"[ERROR] x{rng.random()}", None), (f"[ERROR] y{rng.random()}", request), (f"END RequestId: {request}", request),
            (report(request), request), (report(request), request), ("INFO", request),
        ])
        lines.append(line(at, message, who, stream))
    return lines


def test_matches_a_plain_state_machine_whatever_the_slices(spark):
    for seed in range(3):
        lines = random_log(seed)
        want = machine(lines)
        assert len(want) > 20
        for minutes in (1, 10, 100_000):
            got = [tuple(r)[:5] for r in run(spark, lines, slice_minutes=minutes)]
            assert got == want, (seed, minutes)


def test_pieces_of_a_log_give_what_the_whole_gives(spark, tmp_path):
    lines = sorted(random_log(7), key=lambda x: x[2])
    got = []
    for n in range(4):
        piece = spark.createDataFrame(lines[n * 100:(n + 1) * 100], schemas.LOG_DDL)
        out = sessionise_step(piece, str(tmp_path / "state"), n)
        got += [tuple(r) for r in out.select("log_stream", "request_id", "started_on", "status", "error_count").collect()]
        if n == 1:  # a repeated batch finds the same open lines
            again = sessionise_step(piece, str(tmp_path / "state"), n)
            assert again.count() == out.count()
    assert sorted(got) == machine(lines)


def test_text_of_very_many_errors_is_exact(spark):
    lines = [line(0, "START RequestId: a", "a"), line(900, "END RequestId: a", "a"), line(901, report("a"), "a")]
    lines += [line(1 + i, f"[ERROR]\tt\ta\t{chr(97 + i % 3) if i % 4 else ''}", "a") for i in range(300)]
    (got,) = run(spark, lines)
    want = "<br/>".join(chr(97 + i % 3) if i % 4 else "" for i in range(300))
    assert got["error_count"] == 300 and got["error_message"] == want[:100] + "..."


def pieces_of(spark, state, pieces, hours=None):
    """Request ids closed by each piece; `hours` tells when the pieces come in."""
    got = []
    for n, piece in enumerate(pieces):
        now = T0 + timedelta(hours=hours[n] if hours else 0)
        out = sessionise_step(spark.createDataFrame(piece, schemas.LOG_DDL), str(state), n, now=now.replace(tzinfo=timezone.utc))
        got.append(sorted(r["request_id"] for r in out.collect()))
    return got


def test_open_lines_expire_behind_their_own_stream(spark, tmp_path):
    hour = 3_600_000
    pieces = [
        [line(0, "START RequestId: lost", "lost"), line(0, "START RequestId: late", "late", "s2")],
        [line(25 * hour, "START RequestId: c", "c")],  # `lost` is 25 hours behind in its stream
        [line(26 * hour, report("late"), "late", "s2"), line(26 * hour, report("lost"), "lost"), line(26 * hour, report("c"), "c")],
    ]
    assert pieces_of(spark, tmp_path / "state", pieces) == [[], [], ["c", "late"]]
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["version=0", "version=1"]


def test_a_wrong_clock_in_one_stream_changes_nothing_in_others(spark, tmp_path):
    month = 30 * 24 * 3_600_000
    pieces = [
        [line(0, "START RequestId: a", "a"), line(month, "START RequestId: x", "x", "s2")],
        [line(2 * month, "[ERROR] far", "y", "s3")],
        [line(5, report("a"), "a")],
    ]
    assert pieces_of(spark, tmp_path / "state", pieces) == [[], [], ["a"]]


def test_silent_streams_are_given_up(spark, tmp_path):
    pieces = [[line(0, "START RequestId: a", "a")], [line(1, "[ERROR] x", "b", "s2")], [line(2, "[ERROR] x", "b", "s2")], [line(5, report("a"), "a")]]
    assert pieces_of(spark, tmp_path / "one", pieces, hours=[0, 20, 23, 23]) == [[], [], [], ["a"]]
    assert pieces_of(spark, tmp_path / "two", pieces, hours=[0, 20, 25, 26]) == [[], [], [], []]


def test_few_shuffles_and_one_scan(spark, tmp_path):
    """Own shuffles of the sessioniser, the last one by invocation included."""
    spark.createDataFrame(random_log(1), schemas.LOG_DDL).write.parquet(str(tmp_path / "log"))
    out = L.sessionise(spark.read.parquet(str(tmp_path / "log")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [x for x in plan.splitlines() if "- Exchange hashpartitioning" in x]
    assert len(shuffles) <= 8 and plan.count("FileScan") == 1, plan
