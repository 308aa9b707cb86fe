"""Column functions against plain Python."""

from fnmatch import fnmatchcase

from pyspark.sql import functions as F

from fleetgauge.functions import globs, links, outcome, text, timefn


def test_globs_match_like_the_shell(spark):
    patterns = ["*", "job-*", "job-?", "j[a-p]b-1", "j[!o]b-1", "job[-1", "a.b", "a+b*", "[]x]y", "*[0-9]", "[^a]b", "", "a\\b"]
    names = ["job-1", "job-12", "job[-1", "a.b", "axb", "a+b", "a+bcd", "]y", "xy", "^b", "bb", "jab-1", "", "x\n1", "a\\b"]
    df = spark.createDataFrame([(p, n) for p in patterns for n in names], "p string, n string")
    got = df.select("p", "n", F.rlike(F.col("n"), globs.glob_to_regex(F.col("p"))).alias("m")).collect()
    for r in got:
        assert r["m"] == fnmatchcase(r["n"], r["p"]), (r["p"], r["n"])


def test_truncate_keeps_text_that_fits(spark):
    rows = spark.createDataFrame([("x" * 100,), ("x" * 101,), (None,)], "t string").select(
        text.truncate(F.col("t"), 100).alias("t")).collect()
    assert [r["t"] for r in rows] == ["x" * 100, "x" * 100 + "...", None]


def test_crawl_summary_counts_and_survives_bad_json(spark):
    good = '{"TABLE": {"ADD": "{\\"Count\\": 3}", "add": "{\\"Count\\": 1}"}, "partition": {"Delete": "{\\"Count\\": 7}"}}'
    df = spark.createDataFrame([(good,), ("nope{",), ("",), (None,), ('{"TABLE":{"ADD":"oops"}}',)], "s string")
    rows = [r["c"].asDict() for r in df.select(outcome.parse_crawl_summary(F.col("s")).alias("c")).collect()]
    assert rows[0] == {
        "tables_added": 4, "tables_updated": 0, "tables_deleted": 0, "partitions_added": 0, "partitions_updated": 0,
        "partitions_deleted": 7}
    assert all(set(r.values()) == {0} for r in rows[1:])


def test_report_line(spark):
    line = "REPORT RequestId: r\tDuration: 2758.71 ms\tBilled Duration: 2759 ms\tMemory Size: 128 MB\tMax Memory Used: 80 MB\t\n"
    row = spark.createDataFrame([(line,), ("REPORT",)], "m string").select(
        *[c.alias(n) for n, c in outcome.parse_report(F.col("m")).items()]).collect()
    assert list(row[0]) == [2758.71, 2759.0, 128.0, 80.0]
    assert list(row[1]) == [0.0, 0.0, 0.0, 0.0]


def test_workflow_error_texts(spark):
    node = "STRUCT<Type: STRING, Name: STRING, Job: STRUCT<Name: STRING, ErrorMessage: STRING>, JobDetails: STRUCT<JobRuns: ARRAY<STRUCT<Id: STRING, ErrorMessage: STRING>>>, CrawlerDetails: STRUCT<Crawls: ARRAY<STRUCT<State: STRING, ErrorMessage: STRING>>>>"
    make = lambda kind, message: (kind, "n", ("j", message), None, None)
    cases = [
        ([make("JOB", "Test job error")], "JOB Error: Test job error"),
        ([make("JOB", "Test job error"), make("TRIGGER", "Test trigger error")],
         "Total Errors: 2. JOB Error: Test job error; TRIGGER Error: Test trigger error"),
        ([], None), ([make("JOB", None)], None),
        ([make("CRAWLER", "Test job error_" + "x" * 50)], "CRAWLER Error: Test job error_" + "x" * 35 + "..."),
    ]
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(cases)], f"i int, nodes ARRAY<{node}>")
    got = {r["i"]: r["e"] for r in df.select("i", outcome.workflow_error(F.col("nodes")).alias("e")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_store_and_event_times(spark):
    df = spark.createDataFrame([("2024-01-09 11:47:45.436000000", "2023-11-21T21:39:09Z"), ("bad", None)], "a string, b string")
    rows = df.select(F.unix_millis(timefn.store_time(F.col("a"))).alias("a"), F.unix_millis(timefn.event_time(F.col("b"))).alias("b")).collect()
    assert (rows[0]["a"], rows[0]["b"]) == (1704800865436, 1700602749000)
    assert rows[1]["a"] is None and rows[1]["b"] is not None


def test_links(spark):
    df = spark.createDataFrame([("lambda_functions", "r", "f", "2024/[$LATEST]a")], "t string, r string, n string, l string")
    url = df.select(links.run_url(F.col("t"), F.col("r"), F.col("n"), log_stream=F.col("l"))).first()[0]
    assert url == ("https://r.console.aws.amazon.com/cloudwatch/home?region=r#logsV2:log-groups/log-group/"
                   "$252Faws$252Flambda$252Ff/log-events/2024$252F$255B$2524LATEST$255Da")
