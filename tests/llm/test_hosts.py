"""The prior shrinks small hosts and leaves large ones their own rate."""

from fleetgauge.llm import host_quality


def verdicts(spark, hosts):
    """Of hosts (name, documents, failures)."""
    rows = [(h, i < f) for h, n, f in hosts for i in range(n)]
    got = host_quality.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()
    return {r["host"]: (r["rejected"], r["rate"]) for r in got}


def test_one_document_tells_nothing_of_a_host(spark):
    got = verdicts(spark, [(f"h{i}", 1, i % 10 < 3) for i in range(1000)])
    assert not any(r for r, _ in got.values()) and max(x for _, x in got.values()) < 0.31


def test_small_hosts_of_one_rate_are_judged_by_the_corpus(spark):
    fails = [0] * 343 + [1] * 441 + [2] * 189 + [3] * 27  # three draws at 0.3
    got = verdicts(spark, [(f"h{i}", 3, f) for i, f in enumerate(fails)])
    assert not any(r for r, _ in got.values())


def test_hosts_that_differ_are_told_apart(spark):
    hosts = [(f"good{i}", 200, 10) for i in range(30)] + [(f"bad{i}", 200, 150) for i in range(10)] + [("new", 1, 1)]
    got = verdicts(spark, hosts)
    assert {h for h, (r, _) in got.items() if r} >= {f"bad{i}" for i in range(10)} and not any(got[f"good{i}"][0] for i in range(30))
    assert abs(got["bad0"][1] - 0.75) < 0.02 and got["new"][1] < 0.75


def test_large_and_small_hosts_mixed(spark):
    hosts = [("large", 5000, 4000)] + [(f"s{i}", 2, i % 3 == 0) for i in range(900)]
    got = verdicts(spark, hosts)
    assert got["large"][0] and abs(got["large"][1] - 0.8) < 0.01
