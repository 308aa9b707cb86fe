"""Nulls, empty tables, long texts, ties, repeated rows and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetgauge.llm import bpe, divergence, host_quality, html_text, importance, minhash, mixing, pii, secret_scan, simhash, topk, toxicity, urls
from fleetgauge.llm.queries import VOCABULARY

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 40_000 + "x" * 30_000
ROWS = [
    (1, "a first text with a few words in it", "en", "s1", 9),
    (1, "a first text with a few words in it", "en", "s1", 9),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, " \n\t ", "en", None, 4),
    (None, "a text without an id", "en", "s2", 3),
    (5, LONG, "de", "s1", len(LONG)),
    (6, "same text here", "en", "s2", 1),
    (7, "same text here", "en", "s2", 1),
]
CLASHES = ["fp", "ones", "size", "target", "score", "word", "rank", "s", "label", "copies", "_1", "hi", "lo", "host", "failed", "index", "key", "root", "group", "digest", "term", "n", "id"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, None), (6, 0, 1), (6, 1, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def of_documents(labels):
    return {
        "secrets": secret_scan.scan,
        "simhash": simhash.near_groups,
        "quality": host_quality.judge,
        "pii": pii.redactions,
        "toxicity": lambda d: toxicity.score(d, toxicity.learn(d, labels)),
        "bpe": lambda d: bpe.encode(d, VOCABULARY),
        "mix": mixing.plan_mix,
        "resample": lambda d: importance.resample(d, labels.select(F.lit("a first text").alias("text"))),
        "minhash": minhash.near_duplicates,
    }


@pytest.mark.parametrize("name", ["secrets", "simhash", "quality", "pii", "toxicity", "bpe", "mix", "resample", "minhash"])
def test_documents(spark, docs, labels, name):
    run = of_documents(labels)[name]
    got = run(docs)
    rows = sorted(map(str, got.collect()))
    assert len(rows) == len(ROWS)
    extra = docs.withColumns({c: F.lit("x") for c in CLASHES})
    assert sorted(map(str, run(extra).collect())) == rows
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r["doc_id"], set()).add(str(r))
    assert len(by_id[1]) == 1  # repeated rows get equal rows
    empty = run(docs.limit(0))
    assert empty.schema == got.schema and empty.count() == 0


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, labels, at, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    _, stage = corpus_pipeline.STAGES[at]
    for table in (docs, docs.withColumns({c: F.lit("x") for c in CLASHES}), docs.limit(0)):
        got = stage(spark, table, str(tmp_path))
        n = got.count()
        if at < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == table.columns
        assert (n == 0) == (table.count() == 0)


def test_near_dedup_keeps_one_of_each_and_rows_without_id(spark, docs):
    kept = simhash.one_of_each(docs, **corpus_pipeline.NEAR).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 2, 5, 6]
    assert sum(r["doc_id"] is None for r in kept) == 1


def test_urls(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme/path"), (4, "HTTP://A.Example.ORG/es/x?q"), (5, "http://example.org"),
        (6, "http://free-bets.net/"), (7, "http://free.net/"), (8, "http://casinos.net/"), (9, "http://CASINO.net/"),
        (10, "http://badexample.org/es/"), (11, "http://x.com/de/1#f"), (9, "http://CASINO.net/"), (None, "http://x.com/fr/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
    got = {r["page_id"]: r for r in urls.judge(pages, rules).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("", "", None, "allow")
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[5]["rule"] is None and got[10]["rule"] == "org/" and got[11]["verdict"] == "block"
    assert [got[i]["verdict"] for i in (6, 7, 8, 9)] == ["block", "allow", "allow", "block"]
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_top_k_ties_nulls_and_large_components(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 5.0]), (2, [1.0, 7.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (1, [1.0, 5.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [1e12, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = [tuple(r) for r in topk.search(vectors, F.col("vec_id") == 0, k=2).collect()]
    assert sorted(got) == [(0, 1, 9, 1024 * 1024 * 10**12), (0, 2, 1, 1024 * 1024)]
    assert topk.search(vectors.limit(0), F.col("vec_id") == 0).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, "u", None), (2, None, ""), (3, "u", "<nav>Menu</nav>"), (4, "u", "<article><h1>T &amp; x</h1><p>Some  words,\n here."), (4, "u", "<article><h1>T &amp; x</h1><p>Some  words,\n here."), (5, "u", "<div>" * 5000 + "x")],
        "page_id long, url string, html string",
    ).withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert got[1]["text"] == got[2]["text"] == got[3]["text"] == ""
    assert got[4]["text"] == "T & x\nSome words, here." and got[4]["n_chars"] == 23
    assert html_text.extract(pages.limit(0)).count() == 0


def test_minhash_links_no_empty_sets(spark, docs):
    got = {}
    for r in minhash.near_duplicates(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[1] == [(8, 1, True)] * 2 and got[None] == [(4, None, None)]
    assert [got[i] for i in (2, 3, 4)] == [[(0, 2, True)], [(0, 3, True)], [(0, 4, True)]]
    assert got[6] == [(2, 6, True)] and got[7] == [(2, 6, False)]


def test_resampling_draws_ties_by_id(spark):
    rows = [(i, "wort " * 20) for i in (3, 1, 2)] * 10 + [(None, "wort " * 20), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = importance.resample(docs, docs.limit(0), percent=100).collect()
    drawn = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["rank"])
    assert [d[0] for d in drawn] == list(range(1, 32))
    assert drawn == [(i, d, s) for i, (d, s) in enumerate(sorted([d[1:] for d in drawn], key=lambda x: (-x[1], x[0] is None, x[0])), 1)]
    assert [(r["weight"], r["rank"]) for r in got if r["doc_id"] == 9] == [(0, None)]


def test_divergence_cases(spark, docs):
    got = sorted(map(str, divergence.audit(docs).collect()))
    assert sorted(map(str, divergence.audit(docs.withColumns({c: F.lit("x") for c in CLASHES})).collect())) == got
    pairs = {(r["lang"], r["source"], r["item"]) for r in divergence.audit(docs).collect() if r["part"] == "pair"}
    assert pairs == {("en", a, b) for a in ("", "s1", "s2") for b in ("", "s1", "s2") if a != b}
    assert divergence.audit(docs.limit(0)).count() == 0
    # No term in three documents: pairs of value 0 and no terms.
    few = spark.createDataFrame([("a b", "x", "s"), ("a", "x", "t"), (None, None, None)], "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(few).collect()) == [("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)]


def test_stages_take_any_extra_column(spark, docs):
    """Names that the stages use, dots and back quotes in names, maps."""
    odd = docs.withColumns({"_kept_id": F.lit(1), "_kept_rows": F.lit(1), "row": F.lit(1), "lead_id": F.lit(1), "_mix_row": F.lit(1), "a.b": F.lit("x"), "c`d": F.lit("y"),
                            "m": F.create_map(F.lit("k"), F.lit("v"))})
    for stage in (lambda d: simhash.one_of_each(d, **corpus_pipeline.NEAR), mixing.mix):
        got = stage(odd)
        assert got.columns == odd.columns and {r["a.b"] for r in got.collect()} == {"x"}


def test_copies_under_one_id_or_none_go(spark):
    a, b = "one two three four five six seven", "quite another text of some eight words here"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (None, a), (None, a), (None, b + " x y z"), (5, b)], "doc_id long, text string")
    got = simhash.one_of_each(docs, **corpus_pipeline.NEAR).collect()
    assert sorted(map(str, got)) == sorted(map(str, docs.where("(doc_id = 3) OR text LIKE '%x y z'").collect() + docs.where("doc_id = 5").where(F.col("text") == b).limit(1).collect()))
