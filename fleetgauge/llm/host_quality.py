"""Quality rules by host: failures summed by domain, shrunk by a beta prior, joined back.

Documents are measured with built-in functions only. Per host the share of documents that fail
a rule is shrunk towards the corpus: the beta prior's mean and strength come from the first two
moments of the hosts' shares (empirical Bayes), less what sampling alone spreads them, so a host with
three documents is judged mostly by the corpus and a large one by itself. A host whose shrunk rate exceeds the limit is rejected
with all its documents.

Edge cases: a null text has no words and fails; a null host is a host of its own; repeated rows
count each; with one host, or equal shares, the prior is as strong as its bound; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import BLANKS, cut

#: Words under which a document is too short, and the percentage of repeated words over which it repeats.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Percentages over which symbols (of word characters) and repeated lines (of lines) fail at host level.
MOST_SYMBOLS, MOST_DUP_LINES = 10, 30
#: Shrunk failure rate over which a host is rejected.
MOST_FAILING = 0.5
#: Bounds of the prior's strength, in documents.
STRENGTH = (1.0, 1e6)
SYMBOLS = "#*$%&|<>"


def _bind(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice.

    Windows are sorted by hash with their positions; equal neighbours are repeats, and the
    windows' union is summed along the positions: n log n in the words of a text.
    """

    def windows(w: Column) -> Column:
        hashed = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.array_sort(F.filter(hashed, lambda s: s["i"] < F.size(w) - 2))

    def positions(s: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        twice = F.filter(s, lambda x, j: same(F.get(s, j - 1), x) | same(F.get(s, j + 1), x))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return _bind(words, lambda w: _bind(windows(w), lambda s: _bind(positions(s), covered)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts and rule failures of every document, one narrow row each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    counted = _bind(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    distinct = _bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    counts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(host_col).alias("host"),
        counted.alias("w"),
        distinct.alias("l"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select(
        "doc_id", "host",
        F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.col("l.n") - F.col("l.d")).cast("long").alias("n_dup_lines"),
        F.col("w.r").cast("long").alias("n_repeat_words"), F.col("l.n").cast("long").alias("n_lines"),
    )
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    more = (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")) | (
        100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines")
    )
    return counts.withColumn("base_failed", base).withColumn("failed", base | more)


def _prior() -> tuple[Column, Column]:
    """Mean and strength of the beta prior from the sums over hosts (k, n, f, nn, ffn).

    The weighted spread of shares is expected to be m (1 - m) ((k - 1) + r (n - nn / n - (k - 1))), r being the
    correlation within a host; the strength is 1 / r - 1. Where hosts spread no more than sampling
    does, or hold one document each, nothing tells them apart and the prior is as strong as its bound.
    """
    mean = F.col("f") / F.col("n")
    between = (F.col("ffn") - F.col("f") * mean) / F.nullif(mean * (1 - mean), F.lit(0.0)) - (F.col("k") - 1)
    room = F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)
    strength = F.when((between > 1e-9) & (room > 1e-9), room / between - 1).otherwise(STRENGTH[1])
    return mean.alias("mean"), F.least(F.lit(STRENGTH[1]), F.greatest(F.lit(STRENGTH[0]), strength)).alias("strength")


def host_verdicts(measured: DataFrame, most_failing: float = MOST_FAILING) -> DataFrame:
    """(host, n_docs, n_failed, rate, rejected) of every host."""
    hosts = measured.groupBy("host").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")
    )
    # Beta-binomial moments: the spread of the hosts' shares less what sampling alone gives them.
    sums = hosts.agg(
        F.count("*").alias("k"), *[F.sum(c).cast("double").alias(n) for n, c in (("n", F.col("n_docs")), ("f", F.col("n_failed")))],
        F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("nn"),
        F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs")).alias("ffn"),
    )
    prior = sums.select(*_prior()).first()
    mean, weight = prior["mean"] or 0.0, prior["strength"] or STRENGTH[1]
    rate = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate > most_failing).alias("rejected"))


def judge(
    docs: DataFrame, most_failing: float = MOST_FAILING,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """Every document's counts, base verdict, host verdict and whether it is kept."""
    measured = cut(measures(docs, id_col, text_col, host_col))
    verdicts = host_verdicts(measured, most_failing).select(F.col("host").alias("h"), "rejected")
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("h")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("rejected")).alias("kept"), F.col("rejected").alias("host_rejected"),
    )
