"""Resampling documents by importance towards a target corpus.

Features are runs of one to three consecutive words, hashed into buckets by CRC-32. A bucket's
gain is the log ratio of its smoothed shares in the target and in the corpus; a document's
weight is the sum of the gains of its features. Documents are drawn without replacement by
adding Gumbel noise, a digest of the id, to the weight and taking the highest sums.

Texts are cut by Arrow kernels into dictionary-encoded words. A pair of neighbouring codes is
one number, and so is a pair and its next word; each distinct number gets its CRC once, by
continuing the CRC of its left part, and all places take theirs from there. Two passes read
the texts: one adds up bucket counts (as many rows a task as there are buckets), one adds up gains
by document. The order of the draw comes from ranges of scores and the sizes of the ranges
before them, so no task sees more than its range.

Edge cases: null and blank texts have no feature and weight 0; a null id is an empty one in
the digest and the last in a tie; equal rows get equal weights and scores and neighbouring ranks;
an empty corpus gives an empty table, an empty target the gains of a target without counts;
texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.kernels import distinct, slices, words
from fleetgauge.session import settle

#: What lies between words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
#: Drawn documents in a hundred of those that may be drawn.
PERCENT = 5
SEED = 42
#: Bytes of text that are held as runs at a time.
HELD = 2 << 20


def runs(texts: pa.Array, n_buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The row of every word, and for runs of one, two and three words: (row, place, bucket by place)."""
    rows, codes, known = words(texts, GAPS)
    known = [w.encode() for w in known.to_pylist()]
    crcs = [crc32(w) for w in known]
    later = [b" " + w for w in known]
    found = [(rows, codes, np.array(crcs, np.int64) % n_buckets)]
    at = np.arange(len(rows))  # where a run begins
    place = codes
    for width in (2, 3):
        whole = rows[at[: len(at) - 1]] == rows[width - 1 :] if len(rows) >= width else np.zeros(0, bool)
        # Runs of the width before begin at `at`; those that go on in the same text stay.
        left, at = place[: len(whole)][whole], at[: len(whole)][whole]
        pairs, new = distinct(left * len(known) + codes[at + width - 1])
        crcs = [crc32(later[w], crcs[l]) for l, w in zip((new // max(1, len(known))).tolist(), (new % max(1, len(known))).tolist())]
        found.append((rows[at], pairs, np.array(crcs, np.int64) % n_buckets))
        # Spread over all beginnings again, so that the next width finds its left parts.
        place = np.zeros(len(rows), np.int64)
        place[at] = pairs
        at = np.arange(len(rows) - width + 1) if len(rows) >= width else at[:0]
    return rows, found


def bucket_counts(texts: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts of a one-column table by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0, HELD):
                for _, place, buckets in runs(part.column(0), n_buckets)[1]:
                    by_place = np.bincount(place, minlength=len(buckets))
                    np.add.at(counts, buckets, by_place)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(counts[there])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from the (bucket, n) of both sides; one row a bucket."""
    every = source.sparkSession.range(n_buckets).select(F.col("id").alias("bucket"))
    both = (
        every.join(source.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    )
    total = lambda c: F.sum(c).over(Window.partitionBy())
    ratio = (F.col("t") + 1) * (total("s") + n_buckets) / ((F.col("s") + 1) * (total("t") + n_buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    schema = "doc_id long, n_words long, n_features long, weight long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, HELD):
                rows, found = runs(part.column(1), len(gains))
                n_words = np.bincount(rows, minlength=part.num_rows)
                n_features = np.zeros(part.num_rows, np.int64)
                weight = np.zeros(part.num_rows, np.int64)
                for of, place, buckets in found:
                    if not len(of):
                        continue
                    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                    weight[of[starts]] += np.add.reduceat(gains[buckets][place], starts)
                    n_features[of[starts]] += np.diff(np.append(starts, len(of)))
                columns = [part.column(0), *(pa.array(x.astype(np.int64)) for x in (n_words, n_features, weight))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the digest of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """`scored` with rank: 1, 2, ... for so many in a hundred rows of the highest score, else null.

    Rows are dealt into ranges of the order and sorted there; a rank is the place in the range
    plus the rows of the ranges before, one number a range.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    dealt = settle(
        scored.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ranges",
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all")
    )
    place = F.col("_before") + F.col("_place") + 1
    return dealt.join(sizes, "_range").withColumn(
        "rank", F.when(place <= F.floor(percent * F.col("_all") / 100), place)
    ).drop("_range", "_place", "_before", "_all")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    n_buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it is not drawn."""
    # Settled, since the sums over all buckets would read the texts once more.
    counts = [settle(bucket_counts(t, n_buckets), "counts") for t in (docs.select(text_col), target.select(target_text_col))]
    gains = bucket_gains(*counts, n_buckets)
    by_bucket = np.zeros(n_buckets, np.int64)
    for bucket, gain in gains.collect():  # as many rows as there are buckets
        by_bucket[bucket] = gain
    scored = settle(
        weights(docs, by_bucket, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored"
    )
    drawn = ranked(scored.where(F.col("n_words") >= least_words), percent)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
