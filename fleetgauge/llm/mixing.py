"""Mixing sources to target weights by Pareto order sampling.

Sources share a multiple of all words by weight; no target exceeds `cap` times its source
(the excess goes to the others by weight). A source's ratio target / size gives every document
the same number of certain whole copies, its integer part, and one more copy to a sample. The
sample is drawn by Pareto order: documents are ranked by the odds of a random number divided
by their inclusion odds and taken from the top until the words that remain are reached, the
last one where it brings the sum nearer. Inclusion chances are in proportion to a preference:
a column, or, without one, the number of binary digits of the document's size, so that of two
documents the one of twice the size is a little likelier.

A source of any size is many tasks: ranks are bucketed, bucket sums tell where the sample
ends, and only the documents of that one bucket are put in order. The random number is a
digest of the id, so reruns agree.

Edge cases: a null text has size 0; a null source is a source, the last one; a source without
words gets target 0; equal rows are taken or left together; preferences that are null or not
positive count as 1; documents without an id draw their number from their text; an empty table
gives an empty table; other columns are kept by `mix` and ignored by `plan_mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import cut, whole_row

WEIGHTS = (3, 1, 2)
#: Words of the mix as a multiple of all words.
TOTAL = 1.5
#: Most copies of a source, and so of a document.
CAP = 2
#: Rows of the table of sources up to which it is sent to every task.
MAX_SENT = 20_000
#: Buckets of ranks in a source.
BUCKETS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the digest of a key."""
    digest = F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 12)
    return (F.conv(digest, 16, 10).cast("long") + 0.5) / F.lit(float(2**48))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """(source, source_size, wanted_size, target) from one row per source.

    Sources in order of their cap per weight: those before the first that stays below its
    share are capped, the others share what is left. One row per source stands here, so the
    unpartitioned windows are as long as the list of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.select(
        "*", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)).alias("weight")
    ).withColumn("most", cap * F.col("source_size"))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (
        F.lit(float(total)) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    levelled = weighed.withColumn("level", level)
    # The level rises while sources are capped and falls after the last capped one.
    highest = F.max("level").over(everything)
    return levelled.select(
        "source", "source_size", "wanted_size",
        F.least(F.col("most").cast("double"), highest * F.col("weight")).alias("target"),
    )


def _measured(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, preference_col: str | None
) -> dict[str, Column]:
    """What a decision needs of a document, under names of its own."""
    size = n_words(F.col(text_col))
    wanted = F.col(preference_col).cast("double") if preference_col else F.length(F.bin(size)).cast("double")
    return {
        "_mix_source": F.col(source_col),
        "_mix_size": size,
        "_mix_wanted": F.when(wanted > 0, wanted).otherwise(1.0),
        "_mix_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))),
        "_mix_u": uniform(F.coalesce(F.col(id_col).cast("string"), F.col(text_col))),
    }


def _with_source(rows: DataFrame, per_source: DataFrame, small: bool) -> DataFrame:
    """Attach a source's row; the small table is sent to every task, a large one is joined by shuffle."""
    side = F.broadcast(per_source) if small else per_source
    return rows.join(side, F.col("_mix_source").eqNullSafe(F.col("s")))


def _ranked(rows: DataFrame, buckets: int) -> DataFrame:
    """Pareto rank (odds of the random number over inclusion odds, as a share) and its bucket."""
    chance = F.least(
        F.lit(1 - 1e-9),
        F.col("fraction") * F.col("_mix_wanted") * F.greatest(F.col("source_size"), F.lit(1)) / F.greatest(F.col("wanted_size"), F.lit(1e-9)),
    )
    u, c = F.col("_mix_u"), F.col("_mix_chance")
    odds = (u / (1 - u)) / (c / (1 - c))
    rank = F.when(c > 0, odds / (1 + odds)).otherwise(1.0)
    return (
        rows.withColumn("_mix_chance", chance).withColumn("_mix_rank", rank)
        .withColumn("_mix_bucket", F.least(F.floor(F.col("_mix_rank") * buckets), F.lit(buckets - 1)))
    )


def _key() -> Column:
    """Order of a source's documents."""
    return F.struct("_mix_rank", "_mix_id", "_mix_size")


def thresholds(
    sized: DataFrame, weights: Sequence[float], total: float, cap: float, buckets: int
) -> tuple[DataFrame, bool]:
    """One row per source with its target, certain copies and the last rank that gets one more.

    Also whether the table is small enough to be sent to every task.
    """
    by_source = cut(
        sized.groupBy(F.col("_mix_source").alias("source")).agg(
            F.sum("_mix_size").alias("source_size"), F.sum(F.col("_mix_size") * F.col("_mix_wanted")).alias("wanted_size")
        )
    )
    small = by_source.limit(MAX_SENT + 1).count() <= MAX_SENT
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = (
        targets(by_source, weights, total, cap)
        .withColumn("certain", F.floor(ratio))
        .withColumn("fraction", ratio - F.col("certain"))
        .withColumn("need", F.col("target") - F.col("certain") * F.col("source_size"))
        .withColumnRenamed("source", "s")
    )
    ranked = _ranked(_with_source(sized, per_source, small), buckets)
    sums = ranked.groupBy("_mix_source", "_mix_bucket").agg(
        F.sum("_mix_size").alias("words"), F.first("need").alias("need")
    )
    before = Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        sums.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .where("need > 0 AND ahead < need AND ahead + words >= need")
        .groupBy(F.col("_mix_source").alias("e"))
        .agg(F.min("_mix_bucket").alias("last_bucket"), F.min("ahead").alias("ahead"))
    )
    # Without such a bucket nothing is needed, or (by rounding) everything is.
    per_source = per_source.join(last, F.col("s").eqNullSafe(F.col("e")), "left").drop("e").withColumn(
        "last_bucket", F.coalesce("last_bucket", F.when(F.col("need") > 0, F.lit(buckets)).otherwise(F.lit(-1)))
    )
    per_source = cut(per_source)
    edge = _ranked(_with_source(sized, per_source, small), buckets).where("_mix_bucket = last_bucket")
    within = Window.partitionBy("_mix_source").orderBy(_key()).rowsBetween(Window.unboundedPreceding, -1)
    taken = edge.withColumn("sum", F.col("ahead") + F.coalesce(F.sum("_mix_size").over(within), F.lit(0))).where(
        F.col("sum") + F.col("_mix_size") / 2 <= F.col("need")
    )
    ends = taken.groupBy(F.col("_mix_source").alias("e")).agg(F.max(_key()).alias("last_key"))
    return cut(per_source.join(ends, F.col("s").eqNullSafe(F.col("e")), "left").drop("e", "ahead", "need")), small


def _decided(rows: DataFrame, per_source: DataFrame, small: bool, buckets: int) -> DataFrame:
    """Adds the number of copies, which depends on the document and its source's row alone."""
    extra = (F.col("_mix_bucket") < F.col("last_bucket")) | (
        (F.col("_mix_bucket") == F.col("last_bucket")) & F.coalesce(_key() <= F.col("last_key"), F.lit(False))
    )
    ranked = _ranked(_with_source(rows, per_source, small), buckets)
    return ranked.withColumn("_mix_copies", F.col("certain") + extra.cast("long"))


def plan_mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, cap: float = CAP,
    buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    preference_col: str | None = None,
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document."""
    columns = _measured(docs, id_col, text_col, source_col, preference_col)
    sized = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(n) for n, c in columns.items()]))
    decided = _decided(sized, *thresholds(sized, weights, total, cap, buckets), buckets)
    return decided.select(
        "doc_id", F.col("_mix_size").alias("size"), "source_size", "target", F.col("_mix_copies").alias("copies"),
        (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"),
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, cap: float = CAP,
    buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    preference_col: str | None = None,
) -> DataFrame:
    """The mixed documents, all columns, each as often as the mix takes it."""
    columns = _measured(docs, id_col, text_col, source_col, preference_col)
    sized = cut(docs.select([c.alias(n) for n, c in columns.items()]))
    per_source, small = thresholds(sized, weights, total, cap, buckets)
    whole = docs.select(whole_row(docs).alias("_mix_row"), *[c.alias(n) for n, c in columns.items()])
    decided = _decided(whole, per_source, small, buckets).where("_mix_copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "_mix_copies"))
    return decided.select("_mix_row", copies.alias("_mix_copy")).select("_mix_row.*")
