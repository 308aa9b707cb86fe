"""Audit of how the sources of a language differ in their words.

Each language keeps the terms that enough of its documents hold. Every (language, source)
group and every language gives each kept term a smoothed share in billionths. Two parts come
out: how far each group lies from each other source of its language (the sum of the chi-square
terms), and the terms in which a group stands out most from its language. All arithmetic is
exact, in whole numbers.

Strings are materialised late. A first pass over the texts, by Arrow kernels, writes what each
part of a task's texts holds of a term in a group, with each text once. From there on only fixed-width
digests of terms are counted and shuffled. The least and the greatest text of each digest tell
whether it stands for several terms; the terms of such a digest get numbers of their own and are counted
apart. Texts come back at the end, for the terms that are returned.

The sums over all kept terms are worked out block by block: a block holds the counts of some
terms of a language in all its groups, and gives one partial sum for each pair of sources. A
group without a term has the same share for all such terms, so only terms that one of the two
groups holds are visited, and the rest of a pair is one product.

Edge cases: null texts, languages and sources are empty ones; groups without terms are groups; a
language whose terms are too rare keeps none, and its pairs have the value 0; equal rows count
as documents each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.kernels import distinct, slices, words
from fleetgauge.session import settle

#: What lies between terms.
GAPS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that hold a kept term.
LEAST_DOCS = 3
#: Smoothing: what each kept term counts more.
EXTRA = 1
#: Shares are whole numbers of billionths, and one.
UNIT = 1_000_000_000
#: Ranks of the terms of a group.
TOP = 200
#: Counts in a block of the pair sums.
BLOCK = 200_000
#: Rows that a task adds up before it hands them on, and bytes of text it counts at a time.
HELD_ROWS, HELD_TEXT = 1_000_000, 4 << 20
#: A term of a language: its digest, and its number among the terms of that digest.
TERM = ["digest", "sub"]


def _combined(parts: list[pa.Table]) -> pa.Table:
    """Rows of the same term and group added up."""
    table = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return table.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])


def _handed(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows, with a mark at the first one of each term."""
    coded = table["term"].combine_chunks().dictionary_encode()
    _, first = np.unique(coded.indices.to_numpy(), return_index=True)
    mark = np.zeros(table.num_rows, bool)
    mark[first] = True
    yield from table.append_column("first", pa.array(mark)).to_batches(max_chunksize=20_000)


def observed(docs: DataFrame, text_col: str, lang_col: str, source_col: str, held_rows: int = HELD_ROWS) -> DataFrame:
    """(lang, source, term, n, docs, first): occurrences and documents of a term in a part of a task's texts.

    A task adds up what it reads while few enough rows are held. `first` marks one row of each term of the part.
    """
    whole = docs.select(
        F.col(text_col).cast("string").alias("text"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col))],
    )

    def counted(part: pa.RecordBatch) -> pa.Table:
        rows, codes, known = words(part.column(0), GAPS)
        langs, sources = (part.column(i).dictionary_encode() for i in (1, 2))
        n_known, n_sources = max(1, len(known)), max(1, len(sources.dictionary))
        group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_sources + sources.indices.to_numpy(zero_copy_only=False)
        place, held = distinct(rows * n_known + codes)  # terms of a document
        at, groups = distinct(group[held // n_known] * n_known + held % n_known)  # terms of a group
        n = np.zeros(len(groups), np.int64)
        np.add.at(n, at, np.bincount(place, minlength=len(held)))
        of, code = groups // n_known, groups % n_known
        return pa.table(
            {
                "lang": langs.dictionary.take(pa.array(of // n_sources)), "source": sources.dictionary.take(pa.array(of % n_sources)),
                "term": known.take(pa.array(code)), "n": n, "docs": np.bincount(at, minlength=len(groups)).astype(np.int64),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for batch in batches:
            for part in slices(batch, 0, HELD_TEXT):
                parts.append(counted(part))
                if sum(t.num_rows for t in parts) > held_rows:
                    parts = [_combined(parts)]
                    if parts[0].num_rows > held_rows // 2:
                        yield from _handed(parts.pop())
        if parts:
            yield from _handed(_combined(parts))

    return whole.mapInArrow(run, "lang string, source string, term string, n long, docs long, first boolean")


def split_terms(seen: DataFrame, again: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """`seen` with a term's number among those of its digest, and (digest, sub, term) of all terms.

    `seen` holds texts in the rows marked `first` only. Nearly every digest stands for one term, its
    least and its greatest text are the same, and its number is 0. Where some stand for more, their
    rows are observed once more (`again`), with texts, and told apart.
    """
    bounds = settle(seen.where("first").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "terms")
    names = bounds.where("low = high").select("digest", F.lit(0).cast("long").alias("sub"), F.col("low").alias("term"))
    shared = bounds.where("low <> high").select("digest")
    columns = ["lang", "source", "digest", "sub", "n", "docs"]
    single = seen.withColumn("sub", F.lit(0).cast("long"))
    if shared.isEmpty():
        return single.select(*columns), names
    apart = seen.where("first").join(shared, "digest", "left_semi").select("digest", "term").distinct()
    number = F.row_number().over(Window.partitionBy("digest").orderBy("term")).cast("long")
    numbered = settle(apart.select("digest", "term", number.alias("sub")), "shared")
    split = again().join(numbered, ["digest", "term"])
    told = single.join(shared, "digest", "left_anti").select(*columns).unionByName(split.select(*columns))
    return told, names.unionByName(numbered.select("digest", "sub", "term"))


def share(count: Column, all_: Column, kept: Column) -> Column:
    """The smoothed share in billionths, rounded down, and one; exact for counts of any size."""
    wide = (count + EXTRA).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    whole = F.call_function("div", wide, (all_ + EXTRA * kept).cast("decimal(20,0)"))
    return 1 + whole.cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _part_sums(key: tuple, entries: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial sums of each ordered pair of sources over the terms of a block.

    Entries (digest, sub, source, p), groups (source, p0). For a group's own terms, one matrix
    holds the shares of all groups.
    """
    names = groups["source"].to_pylist()
    number = {s: i for i, s in enumerate(names)}
    rest = groups["p0"].to_numpy().astype(np.int64)
    source = np.fromiter((number[s] for s in entries["source"].to_pylist()), np.int64, entries.num_rows)
    p = entries["p"].to_numpy().astype(np.int64)
    terms = np.stack([entries["digest"].to_numpy(), entries["sub"].to_numpy()], axis=1)
    _, term = np.unique(terms, axis=0, return_inverse=True)
    term = term.reshape(-1)
    by_term = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[by_term], np.arange(term.max() + 2 if len(term) else 1))
    n = len(names)
    value, union = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
    for a in np.unique(source):
        mine = np.flatnonzero(source == a)
        for at in range(0, len(mine), 1 + 1_000_000 // n):
            own = mine[at : at + 1 + 1_000_000 // n]
            first, sizes = starts[term[own]], starts[term[own] + 1] - starts[term[own]]
            row = np.repeat(np.arange(len(own)), sizes)
            entry = by_term[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)]
            other = np.broadcast_to(rest, (len(own), n)).copy()
            there = np.zeros((len(own), n), bool)
            other[row, source[entry]], there[row, source[entry]] = p[entry], True
            mine_p = p[own][:, None]
            # a's terms, seen from a; and from the groups that lack them.
            value[a] += ((mine_p - other) ** 2 // other).sum(axis=0)
            value[:, a] += np.where(there, 0, (rest[None, :] - mine_p) ** 2 // mine_p).sum(axis=0)
            union[a] += len(own)
            union[:, a] += (~there).sum(axis=0)
    a, b = (x.reshape(-1) for x in np.indices((n, n)))
    some = (a != b) & (union.reshape(-1) > 0)
    listed = pa.array(names, pa.string())
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()] * int(some.sum()), pa.string()),
            "source": pc.take(listed, pa.array(a[some])), "item": pc.take(listed, pa.array(b[some])),
            "value": value.reshape(-1)[some], "terms": union.reshape(-1)[some],
        }
    )


def pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of sources of a language.

    `shares` (lang, source, digest, sub, p) of occurring terms, `groups` (lang, source, kept, p0, blocks).
    """
    of_lang = groups.groupBy("lang").agg(F.first("blocks").alias("blocks"))
    block = F.pmod(F.xxhash64(*TERM), F.col("blocks"))
    entries = shares.join(of_lang, "lang").select("lang", block.alias("block"), "source", *TERM, "p")
    per_block = groups.where("kept > 0").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "p0"
    )
    sums = (
        entries.groupBy("lang", "block").cogroup(per_block.groupBy("lang", "block"))
        .applyInArrow(_part_sums, "lang string, source string, item string, value long, terms long")
        .groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("terms").alias("terms"))
    )
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "source", "kept", "p0").join(other, "lang").where("source <> item")
    absent = (F.col("kept") - F.coalesce("terms", F.lit(0))).cast("decimal(20,0)") * distance(F.col("p0"), F.col("q0")).cast("decimal(18,0)")
    value = F.coalesce(F.col("value"), F.lit(0)) + F.when(F.col("kept") > 0, absent).otherwise(F.lit(0))
    return pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", value.cast("long").alias("value"))


def audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, digest_bits: int = 64,
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank): parts `pair` and `term` of every group."""
    digest = F.xxhash64("term") if digest_bits == 64 else F.xxhash64("term").bitwiseAND((1 << digest_bits) - 1)
    again = lambda: observed(docs, text_col, lang_col, source_col).withColumn("digest", digest)
    seen = settle(again().withColumn("term", F.when(F.col("first"), F.col("term"))), "observed")
    told, names = split_terms(seen, again)
    counts = told.groupBy("lang", "source", *TERM).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # All groups of a term meet, one row each, for its sums over the language.
    of_term = Window.partitionBy("lang", *TERM)
    summed = counts.select(
        "lang", "source", *TERM, "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("lang_docs"),
        (F.col("source") == F.min("source").over(of_term)).alias("once"),
    )
    held = settle(summed.where(F.col("lang_docs") >= least_docs).drop("lang_docs"), "held")
    # One row a language, and one a group, also of those without terms.
    sizes = settle(
        held.groupBy("lang", "source").agg(F.sum("n").alias("all"), F.count("*").alias("entries"), F.count_if("once").alias("once")), "sizes"
    )
    langs = sizes.groupBy("lang").agg(F.sum("once").alias("kept"), F.sum("all").alias("lang_all"))
    sizes = sizes.drop("once")
    every = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col))]
    ).distinct()
    groups = every.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kept", "lang_all", "all", "entries")]
    )
    of_lang = Window.partitionBy("lang")
    groups = settle(
        groups.withColumn("p0", F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("all"), F.col("kept"))))
        .withColumn("blocks", 1 + F.call_function("div", F.sum("entries").over(of_lang), F.lit(block).cast("long"))),
        "groups",
    )
    shares = held.join(groups.select("lang", "source", "kept", "lang_all", "all"), ["lang", "source"]).select(
        "lang", "source", *TERM, share(F.col("n"), F.col("all"), F.col("kept")).alias("p"),
        share(F.col("lang_n"), F.col("lang_all"), F.col("kept")).alias("q"),
    )
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(shares.drop("q"), groups).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_rank).alias("rank")
    )
    # The value of the last rank is known without texts; those that reach it get theirs, and order ties.
    better = shares.where("p > q").select("lang", "source", *TERM, distance(F.col("p"), F.col("q")).alias("value"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    least = (
        better.select("lang", "source", "value", F.row_number().over(first).alias("place")).where(F.col("place") <= top)
        .groupBy("lang", "source").agg(F.min("value").alias("least"))
    )
    reached = better.join(least, ["lang", "source"]).where("value >= least")
    named = reached.join(names, TERM).select("lang", "source", F.col("term").alias("item"), "value")
    terms = named.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
