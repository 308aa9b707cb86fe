"""SimHash near-duplicates by tiled exact comparison.

Every document gets a fingerprint of 64-bit words, and fingerprints link when at most `radius`
bits differ. Distinct fingerprints, ordered by their number of set bits, are packed into tiles
of bounded size; a tile meets only the tiles whose bit counts lie within the radius, and each
meeting is one exclusive-or matrix with bit counts in numpy. A meeting returns a spanning
forest of the links it saw, never the links themselves, so that a group of thousands of near
copies stays linear. Components of the forests are found by alternating star contraction.

`similar_groups` takes fingerprints as a search only: texts of few shingles meet where they share
one of their least shingles, longer ones within a wide radius, and what met is confirmed by the
exact Jaccard similarity of the shingle sets. Groups of candidates are cut into chunks that meet
each other, so that a large group is many tasks; a meeting again returns a spanning forest.

Edge cases: a null or blank text has no shingle and fingerprint zero, linked like any other;
fewer words than a shingle are one shingle; equal rows share a fingerprint and a component;
null ids take part but are no component's name (a component of null ids only is null); an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import cut, map_rows, whole_row

#: The seed of a shingle's XXH64.
SEED = 42
#: Fingerprints in a tile.
TILE = 16_384
#: Candidate texts in a chunk.
CHUNK = 256
#: Room for the rounding of a similarity.
TINY = 1e-9
#: Odd multipliers that derive further hash words from the first (64-bit finaliser steps).
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingles(text: str | None, width: int) -> list[bytes]:
    """The text's word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = (text or "").encode("utf-8").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def _spread(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another hash word of the same shingles."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * salt) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def _set_in_most(hashes: np.ndarray) -> int:
    """The number whose bit is 1 where over half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int, n_words: int = 1, as_set: bool = False) -> bytes:
    """The fingerprint of a text: n_words 64-bit words, most significant byte first."""
    found = shingles(text, width)
    return _folded(_hashed(set(found) if as_set else found), n_words)


def _hashed(found: list[bytes] | set[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), dtype=np.uint64, count=len(found))


def _folded(hashes: np.ndarray, n_words: int) -> bytes:
    words = [_set_in_most(_spread(hashes, i) if i else hashes) for i in range(n_words)]
    return b"".join(w.to_bytes(8, "big") for w in words)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    return np.unique(_hashed(set(shingles(text, width))))


def set_key(hashes: np.ndarray) -> bytes:
    """The name of a shingle set."""
    return hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest()


def least_shingles(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """So many of the least hashes that two sets of that similarity share one of them."""
    return hashes[: len(hashes) - ceil(similarity * len(hashes) - TINY) + 1] if len(hashes) else hashes


def fingerprints(
    docs: DataFrame, width: int = 4, n_words: int = 1, as_set: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, fp, ones) of every document."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("fp", T.BinaryType()),
            T.StructField("ones", T.IntegerType()),
        ]
    )

    def one(doc_id, text):
        fp = fingerprint(text, width, n_words, as_set)
        return doc_id, fp, int.from_bytes(fp, "big").bit_count()

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), one, schema)


def _tile_classes(counts: dict[int, int], tile: int, radius: int) -> list[tuple]:
    """Rows (ones, base, parts, first, last): bit count to its tiles and the tiles it meets.

    Neighbouring bit counts share a tile while they fit; a frequent one gets several tiles.
    """
    classes: list[list] = []  # [lowest, highest, rows, parts]
    for ones in sorted(counts):
        n = counts[ones]
        if classes and classes[-1][3] == 1 and classes[-1][2] + n <= tile:
            classes[-1][1] = ones
            classes[-1][2] += n
        else:
            classes.append([ones, ones, n, max(1, -(-n // tile))])
    base, at = [], 0
    for c in classes:
        base.append(at)
        at += c[3]
    rows = []
    for c, b in zip(classes, base):
        near = [i for i, o in enumerate(classes) if o[0] - c[1] <= radius and c[0] - o[1] <= radius]
        first, last = base[near[0]], base[near[-1]] + classes[near[-1]][3] - 1
        rows += [(ones, b, c[3], first, last) for ones in range(c[0], c[1] + 1)]
    return rows


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, coarse: int | None) -> np.ndarray:
    """For each row of a (and then b) the first row of its group within this meeting.

    Rows are fingerprints as uint64 words; b is None where a tile meets itself. With several
    words, `coarse` bounds the difference of the first word, and only what passes is compared
    in full.
    """
    n, other = len(a), a if b is None else b
    shift = 0 if b is None else n
    label = np.arange(n + (0 if b is None else len(b)))
    first_radius = radius if coarse is None else coarse
    high, wide = np.ascontiguousarray(a[:, 0]), np.ascontiguousarray(other[:, 0])
    for i in range(0, n, 64):
        rows = high[i : i + 64, None]
        for j in range(i // 4096 * 4096 if b is None else 0, len(other), 4096):
            near = np.bitwise_count(rows ^ wide[None, j : j + 4096]) <= first_radius
            if not near.any():
                continue
            for k in np.flatnonzero(near.any(axis=1)):
                hits = np.flatnonzero(near[k]) + j
                if b is None:
                    hits = hits[hits > i + k]
                if a.shape[1] > 1 and len(hits):
                    bits = np.bitwise_count(a[i + k] ^ other[hits]).sum(axis=1, dtype=np.int64)
                    hits = hits[bits <= radius]
                if not len(hits):
                    continue
                joined = label[hits + shift]
                low = min(int(joined.min()), int(label[i + k]))
                if low != joined.max() or low != label[i + k]:
                    gone = np.unique(np.append(joined, label[i + k]))
                    for g in gone[gone != low] if len(gone) <= 4 else [gone[gone != low]]:
                        label[np.isin(label, g) if len(gone) > 4 else label == g] = low
    return label


def links(uniq: DataFrame, n_words: int, radius: int, coarse: int | None, tile: int) -> DataFrame:
    """(hi, lo): spanning forests of the links between distinct fingerprints (fp, ones)."""
    spark = uniq.sparkSession
    counts = {r["ones"]: r["n"] for r in uniq.groupBy("ones").agg(F.count("*").alias("n")).collect()}
    classes = spark.createDataFrame(
        _tile_classes(counts, tile, radius) or [(-1, 0, 1, 0, 0)],
        "ones int, base long, parts long, first long, last long",
    )
    placed = uniq.join(F.broadcast(classes), "ones").select(
        (F.col("base") + F.pmod(F.xxhash64("fp"), F.col("parts"))).alias("tile"), "first", "last", "fp"
    )

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        fps = b"".join(table["fp"].to_pylist())
        return pa.table(
            {"tile": [key[0].as_py()], "first": table["first"][:1], "last": table["last"][:1], "fps": [fps]}
        )

    tiles = placed.groupBy("tile").applyInArrow(pack, "tile long, first long, last long, fps binary")
    meetings = tiles.select("tile", F.explode(F.sequence("first", "last")).alias("other"), "fps").select(
        F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "fps"
    )

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        packed = dict(zip(table["tile"].to_pylist(), table["fps"].to_pylist()))
        sides = [np.frombuffer(packed[t], ">u8").astype(np.uint64).reshape(-1, n_words) for t in sorted(packed)]
        names = [v[i : i + 8 * n_words] for t in sorted(packed) for v in [packed[t]] for i in range(0, len(v), 8 * n_words)]
        apart = key[0].as_py() != key[1].as_py()
        if apart and len(sides) < 2:  # the partner tile holds nothing
            return pa.table({"hi": pa.array([], pa.binary()), "lo": pa.array([], pa.binary())})
        label = forest(sides[0], sides[1] if apart else None, radius, coarse)
        lowest: dict[int, bytes] = {}
        members = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
        for m in members:
            g = int(label[m])
            if g not in lowest or names[m] < lowest[g]:
                lowest[g] = names[m]
        pairs = [(names[m], lowest[int(label[m])]) for m in members if names[m] != lowest[int(label[m])]]
        return pa.table(
            {"hi": pa.array([p[0] for p in pairs], pa.binary()), "lo": pa.array([p[1] for p in pairs], pa.binary())}
        )

    return meetings.groupBy("t1", "t2").applyInArrow(meet, "hi binary, lo binary")


def components(edges: DataFrame) -> DataFrame:
    """(hi, lo) with lo the smallest node of hi's component, for all nodes but the smallest.

    Alternating star contraction: every round hangs nodes on the smallest neighbour known.
    Joins and aggregates only, so that a node with very many links is split like any hot key.
    """
    edges, before = cut(edges.distinct()), None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if seen == before or not seen["n"]:
            return edges
        before = seen
        low = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low"))
        wide = edges.join(low, F.col("lo") == F.col("node"), "left").select(
            "hi", F.coalesce("low", "lo").alias("lo")
        )
        wide = wide.distinct()
        low = wide.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low"))
        paired = wide.join(low, F.col("hi") == F.col("node")).select("hi", "lo", "low")
        edges = cut(
            paired.select(
                F.explode(
                    F.array(
                        F.struct("hi", F.col("low").alias("lo")),
                        F.struct(F.col("lo").alias("hi"), F.col("low").alias("lo")),
                    )
                ).alias("e")
            )
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )


def near_groups(
    docs: DataFrame, width: int = 4, n_words: int = 1, radius: int = 4, coarse: int | None = None,
    as_set: bool = False, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    marks = cut(fingerprints(docs, width, n_words, as_set, id_col, text_col))
    uniq = cut(marks.groupBy("fp").agg(F.first("ones").alias("ones"), F.min("doc_id").alias("least")))
    stars = components(links(uniq.select("fp", "ones"), n_words, radius, coarse, tile))
    rooted = (
        uniq.join(stars, F.col("fp") == F.col("hi"), "left")
        .select("fp", "least", F.coalesce("lo", "fp").alias("root"))
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(named, "root").select("fp", "component_id")
    return marks.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def alike(sets: list[np.ndarray], similarity: float, shift: int = 0) -> np.ndarray:
    """For each set the first one of its group; with a shift only sets before it meet those from it on."""
    sizes = np.array(list(map(len, sets)))
    starts = np.cumsum(sizes) - sizes
    flat, codes = np.unique(np.concatenate(sets), return_inverse=True)
    label, mark = np.arange(len(sets)), np.zeros(len(flat), np.int64)
    for i in range(shift or len(sets) - 1):
        at = shift or i + 1
        if (label[at:] == label[i]).all():
            continue
        own = codes[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[codes[starts[at] :]], starts[at:] - starts[at])
        mark[own] = 0
        hits = np.flatnonzero(common >= similarity * (sizes[i] + sizes[at:] - common) - TINY) + at
        if len(hits):
            joined = np.unique(label[np.append(hits, i)])
            label[np.isin(label, joined)] = joined[0]
    return label


_PAIRS = "hi binary, lo binary"


def _pairs(keys: list[bytes], label: np.ndarray) -> list[tuple[bytes, bytes]]:
    return [(keys[i], keys[g]) for i, g in enumerate(label.tolist()) if i != g]


def _pair_table(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table(
        {"hi": pa.array([max(p) for p in pairs], pa.binary()), "lo": pa.array([min(p) for p in pairs], pa.binary())}
    )


def confirmed(members: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """(hi, lo): spanning forests of the similar sets among members (root, n, key, hashes) of one root.

    Small groups share a task, large ones are cut into chunks.
    """
    small, large = members.where(F.col("n") <= chunk), members.where(F.col("n") > chunk)
    tasks = small.count() // chunk + 1

    def within(key: tuple, table: pa.Table) -> pa.Table:
        groups: dict[bytes, dict[bytes, bytes]] = {}
        for root, name, hashes in zip(*(table[c].to_pylist() for c in ("root", "key", "hashes"))):
            groups.setdefault(root, {})[name] = hashes
        pairs = []
        for found in groups.values():
            sets = [np.frombuffer(h, "<u8") for h in found.values()]
            pairs += _pairs(list(found), alike(sets, similarity))
        return _pair_table(pairs)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        found = dict(zip(table["key"].to_pylist(), table["hashes"].to_pylist()))
        return pa.table(
            {
                "root": [key[0].as_py()], "part": [key[1].as_py()], "parts": table["parts"][:1],
                "keys": pa.array([list(found)], pa.list_(pa.binary())), "sets": pa.array([list(found.values())], pa.list_(pa.binary())),
            }
        )

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        packed = dict(zip(table["part"].to_pylist(), zip(table["keys"].to_pylist(), table["sets"].to_pylist())))
        if first != second and len(packed) < 2:  # the partner holds nothing
            return _pair_table([])
        keys = [k for t in sorted(packed) for k in packed[t][0]]
        sets = [np.frombuffer(h, "<u8") for t in sorted(packed) for h in packed[t][1]]
        return _pair_table(_pairs(keys, alike(sets, similarity, len(packed[first][0]) if first != second else 0)))

    near = small.groupBy(F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task")).applyInArrow(within, _PAIRS)
    parts = F.ceil(F.col("n") / chunk)
    chunks = (
        large.select("root", F.pmod(F.xxhash64("key"), parts).alias("part"), parts.alias("parts"), "key", "hashes")
        .groupBy("root", "part")
        .applyInArrow(pack, "root binary, part long, parts long, keys array<binary>, sets array<binary>")
    )
    meetings = chunks.select("root", "part", "keys", "sets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    meetings = meetings.select("root", F.least("part", "other").alias("t1"), F.greatest("part", "other").alias("t2"), "part", "keys", "sets")
    return near.unionByName(meetings.groupBy("root", "t1", "t2").applyInArrow(meet, _PAIRS))


def similar_rows(
    docs: DataFrame, width: int, n_words: int, radius: int, coarse: int | None, similarity: float, short: int,
    tile: int = TILE, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, digest, root) of every row; links are shingle sets of at least that Jaccard similarity.

    `digest` is the text's, `root` names the group.

    Texts of at most `short` shingles and their partners are candidates where they share one of their
    least shingles, which no pair of that similarity fails to do; longer ones by fingerprint.
    """
    reach = int(short / similarity + TINY)
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("digest"),
        F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("row"),
        F.col(text_col).alias("text"),
    )

    def marked(doc_id, digest, row, text):
        hashes = shingle_set(text, width)
        fp = _folded(hashes, n_words) if len(hashes) > short else b""
        few = least_shingles(hashes, similarity).astype(np.int64).tolist() if len(hashes) <= reach else []
        return doc_id, digest, row, set_key(hashes), fp, int.from_bytes(fp, "big").bit_count(), few

    marks = cut(
        map_rows(
            named, marked,
            T.StructType(
                [
                    T.StructField("doc_id", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("row", T.LongType()),
                    T.StructField("key", T.BinaryType()), T.StructField("fp", T.BinaryType()),
                    T.StructField("ones", T.IntegerType()), T.StructField("few", T.ArrayType(T.LongType())),
                ]
            ),
        )
    )
    uniq = cut(
        marks.groupBy("key").agg(
            F.first("fp").alias("fp"), F.first("ones").alias("ones"), F.first("few").alias("few"),
            F.min("doc_id").alias("least"), F.min("row").alias("row"),
        )
    )
    # Candidates: keys hang on the least key with the same fingerprint or the same least shingle.
    long_ = uniq.where(F.length("fp") > 0)
    of_fp = cut(long_.groupBy("fp").agg(F.first("ones").alias("ones"), F.min("key").alias("low")))
    by_fp = links(of_fp.select("fp", "ones"), n_words, radius, coarse, tile)
    hi, lo = (of_fp.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_key")) for c in ("hi", "lo"))
    by_fp = by_fp.join(hi, "hi").join(lo, "lo").select(F.col("hi_key").alias("a"), F.col("lo_key").alias("b"))
    same_fp = long_.join(of_fp.select("fp", "low"), "fp").select(F.col("key").alias("a"), F.col("low").alias("b"))
    shared = uniq.select("key", F.explode("few").alias("shingle"))
    lowest = shared.groupBy("shingle").agg(F.min("key").alias("low"), F.count("*").alias("n")).where("n > 1")
    by_shingle = shared.join(lowest, "shingle").select(F.col("key").alias("a"), F.col("low").alias("b"))
    met = by_fp.unionByName(same_fp).unionByName(by_shingle).where("a <> b")
    stars = components(met.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    # Members of groups of two and more, with their shingle sets from the texts.
    heads = stars.groupBy(F.col("lo").alias("root")).agg((F.count("*") + 1).alias("n"))
    inside = stars.select(F.col("hi").alias("key"), F.col("lo").alias("root")).unionByName(
        heads.select(F.col("root").alias("key"), "root")
    )
    wanted = inside.join(heads, "root").join(uniq.select("key", "row"), "key")

    def filled(root, n, key, text):
        hashes = shingle_set(text, width)
        return root, n, key, hashes.astype("<u8").tobytes() if set_key(hashes) == key else None

    members = map_rows(
        wanted.join(named.select("row", "text"), "row").select("root", "n", "key", "text"), filled,
        T.StructType(
            [
                T.StructField("root", T.BinaryType()), T.StructField("n", T.LongType()),
                T.StructField("key", T.BinaryType()), T.StructField("hashes", T.BinaryType()),
            ]
        ),
    ).where("hashes IS NOT NULL")
    links_ = components(confirmed(cut(members), similarity, chunk))
    rooted = uniq.join(links_, F.col("key") == F.col("hi"), "left").select("key", F.coalesce("lo", "key").alias("root"))
    return marks.join(rooted, "key").select("doc_id", "digest", "root")


def similar_groups(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, component_id) of every document, by `similar_rows`."""
    rows = cut(similar_rows(docs, **options))
    named = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(named, "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, one of each group: the one with the smallest id, of equal ids
    that with the smallest digest of its text.

    A row is known by its id and its text, so an id that stands for several texts keeps those that
    lead a group; rows without an id come last. Of rows with the same id and text one stays.
    """
    rows = cut(similar_rows(docs, id_col=id_col, text_col=text_col, **options))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("k"))
    leads = first.select(F.col("k.doc_id").alias("lead_id"), F.col("k.digest").alias("lead_digest"))
    known = F.col("id").eqNullSafe(F.col("lead_id")) & (F.col("digest") == F.col("lead_digest"))
    times = rows.groupBy(F.col("doc_id").alias("id"), "digest").agg(F.count("*").alias("rows"))
    kept = cut(leads.join(times, known).select("lead_id", "lead_digest", "rows"))
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), whole_row(docs).alias("row"))
    joined = whole.join(kept, known)
    single, repeated = joined.where("rows = 1"), joined.where("rows > 1").dropDuplicates(["id", "digest"])
    return single.select("row.*").unionByName(repeated.select("row.*"))
