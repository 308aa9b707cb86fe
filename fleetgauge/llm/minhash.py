"""MinHash near-duplicates by a multi-index Hamming join.

A text's set of word shingles gets a signature of 64 slots of 16 bits, each the low bits of a
least hash. The signature distance is the number of slots that differ; two sets of Jaccard
similarity s differ in each slot with a probability of about 1 - s. Signatures are cut into
16 chunks of 4 slots. By pigeonhole two signatures within distance 31 have a chunk with at
most one wrong slot, so each signature enters the index under every chunk with every choice of
one slot left out, 64 keys of three slots, and each pair within that distance shares a key:
the join misses none. Of pairs at similarity 0.8 itself one in twelve million lies beyond it
(the tail of a binomial of 64 draws at 0.2), of more similar ones fewer.

Entries carry a sketch, one bit of each of 128 least hashes, and the size of the set. Within a
key only pairs whose sizes and sketches are near stay candidates (35 bits of 128 at most; a
pair at 0.8 has 12.8 on average, and one in a hundred million more than 35). Entries
are dealt into ranges of (key, entry) and sorted, so a frequent key is many tasks; a run of
equal keys that is long or touches the end of its range is met in a second step, first with
the run's head, and where that leaves several groups, tile by tile. What a step returns is
a spanning forest of the pairs it saw, never the pairs.

Groups of candidates are then settled on the full sets, those of many shingles in parts of bounded
size: first each part with itself and the head of its group, then, where several groups are left,
parts with each other. Links are exact; components of links are found by star contraction.

Edge cases: a text of one word is one shingle; null and blank texts have an empty set and link
with nothing, not with each other; equal sets are one entry; a null id takes part but names no
component (one of null ids only is null, and `kept` too); an empty table gives an empty table;
texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import map_rows
from fleetgauge.llm.simhash import components, set_key, shingle_set
from fleetgauge.session import settle

SLOTS, CHUNK = 64, 4
#: Least hashes behind the sketch; the first SLOTS of them are the slots.
MINIMA = 128
#: Most bits of the sketch in which a candidate differs.
SKETCH_RADIUS = 35
#: Similarity of linked sets, in hundredths.
PERCENT = 80
#: Entries of a key that meet at once.
TILE = 4096
#: Shingles of a group that are compared at once.
PART = 1 << 20
_PAIRS = "hi binary, lo binary"
#: Multipliers and offsets of the hash functions, from the digests of their numbers.
_A = np.array([xxhash.xxh64_intdigest(f"a{i}") | 1 for i in range(MINIMA)], np.uint64)
_B = np.array([xxhash.xxh64_intdigest(f"b{i}") for i in range(MINIMA)], np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        x = hashes[at : at + 256, None] * _A + _B
        x ^= x >> np.uint64(32)
        low = np.minimum(low, (x * _A).min(axis=0))
    return low


def signature(low: np.ndarray) -> bytes:
    """The slots, 16 bits each."""
    return (low[:SLOTS] >> np.uint64(20)).astype("<u2").tobytes()


def sketch(low: np.ndarray) -> np.ndarray:
    """Two words of one bit of each least hash."""
    return np.packbits((low >> np.uint64(40)).astype(np.uint8) & 1, bitorder="little").view("<i8")


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """The keys of each signature (a row of slots): every chunk without each of its slots."""
    chunks = signatures.reshape(len(signatures), -1, CHUNK).astype(np.uint64)
    keys = []
    for which, rest in enumerate(combinations(range(CHUNK), CHUNK - 1)):
        packed = np.zeros(chunks.shape[:2], np.uint64)
        for slot in rest:
            packed = packed << np.uint64(16) | chunks[:, :, slot]
        # The upper 16 bits tell the chunk and the slot left out.
        tag = np.arange(chunks.shape[1], dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(which)
        keys.append(packed | tag << np.uint64(48))
    return np.concatenate(keys, axis=1).view(np.int64)


def roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`label` with the groups of the pairs (a, b) joined; a label is the least place of its group."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            return label


def meet(size: np.ndarray, bits: np.ndarray, label: np.ndarray, shift: int = 0) -> np.ndarray:
    """Joins the labels of entries near each other; with a shift only entries before it meet those from it on."""
    for i in range(0, shift or len(size), 64):
        to = min(i + 64, shift or len(size))
        from_ = shift or i
        apart = np.zeros((to - i, len(size) - from_), np.uint8)
        for w in range(bits.shape[1]):
            apart += np.bitwise_count(bits[i:to, None, w] ^ bits[None, from_:, w])
        own, other = size[i:to, None], size[None, from_:]
        near = (apart <= SKETCH_RADIUS) & (100 * np.minimum(own, other) >= PERCENT * np.maximum(own, other))
        near &= label[i:to, None] != label[None, from_:]
        a, b = np.nonzero(near)
        if len(a):
            label = roots(label, a + i, b + from_)
    return label


def _bits(table: pa.Table) -> np.ndarray:
    """The sketches, unsigned, since numpy counts the bits of absolute values."""
    return np.stack([table["s0"].to_numpy(), table["s1"].to_numpy()], axis=1).view(np.uint64)


def near(a: str, b: str) -> Column:
    """Whether the entries with these prefixes are near each other."""
    bits = sum(F.bit_count(F.col(f"{a}s{w}").bitwiseXOR(F.col(f"{b}s{w}"))) for w in (0, 1))
    least, most = F.least(f"{a}size", f"{b}size"), F.greatest(f"{a}size", f"{b}size")
    return (bits <= SKETCH_RADIUS) & (100 * least >= PERCENT * most)


def marks(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, n_shingles, key, slots, s0, s1) of every document; digest is the text's."""

    def one(doc_id, digest, text):
        hashes = shingle_set(text, width)
        if not len(hashes):
            return doc_id, digest, 0, b"", b"", 0, 0
        low = minima(hashes)
        s0, s1 = sketch(low).tolist()
        return doc_id, digest, len(hashes), set_key(hashes), signature(low), s0, s1

    columns = [F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(text_col).cast("string")]
    schema = "doc_id long, digest long, n_shingles long, key binary, slots binary, s0 long, s1 long"
    return map_rows(docs.select(columns), one, _struct(docs, schema))


def _struct(df: DataFrame, ddl: str):
    return df.sparkSession.createDataFrame([], ddl).schema


def entries(sets: DataFrame) -> DataFrame:
    """(index, key, size, s0, s1): each set under all keys of its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                slots = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, SLOTS)
                keys = index_keys(slots)
                row = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
                rest = [part.column(i).take(row) for i in (0, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *rest], names=["index", "key", "size", "s0", "s1"])

    return sets.select("key", "slots", "n_shingles", "s0", "s1").mapInArrow(
        run, "index long, key binary, size long, s0 long, s1 long"
    )


def _runs(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Meets every run of equal keys of a sorted range; passes on the rows of runs that are long or at an end."""
    names = ["index", "key", "size", "s0", "s1", "hi", "lo"]
    held: pa.Table | None = None
    first = passing = None  # the index of the range's first run, and of a long one

    def handed(t: pa.Table) -> list[pa.RecordBatch]:
        none = pa.nulls(t.num_rows, pa.binary())
        return pa.table([*(t.column(i) for i in range(5)), none, none], names=names).to_batches()

    def met(t: pa.Table) -> list[pa.RecordBatch]:
        index = t["index"].to_numpy()
        starts = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
        sizes = np.diff(np.append(starts, len(index)))
        bits = _bits(t)
        size, label = t["size"].to_numpy(), np.arange(len(index))
        for n in np.unique(sizes[sizes > 1]):
            if n <= 16:  # short runs of one length at once, pair by pair
                at = starts[sizes == n]
                for i, j in combinations(range(n), 2):
                    a, b = at + i, at + j
                    ok = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= SKETCH_RADIUS
                    ok &= 100 * np.minimum(size[a], size[b]) >= PERCENT * np.maximum(size[a], size[b])
                    if ok.any():
                        label = roots(label, a[ok], b[ok])
                continue
            for s in starts[sizes == n]:
                label[s : s + n] = s + meet(size[s : s + n], bits[s : s + n], np.arange(n))
        moved = np.flatnonzero(label != np.arange(len(index)))
        if not len(moved):
            return []
        key = t["key"].combine_chunks()
        hi, lo = key.take(pa.array(moved)), key.take(pa.array(label[moved]))
        none = [pa.nulls(len(moved), x) for x in (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())]
        return pa.table([*none, hi, lo], names=names).to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        index = table["index"].to_numpy()
        if not len(index):
            continue
        if first is None:
            first = index[0]
        # The last run may go on in the next batch.
        last = int(np.searchsorted(index, index[-1]))
        whole, held = table.slice(0, last), table.slice(last)
        if len(whole):
            of = whole["index"].to_numpy()
            at_end = (of == first) | (of == passing) if passing is not None else of == first
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            long = np.repeat(np.diff(np.append(starts, len(of))) > tile, np.diff(np.append(starts, len(of))))
            aside = at_end | long
            if aside.any():
                yield from handed(whole.filter(pa.array(aside)))
            if not aside.all():
                yield from met(whole.filter(pa.array(~aside)))
        if len(held) > tile or index[-1] == first or index[-1] == passing:
            passing = index[-1]
            yield from handed(held)
            held = held.slice(0, 0)
    if held is not None and len(held):
        yield from handed(held)


def _edges(pairs: DataFrame) -> DataFrame:
    """Edges with the greater name first."""
    return pairs.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))


def _with_group(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """Adds the least name of a row's group so far."""
    named = stars.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"))
    return rows.join(named, F.col("key") == F.col("_hi"), "left").withColumn("group", F.coalesce("_lo", "key")).drop("_hi", "_lo")


def _tile_pairs(rows: DataFrame, by: str) -> DataFrame:
    """Each row (tile, tiles) once for every tile that its own one meets, as (t1, t2)."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    met = rows.withColumn("other", other).withColumn("t1", F.least("tile", "other")).withColumn("t2", F.greatest("tile", "other"))
    return met.drop("other")


def candidates(sets: DataFrame, tile: int = TILE) -> DataFrame:
    """(hi, lo): groups of sets that share a key and are near each other there, as stars."""
    order = ["index", "key"]
    dealt = entries(sets).repartitionByRange(*order).sortWithinPartitions(*order)
    found = settle(
        dealt.mapInArrow(lambda batches: _runs(batches, tile), "index long, key binary, size long, s0 long, s1 long, hi binary, lo binary"),
        "runs",
    )
    long = found.where("index IS NOT NULL").select("index", "key", "size", "s0", "s1")
    heads = settle(
        long.groupBy("index").agg(F.min(F.struct("key", "size", "s0", "s1")).alias("h"), F.count("*").alias("n")).where("n > 1"), "heads"
    ).select("index", "n", *[F.col(f"h.{c}").alias(f"h_{c}") for c in ("key", "size", "s0", "s1")])
    long = settle(long.join(heads, "index"), "long")
    of_heads = long.where(near("", "h_") & (F.col("key") != F.col("h_key"))).select(F.col("key").alias("hi"), F.col("h_key").alias("lo"))
    inside = found.where("index IS NULL").select("hi", "lo")
    stars = components(_edges(inside.unionByName(of_heads)))
    # Where a head did not join a run, its tiles meet.
    grouped = settle(_with_group(long.select("index", "n", "key", "size", "s0", "s1"), stars), "grouped")
    several = grouped.groupBy("index").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a <> b").select("index")
    tiles = F.ceil(F.col("n") / tile).cast("long")
    apart = grouped.join(several, "index").select(
        "index", "key", "size", "s0", "s1", "group", tiles.alias("tiles"), F.pmod(F.xxhash64("key"), tiles).alias("tile")
    )

    def together(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["tile"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        shift = int((table["tile"].to_numpy() == key[1].as_py()).sum()) if key[1].as_py() != key[2].as_py() else 0
        if shift == table.num_rows:
            shift, table = 0, table.slice(0, 0)
        group = table["group"].combine_chunks().dictionary_encode().indices.to_numpy()
        _, label = np.unique(group, return_index=True)
        label = label[group] if len(group) else np.zeros(0, np.int64)
        after = meet(table["size"].to_numpy(), _bits(table), label.copy(), shift) if len(group) else label
        moved = pa.array(np.flatnonzero(after != label))
        names = table["key"].combine_chunks()
        return pa.table({"hi": names.take(moved), "lo": names.take(pa.array(after[moved.to_numpy()]))})

    more = _tile_pairs(apart, "index").groupBy("index", "t1", "t2").applyInArrow(together, _PAIRS)
    return components(_edges(stars.unionByName(more)))


def linked(names: list[bytes], sets: list[np.ndarray], groups: list[bytes], side: list[int] | None = None) -> list[tuple[bytes, bytes]]:
    """A forest of the exact links among sets of different groups; with sides only across them."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order])
    starts = np.cumsum(size) - size
    flat, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    of_side = np.array([side[i] for i in order]) if side is not None else None
    first: dict[bytes, int] = {}
    label = np.array([first.setdefault(groups[i], at) for at, i in enumerate(order)])
    mark, pairs = np.zeros(len(flat), np.int64), []
    for i in range(len(order) - 1):
        # Larger sets that are not too large.
        end = int(np.searchsorted(100 * size, 10_000 * int(size[i]) // PERCENT, side="right"))
        open_ = label[i + 1 : end] != label[i]
        if of_side is not None:
            open_ &= of_side[i + 1 : end] != of_side[i]
        if not open_.any():
            continue
        own = codes[starts[i] : starts[i] + size[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[codes[starts[i + 1] : starts[end - 1] + size[end - 1]]], starts[i + 1 : end] - starts[i + 1])
        mark[own] = 0
        for j in np.flatnonzero(open_ & (100 * common >= PERCENT * (size[i] + size[i + 1 : end] - common))) + i + 1:
            if label[j] != label[i]:
                pairs.append((names[order[j]], names[order[i]]))
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return pairs


def _pair_table(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({c: pa.array([p[i] for p in pairs], pa.binary()) for i, c in enumerate(("hi", "lo"))})


def _unpacked(table: pa.Table) -> tuple[list[bytes], list[np.ndarray]]:
    return table["key"].to_pylist(), [np.frombuffer(h, "<u8") for h in table["hashes"].to_pylist()]


def settled_links(members: DataFrame, part: int = PART) -> DataFrame:
    """(hi, lo): stars of the exact links among members (root, all, head, key, hashes) of one root.

    `all` is the number of shingles of the root's members, `head` the least of their names.
    """
    members = settle(members, "members")
    small, large = members.where(F.col("all") <= part), members.where(F.col("all") > part)

    def within(key: tuple, table: pa.Table) -> pa.Table:
        pairs = []
        of = table["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        for group in range(int(of.max()) + 1 if len(of) else 0):
            names, sets = _unpacked(table.take(pa.array(np.flatnonzero(of == group))))
            pairs += linked(names, sets, names)
        return _pair_table(pairs)

    # Small groups share a task, a bounded number of shingles in each.
    tasks = small.agg(F.sum(F.length("hashes") / 8).alias("n")).first()["n"] or 0
    near_ = small.groupBy(F.pmod(F.xxhash64("root"), F.lit(int(tasks // part) + 1)).alias("task")).applyInArrow(within, _PAIRS)
    tiles = F.ceil(F.col("all") / part).cast("long")
    large = large.select("root", "key", "hashes", tiles.alias("tiles"), F.pmod(F.xxhash64("key"), tiles).alias("tile"), "head")
    heads = large.where("key = head").select("root", "key", "hashes", "tiles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))
    first = large.select("root", "key", "hashes", "tiles", "tile").unionByName(heads).dropDuplicates(["root", "tile", "key"])

    def alone(key: tuple, table: pa.Table) -> pa.Table:
        names, sets = _unpacked(table)
        return _pair_table(linked(names, sets, names))

    edges = near_.unionByName(first.groupBy("root", "tile").applyInArrow(alone, _PAIRS))
    stars = components(_edges(edges))
    grouped = settle(_with_group(large.drop("head"), stars), "parts")
    several = grouped.groupBy("root").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a <> b").select("root")

    def across(key: tuple, table: pa.Table) -> pa.Table:
        names, sets = _unpacked(table)
        side = table["tile"].to_pylist()
        return _pair_table(linked(names, sets, table["group"].to_pylist(), side) if len(set(side)) > 1 else [])

    apart = _tile_pairs(grouped.join(several, "root"), "root").where("t1 <> t2")
    return components(_edges(stars.unionByName(apart.groupBy("root", "t1", "t2").applyInArrow(across, _PAIRS))))


def near_duplicates(
    docs: DataFrame, width: int = 2, tile: int = TILE, part: int = PART, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    marked = settle(marks(docs, width, id_col, text_col), "marks")
    full = marked.where("n_shingles > 0")
    sets = settle(
        full.groupBy("key").agg(
            *[F.first(c).alias(c) for c in ("n_shingles", "slots", "s0", "s1")],
            F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "digest")).alias("at"),
        ),
        "sets",
    )
    stars = candidates(sets, tile)
    heads = stars.select(F.col("lo").alias("key")).distinct()
    inside = stars.select(F.col("hi").alias("key"), F.col("lo").alias("root")).unionByName(heads.select("key", F.col("key").alias("root")))
    # Each set's text once more, found by id and digest, for the full shingles.
    placed = settle(
        inside.join(sets, "key").select("key", "root", "n_shingles", F.col("at.doc_id").alias("at_id"), F.col("at.digest").alias("at_digest")), "placed"
    )
    sizes = placed.groupBy("root").agg(F.sum("n_shingles").alias("all"), F.min("key").alias("head"))
    wanted = settle(placed.drop("n_shingles").join(sizes, "root"), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    read = texts.join(wanted, F.col("id").eqNullSafe(F.col("at_id")) & (F.col("digest") == F.col("at_digest")))

    def filled(root, all_, head, key, text):
        hashes = shingle_set(text, width)
        return root, all_, head, key, hashes.astype("<u8").tobytes() if set_key(hashes) == key else None

    ddl = "root binary, all long, head binary, key binary, hashes binary"
    members = map_rows(read.select("root", "all", "head", "key", "text"), filled, _struct(docs, ddl))
    members = members.where("hashes IS NOT NULL").dropDuplicates(["key"])
    links = settled_links(members, part)
    rooted = sets.join(links, F.col("key") == F.col("hi"), "left").select("key", "least", F.coalesce("lo", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = rooted.join(named, "root").select("key", "component_id")
    found = full.select("doc_id", "n_shingles", "key").join(of_set, "key").drop("key")
    alone = marked.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))
