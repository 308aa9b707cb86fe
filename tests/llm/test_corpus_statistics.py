"""Resampling, divergence audit and the multi-index join against their plainest forms."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetgauge.llm import divergence, importance, kernels, minhash, queries


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


TEXTS = st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "B", "é", "Z9", "日", " ", "\n", "-", "\x00", "{", "_"]), max_size=12).map("".join)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_equal_plain_matches(texts):
    for gaps, plain in ((importance.GAPS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (divergence.GAPS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")):
        rows, codes, known = kernels.words(pa.array(texts, pa.string()), gaps)
        known = known.to_pylist()
        assert [(int(r), known[c]) for r, c in zip(rows, codes)] == [(i, w) for i, t in enumerate(texts) for w in re.findall(plain, lower(t))]


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_runs_of_words_take_the_crc_of_their_text(texts):
    _, found = importance.runs(pa.array(texts, pa.string()), 10_000)
    got = Counter((int(r), width, int(buckets[p])) for width, (rows, place, buckets) in enumerate(found, 1) for r, p in zip(rows, place))
    want = Counter()
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        want.update((i, n, zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    assert got == want


def test_slices_hold_every_row_once():
    batch = pa.record_batch({"t": pa.array(["x" * n for n in (0, 5, 100, 3, 3, 0)] + [None])})
    parts = list(kernels.slices(batch, 0, 8))
    assert [p.num_rows for p in parts] == [2, 1, 4] and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


def test_shared_digests_are_told_apart(spark):
    """Six-bit digests: nearly all of them stand for several terms; the report is the same."""
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(queries.SQL["op12_divergence"]).fetchall())
    got = divergence.audit(spark.read.parquet(f"{sf}/documents.parquet"), digest_bits=6, block=300)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_shares_are_exact_beyond_doubles(spark):
    big = 10**17 + 1
    got = spark.range(1).select(divergence.share(*[divergence.F.lit(x).cast("long") for x in (big, 3 * big, 7)]).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (big + 1) // (3 * big + 7)


def test_a_near_signature_always_shares_a_key():
    rng = np.random.default_rng(4)
    slots = rng.integers(0, 2**16, minhash.SLOTS).astype("<u2")
    own = set(minhash.index_keys(slots[None])[0].tolist())
    assert len(own) == 64
    for wrong in [31] * 300 + list(range(32)):
        other = slots.copy()
        other[rng.choice(minhash.SLOTS, wrong, replace=False)] ^= 1
        assert own & set(minhash.index_keys(other[None])[0].tolist())


def test_far_pairs_at_the_limit_are_as_rare_as_stated():
    miss = sum(math.comb(64, i) * 0.2**i * 0.8 ** (64 - i) for i in range(32, 65))
    bits = sum(math.comb(128, i) * 0.1**i * 0.9 ** (128 - i) for i in range(minhash.SKETCH_RADIUS + 1, 129))
    assert miss < 1 / 12e6 and bits < 1e-8


def groups(rows):
    """Smallest id of every row's group by brute force; rows without shingles are alone."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else {(x,) for x in w})
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted((str(doc_id), len(sets[i]), str(least.get(root(i)))) for i, (doc_id, _) in enumerate(rows))


def test_minhash_equals_brute_force(spark):
    """Near copies around the limit, frequent keys, runs cut at ranges, groups settled in parts."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, rows = [word() for _ in range(120)], []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(25)):
            text[rng.randrange(120)] = word()
        rows.append((i, "Common pair " + " ".join(text)))
    rows += [(i, "common pair " + " ".join(word() for _ in range(rng.randrange(6)))) for i in range(150, 260)]
    rows += [(i, " ".join(word() for _ in range(n)) + " tail" * (i % 2)) for i in range(260, 300) for n in [rng.randrange(1, 30)]]
    rows += [(None, "common pair"), (None, None), (400, ""), (401, " "), (402, "one"), (403, "ONE"), (404, "null\x00é and")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups(rows)
    for options in ({}, {"tile": 16, "part": 2000}):
        got = minhash.near_duplicates(docs, **options).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
