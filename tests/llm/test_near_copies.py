"""Near copies of the pipeline against brute-force Jaccard similarity of shingle sets."""

import random

import corpus_pipeline
from fleetgauge.llm import simhash


def brute_force(texts):
    """Smallest id of every text's group."""
    sets, up = {i: set(simhash.shingles(t, 5)) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return {i: root(i) for i in texts}


def test_near_copies_equal_brute_force(spark):
    rng, texts = random.Random(5), []
    word = lambda: f"w{rng.randrange(10**6)}"
    for n in [*range(1, 24), *range(28, 48), 60, 100, 300] * 3:
        own = [word() for _ in range(n)]
        texts.append(" ".join(own))
        texts.append(" ".join([*own, word()]))  # 4 shingles of 5, 6 of 7 and so on
        texts.append(" ".join([*own, word(), word()]))
        changed = list(own)
        changed[rng.randrange(n)] = word()
        texts.append(" ".join(changed))
        texts.append(" ".join([*own[: n - n // 5], *(word() for _ in range(n // 5))]))
    chain = [word() for _ in range(200)]  # one large group of copies that are no pairs at its ends
    texts += [" ".join([*chain[i:], *(f"c{j}" for j in range(i))]) for i in range(0, 60, 2)]
    texts = dict(enumerate([*texts, None, "", " \n"]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_force(texts)
    assert 0 < len(set(want.values())) < len(texts)
    for chunk in (simhash.CHUNK, 7):
        got = simhash.similar_groups(docs, **corpus_pipeline.NEAR, chunk=chunk).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
    kept = simhash.one_of_each(docs, **corpus_pipeline.NEAR).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))
