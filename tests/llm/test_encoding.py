"""Encoding: what is worked out once, and what a worker remembers."""

import pyarrow as pa
import pytest

from fleetgauge.llm import bpe, queries


@pytest.fixture()
def vocab(monkeypatch):
    fresh = bpe.Vocabulary(queries.VOCABULARY)
    monkeypatch.setattr(bpe, "vocabulary", lambda path: fresh)
    return fresh


def test_words_met_again_stay_known(vocab, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 20)
    learned = []
    learn = vocab.learn
    monkeypatch.setattr(vocab, "learn", lambda words: learned.extend(words) or learn(words))
    plain = bpe.Vocabulary(queries.VOCABULARY)
    for i in range(30):
        text = f"always zq{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}x vw{'abcdefghij'[i // 3]}u yy"
        (ids,), (want,) = vocab.encode([text]), plain.encode([text])
        assert ids.tolist() == want.tolist() and vocab.decode(ids) == text
        assert len(vocab.known) + len(vocab.older) <= 2 * (20 // 2 + 4)
    assert learned.count("always") == learned.count(" yy") == 1


def test_copies_of_a_text_are_encoded_once(spark):
    asked = []

    class Counting(bpe.Vocabulary):
        def encode(self, texts):
            asked.extend(texts)
            return super().encode(texts)

    rows = list(enumerate(["one text"] * 5 + [None] * 2 + ["", "other text", "one text"]))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "text"])
    got = _run(bpe, Counting, batch)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))
    assert sorted(got) == sorted(map(tuple, bpe.encode(docs, queries.VOCABULARY).collect()))
    assert sorted(asked, key=str) == ["", None, "one text", "other text"]


def _run(module, vocabulary, batch):
    """What the operator's batches give, worked out in this process."""
    caught = []

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            caught.append(run)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(module, "vocabulary", lambda path: vocabulary(path))
        module.encode(Docs(), queries.VOCABULARY)
        return [tuple(r.values()) for b in caught[0]([batch]) for r in b.to_pylist()]
