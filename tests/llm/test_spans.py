"""Spans of personal data in running text."""

import random
import time

import numpy as np
import pytest

from fleetgauge.llm import pii


@pytest.mark.parametrize("number", ["0155512345", "123456789", "12345678", "01 23 45 67 89", "030 12345678", "555-0123", "(555) 013-1234"])
@pytest.mark.parametrize("after", ["", " today", ".", ". 5 people", ")", ") or later", " - now", " 2nd floor"])
def test_numbers_are_proposed_whatever_follows(number, after):
    text = f"call {number}{after}"
    found = [text[s:e] for s, e, _, _ in pii.candidates(text, *pii.patterns(text))]
    assert number in found


@pytest.fixture(scope="module")
def model():
    x, y = pii.typical()
    return pii.train(np.array(x, np.float32).astype(float), np.array(y, float))


def chosen(text, model):
    good, bad = pii.patterns(text)
    found = [{"start": s, "end": e, "label": y, "x": x} for s, e, y, x in pii.candidates(text, good, bad)]
    return [text[s:e] for s, _, e in sorted(pii.select(found, good, model))]


def test_calibration_rows_have_no_twin_among_the_fitted():
    x = np.array(pii.typical()[0], np.float32).astype(float)
    unseen = pii.held_out(x)
    assert 0.1 < unseen.mean() < 0.5
    assert not {r.tobytes() for r in x[unseen]} & {r.tobytes() for r in x[~unseen]}


def test_descriptions_never_seen_are_told_apart(model):
    x, y = (np.array(v) for v in pii.typical())
    unseen = pii.held_out(x.astype(float))
    right = (model.chance(x[unseen].astype(np.float32).astype(float)) >= model.threshold) == y[unseen]
    assert right.mean() > 0.95


@pytest.mark.parametrize(
    "text, spans",
    [
        ("born 12/03/1984 in Rome", ["12/03/1984"]),
        ("my name is Mary Jones and I live at 44 Elm Street, New York City", ["Mary Jones", "44 Elm Street"]),
        ("Herr Otto Schmidt wohnt Lindenstraße 5", ["Herr Otto Schmidt", "Lindenstraße 5"]),
        ("follow @mary_jones", ["@mary_jones"]),
        ("call me at 0155512345 today", ["0155512345"]),
        ("write to " + "x" * 300 + " [at] host.org", ["x" * 300 + " [at] host.org"]),
        ("Visit New York and the Eiffel Tower on 12/03/2019", []),
        ("use @media in css", []),
        ("Sich " * 40, []),
        ("MR. Smith AB12 CD", []),
        ("", []),
    ],
)
def test_kinds_of_spans(text, spans, model):
    assert chosen(text, model) == spans


def test_select_equals_comparison_with_all(model):
    rng = random.Random(5)
    x, _ = pii.typical()
    for _ in range(60):
        base = [(s, 0, s + rng.randint(1, 9)) for s in sorted(rng.sample(range(90), 5))]
        found = [{"start": (s := rng.randint(0, 95)), "end": s + rng.randint(1, 12), "label": rng.choice([-1, 0, 1]), "x": rng.choice(x)} for _ in range(40)]
        taken, want = [(s, e) for s, _, e in base], []
        free = [c for c in found if c["label"] != 0]
        chance = model.chance(np.array([c["x"] for c in free], np.float32).astype(float))
        for p, c in sorted(zip(chance, free), key=lambda q: (-q[0], q[1]["start"], -q[1]["end"])):
            if p >= model.threshold and not any(c["start"] < e and s < c["end"] for s, e in taken):
                taken.append((c["start"], c["end"]))
                want.append((c["start"], 4, c["end"]))
        assert sorted(pii.select(found, base, model)) == sorted(want)


def test_sample_of_candidates_is_the_one_of_least_hash(spark):
    """The bound on the hash changes nothing of the sample."""
    docs = spark.createDataFrame([(i, f"card 4{i:015d} or 9.9.{i % 300}.1") for i in range(400)], "doc_id long, text string")
    proposed = pii.propose(docs)
    rows = proposed.selectExpr("doc_id", "explode(candidates) c").where("c.label >= 0").selectExpr("xxhash64(doc_id, c.start, c.end) h", "c.x x", "c.label y")
    least = [(list(r["x"]), r["y"]) for r in rows.orderBy("h", "x", "y").limit(50).collect()]
    assert rows.count() > 300
    x, y = pii.typical()
    want = pii.train(np.array(x + [v for v, _ in least], np.float32).astype(float), np.array(y + [v for _, v in least], float))
    got = pii.learn(proposed, 50)
    assert got.threshold == want.threshold and (got.leaf == want.leaf).all()


def _checked_numbers(spark, n):
    return pii.propose(spark.createDataFrame([(i, f"{'card ' * (i % 3)}4{i:015d} or {'x' * (i % 11)} 9.9.{i % 300}.1") for i in range(n)], "doc_id long, text string"))


def test_trees_are_fitted_on_every_labelled_candidate(spark):
    """A label of many rows that come last by hash weighs as much as its rows."""
    proposed = _checked_numbers(spark, 400).localCheckpoint()
    rows = proposed.selectExpr("explode(candidates) c").where("c.label >= 0").selectExpr("c.x x", "c.label y").collect()
    x, y = pii.typical()
    want = pii.train(np.array(x + [list(r["x"]) for r in rows], np.float32).astype(float), np.array(y + [r["y"] for r in rows], float))
    got = pii.learn(proposed)
    assert (got.feature == want.feature).all() and (got.leaf == want.leaf).all()
    assert got.threshold == pytest.approx(want.threshold)
    assert not (pii.learn(proposed, 50).leaf == got.leaf).all()


def test_sums_of_tasks_give_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(pii, "TREES", 3)
    monkeypatch.setattr(pii.boost, "__defaults__", (3,))
    proposed = _checked_numbers(spark, 200).localCheckpoint()
    on_driver, by_tasks = pii.learn(proposed), pii.learn(proposed, gathered=2)
    assert (on_driver.feature == by_tasks.feature).all() and (on_driver.cut == by_tasks.cut).all() and (on_driver.leaf == by_tasks.leaf).all()
    assert by_tasks.threshold == pytest.approx(on_driver.threshold) and by_tasks.start == pytest.approx(on_driver.start)


@pytest.mark.parametrize("piece", ["Aa ", "A-", "Calle ", "Mr ", "1 Aa ", "1 ", "1. ", "@a", "a[at]", "1 rue de ", "Aa AaB ", "May 1 ", "x", "(1)"])
def test_long_texts_take_time_in_proportion(piece):
    text = piece * (300_000 // len(piece)) + "aB"
    began = time.process_time()
    pii.candidates(text, *pii.patterns(text))
    assert time.process_time() - began < 15
