"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and context windows.

Terms are learned from labelled rows: words, and word beginnings (written `stem*`), that occur
often in toxic texts and hardly elsewhere. The lexicon is a trie; intersecting it with
Levenshtein automata gives one automaton that accepts a token within a term's allowed number of
edits (none for stems and short words, one from five letters, two from nine). Its states are
built as tokens need them. Each hit is read in a window of tokens: within quotation marks or
after a verb of reporting it counts as quoted, near a second person as directed. A logistic
model over these counts, fitted on the same rows, gives the score.

Labels come from a bounded sample of rows whose crc32(doc_id) mod 5 is not 0; id, language,
source and label are never inputs of a score.

Edge cases: null and empty texts have no hit and get the score of none; null labels and labels
of unknown documents are left out, of several labels of a document the highest counts; without
toxic labels the lexicon is empty and every score equal; equal texts get equal scores; an empty
table gives an empty table; other columns are ignored by `score` and kept by `without_toxic`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import cut, fit_logistic, in_slices

#: Labelled rows the model is fitted on, at most.
MAX_TRAINING_ROWS = 20_000
#: Shortest and longest stems.
STEMS = (4, 8)
#: Share of a term's occurrences that must be in toxic texts, one of either kind added to its own, and the least number
#: of toxic ones: the same for a table of any size, so that three of three are enough and four of five are not. (0.8: best
#: of 0.95, 0.88 and 0.8 by the area under the curve on the training rows, unsmoothed, with fewer terms than 0.7.)
LEAST_PRECISION, LEAST_TOXIC = 0.8, 3
#: Tokens on either side of a hit.
WINDOW = 6
#: States of the automaton before it starts afresh.
MAX_STATES = 50_000

TOKEN = re.compile(r"\w+|[\"“”„«»\n]")
QUOTES = frozenset("\"“”„«»")
MARKS = QUOTES | {"\n"}
REPORTING = frozenset("said says say called calls wrote writes quoted quote quoting dit écrit sagte schrieb dijo escribió".split())
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta vous votre du dich dir dein deine ihr euch tú ti usted ustedes".split()
)
N_FEATURES = 8


def allowed_edits(term: str) -> int:
    """Edits within which a token counts as the term."""
    return 0 if term.endswith("*") or len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """The lexicon's trie intersected with Levenshtein automata, as one lazily built automaton.

    A state holds trie nodes with the edits spent to reach them; state 0 is dead.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[str | None] = [None]
        self.budget = [0]  # most edits any term below may cost
        self.stem = [False]
        for term in terms:
            node, edits = 0, allowed_edits(term)
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(None)
                    self.budget.append(0)
                    self.stem.append(False)
                self.budget[node] = max(self.budget[node], edits)
                node = self.children[node][c]
            self.budget[node] = max(self.budget[node], edits)
            self.term_at[node] = term
            self.stem[node] |= term.endswith("*")
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [()]
        self.number: dict[tuple, int] = {(): 0}
        self.moves: list[dict[str, int]] = [{}]
        self.accepts: list[tuple[str, int] | None] = [None]
        self.stems: list[tuple[str, int] | None] = [None]
        self.start = self._state({0: 0} if self.terms else {})

    def _state(self, spent: dict[int, int]) -> int:
        # Skipping a letter of the term costs an edit.
        open_ = list(spent.items())
        while open_:
            node, e = open_.pop()
            if spent.get(node, 99) == e and e < self.budget[node]:
                for child in self.children[node].values():
                    if e + 1 <= self.budget[child] and e + 1 < spent.get(child, 99):
                        spent[child] = e + 1
                        open_.append((child, e + 1))
        key = tuple(sorted(spent.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(e, t) for node, e in key if (t := self.term_at[node]) and e <= allowed_edits(t)]
            best = min(ends, default=None)
            self.accepts.append(best and (best[1], best[0]))
            stems = [t for node, e in key if e == 0 and self.stem[node] and (t := self.term_at[node])]
            self.stems.append((stems[0], 0) if stems else None)
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        spent: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.budget[node] and e < spent.get(node, 99):
                spent[node] = e

        for node, e in self.states[state]:
            child = self.children[node].get(c)
            if child is not None:
                reach(child, e)
            if e < self.budget[node]:
                reach(node, e + 1)  # a letter too many
                for other in self.children[node].values():
                    reach(other, e + 1)  # another letter
        moved = self._state(spent)
        self.moves[state][c] = moved
        return moved

    def match(self, token: str) -> tuple[str, int] | None:
        """The term a token stands for, and the edits between them."""
        if len(self.states) > MAX_STATES:
            self._reset()
        state, moves, stems = self.start, self.moves, self.stems
        for c in token:
            moved = moves[state].get(c)
            if moved is None:
                moved = self._step(state, c)
            if not moved:
                return None
            state = moved
            if stems[state]:
                return stems[state]
        return self.accepts[state]


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def features(text: str | None, lexicon: FuzzyLexicon) -> list[float]:
    """Bias, counts of hits by closeness and context, and their density."""
    found = tokens(text)
    match = lexicon.match
    hits = [(i, m) for i, t in enumerate(found) if (m := match(t))]
    count = [0, 0, 0, 0, 0]  # exact, exact quoted, near, near quoted, directed
    if hits:
        at, inside = 0, False
        for i, (_, edits) in hits:
            for t in found[at:i]:  # a quotation ends with its line at the latest
                inside = t != "\n" and (inside ^ (t in QUOTES))
            at = i
            around = found[max(0, i - WINDOW) : i + WINDOW + 1]
            quoted = inside or not REPORTING.isdisjoint(around[: min(i, WINDOW)])
            count[2 * (edits > 0) + quoted] += 1
            count[4] += not quoted and not SECOND_PERSON.isdisjoint(around)
    exact = count[0] + count[1]
    return [1.0, float(exact > 0), *map(math.log1p, count), 100.0 * exact / max(1, len(found)) / (1.0 + exact)]


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 5 == 0


def training_texts(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(text, toxic) of a bounded sample of labelled documents that are not held out.

    The sample's ids are at most max_rows narrow rows, so they can be sent to every task.
    """
    sample = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(texts.join(F.broadcast(sample), "doc_id").select("text", "toxic"))


def covering(terms: list[tuple[str, int]]) -> list[str]:
    """Terms without those that say the same as another.

    A stem that is hardly more frequent than a longer term gives way to it; a term that begins
    with a remaining stem is covered by it.
    """
    most: Counter[str] = Counter()
    for term, n in terms:
        bare = term.rstrip("*")
        for k in range(1, len(bare) + (not term.endswith("*"))):
            most[bare[:k]] = max(most[bare[:k]], n)
    closed = [(t, n) for t, n in terms if not t.endswith("*") or most[t[:-1]] < 0.98 * n]
    stems: set[str] = set()
    out = []
    for term, _ in sorted(closed, key=lambda x: (len(x[0].rstrip("*")), not x[0].endswith("*"), x[0])):
        bare = term.rstrip("*")
        if any(bare[:k] in stems for k in range(1, len(bare) + 1)):
            continue
        if term.endswith("*"):
            stems.add(bare)
        out.append(term)
    return sorted(out)


def learn_lexicon(train: DataFrame) -> list[str]:
    """Terms whose occurrences are nearly all in toxic texts: words of any length, and stems."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[1 if toxic else 0].update({t for t in tokens(text) if t not in MARKS})
            words = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *(pa.array([n[k][w] for w in words], pa.int64()) for k in (1, 0))],
                names=["word", "toxic", "clean"],
            )

    words = train.mapInArrow(counted, "word string, toxic long, clean long")
    words = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    stems = [
        F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in range(STEMS[0], STEMS[1] + 1)
    ]
    terms = (
        words.select(F.explode(F.array_compact(F.array(F.col("word"), *stems))).alias("term"), "toxic", "clean")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    smoothed = (F.col("toxic") + 1) / (F.col("toxic") + F.col("clean") + 2)
    chosen = terms.where((F.col("toxic") >= LEAST_TOXIC) & (smoothed >= LEAST_PRECISION)).collect()  # of a bounded sample
    return covering([(r["term"], r["toxic"]) for r in chosen])


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> tuple[list[str], list[float]]:
    """Lexicon and weights."""
    train = training_texts(docs, labels, max_rows)
    terms = learn_lexicon(train)

    def measured(batches):
        lexicon = FuzzyLexicon(terms)
        for batch in (part for whole in batches for part in in_slices(whole, 0)):
            x = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = train.mapInArrow(measured, "x array<double>, y int").collect()  # at most max_rows
    x = np.array([r["x"] for r in rows], float).reshape(-1, N_FEATURES)
    y = np.array([r["y"] for r in rows], float)
    order = np.lexsort(np.column_stack([x, y]).T)  # the same sums in whatever order rows come
    return terms, fit_logistic(x[order], y[order]).tolist()


def _scores(texts: list[str | None], lexicon: FuzzyLexicon, weights: np.ndarray) -> np.ndarray:
    x = np.array([features(t, lexicon) for t in texts]).reshape(-1, N_FEATURES)
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def score(docs: DataFrame, model: tuple[list[str], list[float]]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    terms, weights = model

    def run(batches):
        lexicon, w = FuzzyLexicon(terms), np.array(weights)
        for batch in (part for whole in batches for part in in_slices(whole, 2)):
            s = _scores(batch.column(2).to_pylist(), lexicon, w)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text"
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: tuple[list[str], list[float]]) -> DataFrame:
    """The documents, all columns, that score below one half."""
    terms, weights = model
    at = docs.columns.index("text")

    def run(batches):
        lexicon, w = FuzzyLexicon(terms), np.array(weights)
        for batch in batches:
            for part in in_slices(batch, at):
                yield part.filter(pa.array(_scores(part.column(at).to_pylist(), lexicon, w) < 0.5))

    return docs.mapInArrow(run, docs.schema)
