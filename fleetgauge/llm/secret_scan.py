"""Secret scans: patterns, and guess costs of values that stand where credentials stand.

Patterns find assignments, access keys and long hexadecimal runs. The method looks at values
in a credential context (an assignment to a credential name, an authorisation header, the user
part of a url) and asks what guessing them costs: a dynamic program finds the cheapest way to
cut a value into common words (also with capitals and look-alike characters), dates, repeats,
keyboard walks and brute-force spans. What costs enough is a secret of kind `credential`, if
pattern spans do not cover it wholly; placeholders such as `changeme123` are not.

Edge cases: a null text is empty; texts and values of any length are handled whole (the program
is linear in a value's length); equal rows get equal rows; an empty table gives an empty table;
other columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from math import log10
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import in_slices, map_rows

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "credential")
#: log10 of the guesses from which a value counts as a secret.
LEAST_COST = 8.0
#: Shortest value the method looks at.
LEAST_VALUE = 8

#: Common words and passwords, the commonest first; the rank is the cost.
WORDS = (
    "password 123456 admin qwerty secret letmein welcome test user login root default guest master changeme example "
    "sample dummy token value string none null true false your my the key api here xxx insert enter replace placeholder "
    "undefined required optional monkey dragon sunshine princess football baseball shadow superman batman love hello "
    "summer winter spring autumn monday friday january december home office work company server client service access "
    "account database data config name mail email phone file path host port local localhost public private prod "
    "production staging dev develop demo foo bar baz pass word pwd auth basic bearer apikey environment env variable "
    "redacted hidden empty random temp tmp old new one two three red green blue black white dog cat star money happy"
).split()
LOOKALIKE = str.maketrans("4@310$57!", "aaeiossti")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")

_ASCII = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run is taken whole, so runs of 24 and more are the matches that remain.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|api[_-]?key|(?:access|private|client|signing)[_-]?key)"""
    r"""["']?\x20*(?::=|=>|[:=])\x20*(?:"([^"\n]+)"|'([^'\n]+)'|["']?([^\s"'<>,;|]+))"""
    r"""|authorization["']?\x20*[:=]\x20*["']?(?:bearer|basic)\x20+([^\s"'<>,;|]+)"""
    r"""|://[^\s/:@]*:([^\s/:@]+)@""",
    _ASCII,
)
#: What stands for a value that is kept elsewhere: a variable, an element, a call, a placeholder.
REFERENCE = re.compile(
    r"""\$\{[^}]*\}|\$\([^)]*\)|\$[A-Za-z_]\w*|%\w+%|\{\{[^}]*\}\}|(?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*(?:\[[^\]]*\]|\([^)]*\))[\])]*""",
    re.ASCII,
)
#: One of these (lower case) stands in every text that ASSIGN or CONTEXT can match.
HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "key", "://")
DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:19|20)\d\d")
REPEAT = re.compile(r"(.{1,8}?)\1+", re.S)

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("cost", T.DoubleType()),
    ]
)


@lru_cache(maxsize=1)
def _neighbours() -> dict[str, str]:
    """Each key's neighbours on the keyboard."""
    near: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for i, c in enumerate(row):
            around = {(r, i - 1), (r, i + 1), (r - 1, i), (r - 1, i + 1), (r + 1, i), (r + 1, i - 1)}
            near[c] = {ROWS[y][x] for y, x in around if 0 <= y < 4 and 0 <= x < len(ROWS[y])}
    return {c: "".join(sorted(n)) for c, n in near.items()}


def walks(value: str) -> list[tuple[int, int]]:
    """Runs of three and more neighbouring keys, or of characters in order."""
    near, found, low = _neighbours(), [], value.lower()
    step = lambda a, b: b in near.get(a, "") or abs(ord(a) - ord(b)) == 1
    start = 0
    for i in range(1, len(low) + 1):
        if i == len(low) or not step(low[i - 1], low[i]):
            if i - start >= 3:
                found.append((start, i))
            start = i
    return found


def pieces(value: str, words: tuple[str, ...] = tuple(WORDS)) -> list[tuple[int, int, float]]:
    """(start, end, log10 of guesses) of every span with a pattern."""
    found = []
    rank, longest = _ranks(words)
    low = value.lower()
    plain = low.translate(LOOKALIKE)
    for i in range(len(value)):
        for j in range(i + 2, min(len(value), i + longest) + 1):
            for text in {low[i:j], plain[i:j]}:
                if text in rank:
                    variants = 1 + (value[i:j] != low[i:j]) + (text != low[i:j])
                    found.append((i, j, log10(rank[text] * 2 ** (variants - 1) + 1)))
    found += [(m.start(), m.end(), log10(365 * 150 if len(m[0]) > 4 else 150)) for m in DATE.finditer(value)]
    for m in REPEAT.finditer(value):
        times = (m.end() - m.start()) // len(m[1])
        found.append((m.start(), m.end(), len(m[1]) + log10(times)))
    found += [(i, j, log10(47 * (j - i) * 4)) for i, j in walks(value)]
    return found


@lru_cache(maxsize=4)
def _ranks(words: tuple[str, ...]) -> tuple[dict[str, int], int]:
    rank: dict[str, int] = {}
    for i, w in enumerate(words):
        rank.setdefault(w, i + 1)
    return rank, max(map(len, words), default=0)


def guess_cost(value: str, words: tuple[str, ...] = tuple(WORDS)) -> float:
    """log10 of the guesses that the cheapest segmentation needs.

    A brute-force character costs a factor of 10, so a brute-force span is a chain of them, and
    every pattern span after the first costs a factor of 2 for its place.
    """
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in pieces(value, words):
        ending.setdefault(j, []).append((i, cost))
    best = [0.0] * (len(value) + 1)
    for j in range(1, len(value) + 1):
        best[j] = best[j - 1] + 1.0
        for i, cost in ending.get(j, ()):
            best[j] = min(best[j], best[i] + cost + (log10(2) if i else 0.0))
    return best[-1]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as disjoint ones, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find(text: str | None, least_cost: float = LEAST_COST) -> tuple[list, list, float]:
    """Pattern spans and the method's spans, both as (start, kind number, end), and the top cost."""
    text = text or ""
    base = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    more, top, low = [], 0.0, text.lower()
    if any(h in low for h in HINTS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        taken = _merged([(s, e) for s, _, e in base])
        for m in CONTEXT.finditer(text):
            group = m.lastindex
            start, end = m.span(group)
            if end - start < LEAST_VALUE or REFERENCE.fullmatch(m[group].rstrip(".")):
                continue
            cost = guess_cost(m[group])
            top = max(top, cost)
            at = bisect_right(taken, start, key=itemgetter(0)) - 1
            if cost >= least_cost and not (at >= 0 and taken[at][1] >= end):
                more.append((start, 3, end))
    return sorted(base), more, top


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, least_cost: float = LEAST_COST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of the pattern spans, all spans, and the highest guess cost of each text."""

    def one(doc_id, text):
        base, more, top = find(text, least_cost)
        counts = [sum(k == kind for _, k, _ in base + more) for kind in range(len(KINDS))]
        digest = hashlib.sha256(_joined(base).encode()).hexdigest()
        return doc_id, *counts, digest, _joined(sorted(base + more)), round(top, 6)

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), one, SCHEMA)


def redacted(text: str | None, least_cost: float = LEAST_COST) -> str | None:
    """The text with every found span replaced by its kind; overlapping spans are one."""
    base, more, _ = find(text, least_cost)
    out, at = [], 0
    for start, kind, end in sorted(base + more):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, least_cost: float = LEAST_COST, text_col: str = "text") -> DataFrame:
    """All rows and columns, secrets in the text replaced."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_slices(whole, at)):
            texts = pa.array([redacted(t, least_cost) for t in batch.column(at).to_pylist()], batch.schema.types[at])
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)
