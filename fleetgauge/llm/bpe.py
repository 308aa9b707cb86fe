"""Byte-level BPE by speculation and verification.

A text is cut at added tokens and by the vocabulary's pattern into words. For the distinct
words of a batch, greedy longest match proposes tokens. A sequence is the true encoding
exactly when every adjacent pair is compatible, that is, when merging would not have joined
the pair across their border first; numpy checks all distinct pairs of the batch at once.
Only words with an incompatible pair are merged exactly, with a heap.

Edge cases: null is the empty text with no tokens; blanks and very long words are encoded
whole; equal rows get equal rows; an empty table gives an empty table; other columns are
ignored. The vocabulary's path is a parameter and must exist where the tasks run.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed value: the pattern of byte-level vocabularies that cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers: half of them, and those that were met since the half before was full.
MEMORY = 200_000
#: Bytes up to which a word is merged without a heap.
SHORT = 40
#: Code points of text encoded at a time, unless one text has more.
BATCH_CHARS = 2_000_000

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take the code points from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and the two tables that verification needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = printable_bytes()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        model = spec["model"]["vocab"]
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        self.id_of = {as_bytes(t): i for t, i in model.items() if t not in self.added}
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        self.bytes_of |= {i: t.encode("utf-8") for t, i in self.added.items()}
        self.size = max(self.bytes_of) + 1
        # Length of the longest token that begins with these three bytes.
        self.reach: dict[bytes, int] = {}
        for token in self.id_of:
            self.reach[token[:3]] = max(len(token), self.reach.get(token[:3], 2))
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        left = np.array([model[a] for a, _ in pairs], np.int64)
        right = np.array([model[b] for _, b in pairs], np.int64)
        made = np.array([model[a + b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip((left * self.size + right).tolist(), range(len(pairs))))
        self.made_of = made.tolist()
        # Rank at which a token is made: single bytes come before every merge.
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        for rank in range(len(pairs) - 1, -1, -1):  # the first merge that makes a token counts
            self.rank[made[rank]] = rank
            self.left[made[rank]], self.right[made[rank]] = left[rank], right[rank]
        order = np.argsort(left * self.size + right)
        self.pair_keys = (left * self.size + right)[order]
        self.pair_ranks = order.astype(np.int64)
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        #: Word, or id of an added token, to its ids as packed 32-bit numbers.
        self.known: dict[str | int, bytes] = {}
        #: The words before those: one that is met again is taken over, the others go.
        self.older: dict[str | int, bytes] = {}

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        ids, at, n, id_of, reach = [], 0, len(word), self.id_of, self.reach
        while at < n:
            for end in range(min(n, at + reach.get(word[at : at + 3], 2)), at, -1):
                token = id_of.get(word[at:end])
                if token is not None:
                    ids.append(token)
                    at = end
                    break
        return ids

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays apart when its joint text is merged.

        Both tokens are taken apart along their facing borders, the later-made one first. If
        the two pieces that face each other then form a merge that comes before the piece
        last taken apart was made, merging would have crossed the border.
        """
        a, b = first.copy(), second.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        fits, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit[open_])
            fits[open_[clash]] = False
            done = clash | ((self.rank[x] < 0) & (self.rank[y] < 0))
            go = open_[~done]
            x, y = a[go], b[go]
            # Of two pieces made by the same merge the left one is older: it merged first.
            from_left = self.rank[x] > self.rank[y]
            limit[go] = np.where(from_left, self.rank[x], self.rank[y] + 1)
            a[go] = np.where(from_left, self.right[x], x)
            b[go] = np.where(from_left, y, self.left[y])
            open_ = go
        return fits

    def merge_exactly(self, word: bytes) -> list[int]:
        """The definition: the earliest merge first, the leftmost of equals first."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        if n <= SHORT:
            return self._merge_short(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.rank_of.get(ids[i] * self.size + ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], after[i] = self.made_of[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [t for t in ids if t >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same by looking at every pair, which is faster for a few."""
        size, rank_of, made_of, none = self.size, self.rank_of, self.made_of, len(self.made_of)
        ranks = [rank_of.get(a * size + b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (first := min(ranks)) < none:
            at = ranks.index(first)
            made = made_of[first]
            ids[at : at + 2] = [made]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of.get(ids[at - 1] * size + made, none)
            if at < len(ranks):
                ranks[at] = rank_of.get(made * size + ids[at + 1], none)
        return ids

    def learn(self, words: set[str]) -> None:
        """Encode words that are not yet known."""
        texts = list(words)
        proposed = [self.propose(w.encode("utf-8")) for w in texts]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lengths.sum()))
        inner = np.ones(max(0, len(flat) - 1), bool)  # borders within a word
        ends = np.cumsum(lengths)[:-1] - 1
        inner[ends[(ends >= 0) & (ends < len(inner))]] = False
        keys = (flat[:-1] * self.size + flat[1:])[inner]
        pairs, back = np.unique(keys, return_inverse=True)
        fits = self.compatible(pairs // self.size, pairs % self.size)
        owner = np.repeat(np.arange(len(texts)), lengths)[:-1][inner]
        failing = set(owner[~fits[back]].tolist())
        for i, (word, ids) in enumerate(zip(texts, proposed)):
            ids = self.merge_exactly(word.encode("utf-8")) if i in failing else ids
            self.known[word] = array("I", ids).tobytes()

    def _pieces(self, text: str) -> list[str | int]:
        """Words, and the ids of added tokens among them."""
        if self.special is None or not self.special.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(self.added[m.group()])
            at = m.end()
        return out + self.words.findall(text[at:])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of every text."""
        pieces = [self._pieces(t or "") for t in texts]
        if len(self.known) > MEMORY // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = set(chain.from_iterable(pieces)).difference(known)
        again = new.intersection(older)
        known.update((w, older[w]) for w in again)
        new -= again
        for token in [p for p in new if p.__class__ is int]:
            known[token] = array("I", [token]).tobytes()
            new.discard(token)
        if new:
            self.learn(new)
        return [np.frombuffer(b"".join(map(known.__getitem__, ps)), np.uint32) for ps in pieces]

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker."""
    return Vocabulary(path)


def in_batches(batch: pa.RecordBatch, text_col: int):
    """Slices of a batch with a bounded number of bytes, a row at least."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(text_col)), 0).to_pylist()):
        if held and held + n > BATCH_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode every text and decode it again: SCHEMA, and the ids themselves if asked for."""
    schema = T.StructType(
        [*SCHEMA.fields, *[T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids]
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        vocab = vocabulary(path)
        for whole in batches:
            for batch in in_batches(whole, 1):
                doc_ids, texts = (c.to_pylist() for c in batch.columns)
                # Copies of a text, as a mix deals them out, are encoded once.
                distinct = list(dict.fromkeys(texts))
                found = {}
                for text, ids in zip(distinct, vocab.encode(distinct)):
                    decoded = vocab.decode(ids).encode("utf-8")
                    packed = ids.astype("<u4").tobytes()
                    found[text] = [
                        len(ids),
                        hashlib.sha256(packed).hexdigest(),
                        hashlib.sha256(decoded).hexdigest(),
                        *[ids.tolist()] * with_ids,
                    ]
                rows = [[doc_id, *found[text]] for doc_id, text in zip(doc_ids, texts)]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow)], names=arrow.names
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
