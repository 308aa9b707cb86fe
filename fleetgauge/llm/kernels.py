"""Arrow kernels that cut texts into dictionary-encoded words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are held as words at a time; a longer text is a slice of its own.
SLICE = 8 << 20


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `limit` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def words(texts: pa.Array, gaps: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of every word in order, and the words by code; A-Z are lower-cased, nulls have none."""
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=gaps)
    flat, rows = pc.list_flatten(parts), pc.list_parent_indices(parts)
    there = pc.not_equal(flat, "")
    coded = pc.filter(flat, there).dictionary_encode()
    rows = pc.filter(rows, there).to_numpy(zero_copy_only=False).astype(np.int64)
    return rows, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the distinct codes, the distinct codes)."""
    coded = pa.array(codes, pa.int64()).dictionary_encode()
    return (
        coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
        coded.dictionary.to_numpy(zero_copy_only=False).astype(np.int64),
    )
