"""Small helpers of the text operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A word is a run of anything but the six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a single-machine session without that setting gets a temporary one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fleetgauge-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Work a table out once and keep it, as a checkpoint, where all executors see it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names hold."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


#: Rows and bytes of text that are Python objects at once.
SLICE_ROWS, SLICE_BYTES = 1000, 2_000_000


def in_slices(batch: pa.RecordBatch, text_col: int, rows: int = SLICE_ROWS, n_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with bounded rows and bytes of text, a row at least; nothing is copied."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        held = ends[start - 1] if start else 0
        end = min(max(int(np.searchsorted(ends, held + n_bytes, side="right")), start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def map_rows(df: DataFrame, one: Callable[..., tuple], schema: T.StructType) -> DataFrame:
    """A row of `schema` for each row of `df`: one(*values).

    The function gets the columns of `df` in their order; batches bound the memory.
    """
    names = [f.name for f in schema]
    types = [f.type for f in to_arrow_schema(schema)]
    text = next((i for i, f in enumerate(df.schema) if isinstance(f.dataType, T.StringType)), None)

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if text is not None:
            return in_slices(batch, text)
        return (batch.slice(at, SLICE_ROWS) for at in range(0, batch.num_rows, SLICE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [one(*values) for values in zip(*(c.to_pylist() for c in part.columns))]
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=names
                )

    return df.mapInArrow(run, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30, times: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton's method; the bias is not shrunk. A row counts `times`, once where not given."""
    times = np.ones(len(y)) if times is None else times
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (times * (y - p)) - shrink * w
        curve = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w
