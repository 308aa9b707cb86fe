"""Exact top-k search by tiled matrix products.

Vectors are scaled to integers. Queries and candidates are cut into tiles of bounded size;
every pair of a query tile and a shard is one matrix product with a partial selection, and the
per-query lists are merged up a tree. Products run in double precision, where they are exact
below 2^53 (the bound is checked from the components; larger ones use Python integers).

Edge cases: vectors that are null, empty or hold a null or non-finite component take no part,
nor do rows without an id; repeated rows of an id count once (the smallest vector); vectors of
other lengths than a query's are not its candidates; ties go to the smaller id; scores beyond
64 bits are held at the largest one; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import cut

SCALE = 1024
K = 10
#: Rows of a query tile and of a shard.
QUERY_TILE, SHARD = 2048, 8192
#: Lists merged at a node of the tree.
FAN_IN = 16


def _whole(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)


def best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """(query id, candidate id, score) of each query's k best candidates in one meeting."""
    order = np.argsort(c_ids)
    c_ids, c = c_ids[order], c[order]
    n = len(c)
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    exact = bound < 2**62 / (2 * max(n, 1)) and bound < 2**53
    for at in range(0, len(q), 256):
        rows, ids = q[at : at + 256], q_ids[at : at + 256]
        own = ids[:, None] == c_ids[None, :]
        if exact:
            # Score and position in one number: a larger score first, then a smaller id.
            key = (rows @ c.T).astype(np.int64) * n - np.arange(n)
            key[own] = np.iinfo(np.int64).min
            take = min(k, n)
            top = np.argpartition(key, n - take, axis=1)[:, n - take :]
            for i in range(len(rows)):
                for j in top[i]:
                    if not own[i, j]:
                        yield int(ids[i]), int(c_ids[j]), int((key[i, j] + j) // n)
            continue
        whole = [[int(x) for x in v] for v in c]
        for i, row in enumerate(rows):
            row = [int(x) for x in row]
            scored = [(-sum(a * b for a, b in zip(row, v)), int(c_ids[j])) for j, v in enumerate(whole) if not own[i, j]]
            for s, j in sorted(scored)[:k]:
                yield int(ids[i]), j, max(-(2**63), min(2**63 - 1, -s))


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _top(scored: DataFrame, k: int, *within: Column | str) -> DataFrame:
    """The k best of each query within a node of the tree."""
    ranks = Window.partitionBy("query_id", *within).orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)


def search(
    vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, query_tile: int = QUERY_TILE,
    shard: int = SHARD, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every query vector."""
    x = F.col(vec_col)
    sound = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    )
    # Components stay doubles: they hold every scaled integer the source type can express.
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: v.cast("double")).alias("v"),
        is_query.alias("asked"),
    )
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))

    def packed(batches):
        for batch in batches:
            ids, vs, asked = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            blobs = [np.floor(scale * np.array(v, np.float64)).astype("<f8").tobytes() for v in vs]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(blobs, pa.binary()), pa.array(list(map(len, vs)), pa.int32()), asked],
                names=["id", "v", "dim", "asked"],
            )

    rows = cut(rows.mapInArrow(packed, "id long, v binary, dim int, asked boolean"))
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asked"), 1)).alias("q")).first()
    n_shards, n_tiles = max(1, -(-counts["n"] // shard)), max(1, -(-counts["q"] // query_tile))
    shard_of = F.pmod(F.xxhash64("id"), F.lit(n_shards))
    tile_of = F.pmod(F.xxhash64("id"), F.lit(n_tiles))
    # The stated query set meets all rows in blocks: each side goes once to every block of the other.
    candidates = rows.select(
        "dim", shard_of.alias("shard"), F.explode(_upto(n_tiles)).alias("tile"),
        F.lit(False).alias("asks"), "id", "v",
    )
    queries = rows.where("asked").select(
        "dim", F.explode(_upto(n_shards)).alias("shard"), tile_of.alias("tile"),
        F.lit(True).alias("asks"), "id", "v",
    )

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        asks = np.array(table["asks"].to_pylist(), bool)
        ids, vs = np.array(table["id"].to_pylist(), np.int64), table["v"].to_pylist()
        found = []
        if asks.any() and not asks.all():
            q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
            found = list(best(ids[q], _whole([vs[i] for i in q]), ids[c], _whole([vs[i] for i in c]), k))
        columns = list(zip(*found)) or [(), (), ()]
        shards = [key[1].as_py()] * len(found)
        return pa.table(
            {n: pa.array(c, pa.int64()) for n, c in zip(("shard", "query_id", "vec_id", "score"), [shards, *columns])}
        )

    lists = candidates.unionByName(queries).groupBy("dim", "shard", "tile").applyInArrow(
        meet, "shard long, query_id long, vec_id long, score long"
    )
    width = n_shards
    while width > FAN_IN:
        width = -(-width // FAN_IN)
        lists = _top(lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN)), k, "shard").drop("rank")
    return _top(lists, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
