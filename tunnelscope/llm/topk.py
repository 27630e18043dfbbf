"""Exact top-k search by tiled matrix products.

Vectors are packed into tiles, queries into blocks. Every block meets every tile once: tiles belong to a fixed number of groups, each
block is sent to each group, and a task multiplies a block by a tile and keeps the k best of each
query in that tile (partial selection). Lists are merged as a tree: first within a group of tiles, then over the groups. Memory holds one block
and one tile; nothing is sent to all executors.

Components are floor(1024 * x). Products run in doubles where no sum can leave the whole numbers that doubles hold, else in 64-bit integers;
scores are taken to fit 64 bits.

Defined cases: vectors that are null or have a null or non-finite component take no part, as queries and as candidates; vectors of
another length than the query's are no candidates of it; with fewer candidates than k all are returned; ties go to the smaller vec_id; rows
that repeat an id are candidates each, but never of a query with that id; null ids take no part; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .scans import partitions_of

TILE_ROWS = 2048
BLOCK_ROWS = 256
SCALE = 1024.0
_EXACT = 2.0**52

TILE_SCHEMA = "tile bigint, dim int, ids binary, vectors binary"


def _tiles(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows (vec_id, x array<double>) packed: per tile its length of vectors, ids in ascending order and integer components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(dim: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            nonlocal made
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            made += 1
            values = [[part << 32 | made], [dim], [ids[order].astype("<i8").tobytes()], [x[order].astype("<i8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["tile", "dim", "ids", "vectors"])

        for batch in batches:
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            flat = np.floor(SCALE * column.flatten().to_numpy()).astype(np.int64)
            begins = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                for some in np.array_split(own, -(-len(own) // rows)):
                    x = flat[(begins[some][:, None] + np.arange(dim)).reshape(-1)].reshape(len(some), dim)
                    mine = held.setdefault(dim, [])
                    mine.append((ids[some], x))
                    if sum(len(p[0]) for p in mine) >= rows:
                        yield packed(dim, held.pop(dim))
        for dim, parts in held.items():
            yield packed(dim, parts)

    return vectors.mapInArrow(run, TILE_SCHEMA)


def _best(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query in a tile: query id, vec_id, score, where ``ids`` ascend."""
    dim = queries.shape[1]
    if dim == 0:
        scores = np.zeros((len(queries), len(vectors)), np.int64)
    elif float(np.abs(queries).max()) * float(np.abs(vectors).max()) * dim < _EXACT:
        scores = np.rint(queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    else:
        scores = queries @ vectors.T
    own = q_ids[:, None] == ids[None, :]
    low = np.iinfo(np.int64).min
    scores[own] = low
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        keep = (scores >= floor[:, None]) & ~own
        # Of those that tie at the floor only as many as are missing, smaller ids first.
        ties = (scores == floor[:, None]) & ~own
        room = k - (scores > floor[:, None]).sum(axis=1)
        keep &= ~ties | (np.cumsum(ties, axis=1) <= room[:, None])
    else:
        keep = ~own
    r, c = np.nonzero(keep)
    return q_ids[r], ids[c], scores[r, c]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, tile_rows: int = TILE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per query (a row of ``vectors`` for which ``is_query`` holds) its k best others: query_id, rank, vec_id, score."""
    x = F.col("embedding")
    whole = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.col("vec_id").isNotNull()
    used = vectors.filter(whole)
    columns = [F.col("vec_id").cast("bigint").alias("vec_id"), x.cast("array<double>").alias("x")]
    tiles = cut(_tiles(used.select(*columns), tile_rows), "tiles")
    blocks = cut(_tiles(used.filter(is_query).select(*columns), block_rows), "query-blocks")
    groups = partitions_of(vectors)
    held = tiles.withColumn("group", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int"))
    sent = blocks.select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    pairs = held.join(sent.hint("merge"), ["group", "dim"]).select("group", "dim", "ids", "vectors", "q_ids", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                group, dim = batch.column("group")[i].as_py(), batch.column("dim")[i].as_py()
                ids, q_ids = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in ("ids", "q_ids"))
                v, q = (np.frombuffer(batch.column(c)[i].as_buffer() or b"", "<i8").reshape(-1, dim) if dim else np.zeros((n, 0), np.int64) for c, n in (("vectors", len(ids)), ("q", len(q_ids))))
                a, b, s = _best(q, q_ids, v, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), group, np.int32)), pa.array(a), pa.array(b), pa.array(s)], ["group", "query_id", "vec_id", "score"])

    lists = pairs.mapInArrow(run, "group int, query_id bigint, vec_id bigint, score bigint")
    order = [F.desc("score"), F.asc("vec_id")]
    for keys in (["query_id", "group"], ["query_id"]):
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")
