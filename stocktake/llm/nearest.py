"""Exact nearest neighbours by a block matrix join with int8 tiles (operator 4).

Queries and candidates are dealt into blocks, and every query block meets
every candidate block as one tile (an equality join on the tile's numbers, in
blocks of bounded size).  In a tile both sides are quantised to eight bits
with one scale a vector, and their products give approximate distances.  The
length of what quantisation took off each vector bounds the error: a pair is
dropped only if even its least possible distance is over the k-th smallest of
the greatest possible ones.  Surviving pairs are recomputed in double
precision from the original vectors, a heap of k merges the tiles of a task,
and a ranking merges the tasks.  A distance whose square overflows is infinite.

Vectors that are null, empty, zero, or hold null or non-finite components take
no part.  Vectors of different length never meet.  Equal distances are ordered
by the smaller identifier; with fewer candidates than k all are returned.
Rows of one identifier are candidates of their own, but never for a query of
the same identifier.  Empty tables give an empty result.  Rows that repeat
identifier and vector share a block, so that a table should not hold one row
very many times.  Each candidate block is shuffled once for each query block:
with a fixed share of queries the work is quadratic in rows, as any exact search is.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from stocktake.llm._rows import stream

#: Vectors of a query block and of a candidate block.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192

#: Queries whose heaps a task holds at once.
HEAPS = 20_000

_PAIRS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec, dim`` of the vectors that take part."""
    held = embeddings.schema[vec_col].dataType.elementType
    # Single precision stays as it is; all other numbers are taken in double precision.
    kind = "float" if isinstance(held, FloatType) else "double"
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & ~bad & F.exists("vec", lambda x: x != 0)).withColumn("dim", F.size("vec"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eight-bit components, the scale of each vector, and the length of each one's error."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((codes * scale[:, None] - x) ** 2).sum(axis=1))
    return codes, scale, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows; float32 holds them exactly up to 1,000 components, float64 beyond."""
    kind = np.float32 if a.shape[1] <= 1000 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed component by component."""
    total = np.zeros(len(c))
    for k in range(c.shape[1]):
        d = q[k] - c[:, k]
        total += d * d
    return np.sqrt(total)


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its k nearest of the tile, as identifiers and distances."""
    q, c = q.astype(np.float64), c.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        yield from _tile(q_ids, q, c_ids, c, k)


def _tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    (qc, qs, qe), (cc, cs, ce) = quantise(q), quantise(c)
    q_len, c_len = ((qc * qs[:, None]) ** 2).sum(axis=1), ((cc * cs[:, None]) ** 2).sum(axis=1)
    for a in range(0, len(q), 256):
        near = products(qc[a : a + 256], cc) * (qs[a : a + 256, None] * cs[None, :])
        near = np.sqrt(np.maximum(0, q_len[a : a + 256, None] + c_len[None, :] - 2 * near))
        slack = 1e-6 * (1 + np.sqrt(q_len[a : a + 256, None]) + np.sqrt(c_len[None, :]))
        bound = qe[a : a + 256, None] + ce[None, :] + slack
        # Where squares overflow nothing is known, and the pair survives.
        low, high = np.nan_to_num(near - bound, nan=-np.inf), np.nan_to_num(near + bound, nan=np.inf)
        for i in range(len(near)):
            own = c_ids == q_ids[a + i]
            reach = np.where(own, np.inf, high[i])
            limit = np.partition(reach, k - 1)[k - 1] if len(reach) > k else np.inf
            left = np.flatnonzero((low[i] <= limit) & ~own)
            if not len(left):
                continue
            far = exact(q[a + i], c[left])
            best = np.lexsort((c_ids[left], far))[:k]
            yield int(q_ids[a + i]), c_ids[left][best], far[best]


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of each row for which ``is_query`` (on the ``id``) holds."""
    rows = usable(embeddings, id_col, vec_col)
    queries = rows.where(is_query)
    n_queries, n_rows = queries.count(), rows.count()
    q_blocks, c_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(8, -(-n_rows // CANDIDATE_BLOCK))
    member = F.struct("id", "vec")
    # A block is a group of bounded expected size: rows are dealt by a hash of the identifier and the vector.
    deal = F.xxhash64("id", "vec")
    q_side = queries.select("dim", F.pmod(deal, F.lit(q_blocks)).alias("qb"), member.alias("q")).groupBy("dim", "qb").agg(F.collect_list("q").alias("qs"))
    c_side = rows.select("dim", F.pmod(deal, F.lit(c_blocks)).alias("cb"), member.alias("c")).groupBy("dim", "cb").agg(F.collect_list("c").alias("cs"))
    tiles_q = q_side.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)).cast("array<bigint>")))
    tiles_c = c_side.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<bigint>")))
    tiles = tiles_q.hint("shuffle_hash").join(tiles_c, ["dim", "qb", "cb"]).select("dim", "qs", "cs")

    def unpack(column: pa.ListArray, i: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
        block = column[i].values
        return block.field("id").to_numpy(zero_copy_only=False), block.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = defaultdict(list)  # of the negated (distance, identifier): the worst on top

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = [(query, -v, -d) for query, heap in heaps.items() for d, v in heap]
            for a in range(0, len(pairs), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pairs[a : a + 50_000], strict=True), _PAIRS, strict=True)], schema=_PAIRS)
            heaps.clear()

        for batch in batches:
            for i, dim in enumerate(batch.column("dim").to_pylist()):
                for query, ids, far in tile(*unpack(batch.column("qs"), i, dim), *unpack(batch.column("cs"), i, dim), k):
                    heap = heaps[query]
                    for v, d in zip(ids.tolist(), far.tolist(), strict=True):
                        if len(heap) < k:
                            heapq.heappush(heap, (-d, -v))
                        elif (-d, -v) > heap[0]:
                            heapq.heapreplace(heap, (-d, -v))
                        else:
                            break
                # The ranking merges what the heaps of one query held at different times.
                if len(heaps) > HEAPS:
                    yield from flush()
        yield from flush()

    pairs = stream(tiles, work, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
