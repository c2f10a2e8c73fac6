"""Exact top-k inner products by segment means and deviations, coarse to fine.

A vector is cut into 1, 2, 4, ... segments. From the mean and deviation of each
segment of two vectors follows a lower bound of their distance,

    |q - x|^2  >=  sum n * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2),

and so an upper bound of their inner product. Within a block of candidates the
ones with the best coarse bounds are scored first; the k-th best score is the
bar. All others must pass it at every resolution, coarse to fine, before their
score is computed. Bounds never reject what could be in the result.

Queries meet candidates in blocks: candidates are dealt to slots and queries to
chunks, both of bounded size, and every (slot, chunk) is one group. Queries are
copied once per slot and candidates once per chunk of queries. Each group gives
its k best per query, and these few meet in the end.

Vectors that are null or hold null or non-finite components, and rows without
an id, take no part. Vectors meet those of the same length only. Rows that
share the query's id are its own. Queries that repeat id and vector are asked
once; repeated candidates are candidates of their own. Components are integers,
``floor(scale * x)``; scores beyond 64 bits are not defined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SLOT_ROWS = 32_768
CHUNK_QUERIES = 16_384
#: Queries whose coarse bounds are held at once.
AT_ONCE = 32


def valid(vector: Column) -> Column:
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(False).astype(np.float64)
    whole = np.floor(scale * flat)
    return whole.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _levels(width: int) -> list[int]:
    out, n = [], 1
    while n <= max(1, width // 2):
        out.append(n)
        n *= 2
    return out


def _stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations, scaled so that their products add up to the bound."""
    parts = np.array_split(x, segments, axis=1)
    root = np.sqrt([p.shape[1] for p in parts])
    mean = np.stack([p.mean(axis=1) for p in parts], axis=1) * root
    dev = np.stack([p.std(axis=1) for p in parts], axis=1) * root
    return np.hstack([mean, dev])


class _Block:
    """Candidates of one group with their statistics at all resolutions."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.levels = _levels(x.shape[1]) if x.shape[1] else []
        self.stats = [_stats(self.x, s) for s in self.levels]
        self.norm = np.sqrt((self.x**2).sum(axis=1))
        self.top = np.abs(self.x).max(initial=0.0)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.top * np.abs(q).max(initial=0.0) * max(1, len(q)) < 2**52:
            return (self.x[rows] @ q).astype(np.int64)  # exact in doubles
        return self.x[rows].astype(np.int64) @ q.astype(np.int64)

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query row, candidate rows, scores) of the k best of each query."""
        seen = [_stats(queries, s) for s in self.levels]
        for lo in range(0, len(queries), AT_ONCE):
            hi = min(lo + AT_ONCE, len(queries))
            coarse = seen[0][lo:hi] @ self.stats[0].T if seen else np.zeros((hi - lo, len(self.ids)))
            for j in range(lo, hi):
                yield j, *self._one(int(query_ids[j]), queries[j], k, coarse[j - lo],
                                    [s[j] for s in seen])

    def _one(self, own: int, q: np.ndarray, k: int, bound: np.ndarray, stats: list[np.ndarray]):
        left = np.flatnonzero(self.ids != own)
        if len(left) > 4 * k:
            # Rounding of the bound is far below this share of the norms.
            slack = 1e-9 * np.sqrt(q @ q) * self.norm + 0.5
            start = left[np.argpartition(-bound[left], 4 * k)[: 4 * k]]
            bar = np.partition(self.scores(start, q), -k)[-k]
            left = left[bound[left] + slack[left] >= bar]
            for mine, theirs in zip(stats[1:], self.stats[1:]):
                if len(left) <= 4 * k:
                    break
                left = left[theirs[left] @ mine + slack[left] >= bar]
        score = self.scores(left, q)
        order = np.lexsort((self.ids[left], -score))[:k]
        return left[order], score[order]


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: float = 1024.0,
    key: str = "vec_id",
    vector: str = "embedding",
    slot_rows: int = SLOT_ROWS,
    chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row where
    ``is_query``, a predicate over the columns of ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & valid(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"),
        F.size(vector).alias("width"), F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    facts = rows.agg(F.count("*"), F.count_if("asks")).first()
    cores = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slots = max(min(cores, -(-facts[0] // 1024)), -(-facts[0] // slot_rows), 1)
    chunks = max(1, -(-facts[1] // chunk_queries))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def deal(column: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    group = ("width", "slot", "chunk")
    left = rows.where("asks").select("id", "v", "width").distinct().select(
        "*", deal(F.col("id"), chunks).alias("chunk"), every(slots).alias("slot")
    )
    right = rows.select("id", "v", "width").select(
        "*", deal(F.col("id"), slots).alias("slot"), every(chunks).alias("chunk")
    )

    def meet(asked: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        if len(asked) and len(block):
            ids, queries = asked.column("id").to_numpy(), _matrix(asked.column("v"), scale)
            index = _Block(block.column("id").to_numpy(), _matrix(block.column("v"), scale))
            forms = [int.from_bytes(hashlib.blake2b(q.tobytes(), digest_size=8).digest(), "little", signed=True)
                     for q in queries]
            for j, hits, score in index.best(ids, queries, k):
                n = len(hits)
                out.append((np.full(n, ids[j]), np.full(n, forms[j]), index.ids[hits], score))
        columns = [np.concatenate([o[i] for o in out]) if out else [] for i in range(4)]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in
                         zip(("query_id", "form", "vec_id", "score"), columns)})

    best = (
        left.groupBy(*group).cogroup(right.groupBy(*group))
        .applyInArrow(meet, "query_id long, form long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "form").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
