"""Hard negatives: candidates in lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster with centre ``c`` whose members
lie within an angle ``r`` of it, a candidate ``x`` at an angle ``t`` from the centre
has an inner product of at most

    |a| |x| cos(max(0, t - r))

with any member ``a``. Candidates are sorted once per cluster by ``|x| cos(max(0,
t - r))``, largest first. Every member walks this list from the top, in steps, with
exact scores, and stops as soon as the bound of the next candidate, times its own
length, is below all that it still looks for: the rest is then certain to hold
nothing for it. The clusters only decide how soon that is, never what is found.

The list is walked twice. The first walk finds the positives of an anchor, its
nearest rows of the same label. Their scores set windows for the second: per
positive the nearest rows of other labels whose score is within given shares of
the positive's. Below the lowest window or the worst of full lists no row counts.

Candidates are dealt to slots and anchors to chunks of whole clusters, both of
bounded size; a cluster beyond that is split. Every (slot, chunk) is one group in
which each cluster sorts the slot's candidates, and groups give a few rows per
anchor that meet in the end. Centres are fitted on at most ``FIT_ANCHORS`` anchors.

Rows without an id, label or vector and vectors with null or non-finite components
take no part. Vectors meet those of the same length only. Rows that share the
anchor's id are its own; anchors that repeat id, label and vector are asked once,
repeated candidates are candidates of their own. Equal scores go by the smaller
id. Other columns are left out; without anchors or candidates there are no rows.
Scores are integer inner products of ``floor(scale * x)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import saved
from .topk import valid

#: Components of candidates in a slot and of anchors in a chunk, about.
SLOT_VALUES = 4_000_000
CHUNK_VALUES = 2_000_000
#: Anchors that the centres are fitted on, their number, and rounds of fitting.
FIT_ANCHORS = 4096
CENTRES = 64
ROUNDS = 5
#: Candidates that a walk scores before it looks at the bound again, at first.
STEP = 256

_GROUP = ("width", "slot", "chunk")
_RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
           "negative_score long")


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(_lengths(x), 1e-300)[:, None]


def fit_centres(x: np.ndarray, number: int = CENTRES, rounds: int = ROUNDS) -> np.ndarray:
    """Directions that represent the given vectors: spherical k-means, the same each time."""
    points = _directions(x)
    if not points.size:
        return points[:1]
    points = points[np.lexsort(points.T[::-1])]
    chosen = np.unique(np.linspace(0, len(points) - 1, min(number, len(points))).astype(int))
    centres = points[chosen]
    for _ in range(rounds):
        mine = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, points)
        some = _lengths(sums) > 0
        centres[some] = _directions(sums[some])
    return centres


class _Candidates:
    """Rows of one slot; exact scores, and their order for a cluster."""

    def __init__(self, block: pa.Table):
        ids = block.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], block.column("label").to_numpy()[order]
        self.x = _vectors(block.column("v"))[order]
        self.length, self.direction = _lengths(self.x), _directions(self.x)
        self.top = np.abs(self.x).max(initial=0.0)

    def shared_list(self, members: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by falling bound for any member of length one, and the bounds."""
        near = np.clip(_directions(members) @ centre, -1, 1)
        away = np.arccos(np.clip(self.direction @ centre, -1, 1)) - np.arccos(near.min(initial=1.0))
        # A little more than the bound, for rounding.
        bound = self.length * (np.cos(np.maximum(away, 0.0)) + 1e-7)
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]

    def scores(self, rows: np.ndarray, a: np.ndarray) -> np.ndarray:
        if self.top * np.abs(a).max(initial=0.0) * max(1, len(a)) < 2**52:
            return (self.x[rows] @ a).astype(np.int64)  # exact in doubles
        return self.x[rows].astype(np.int64) @ a.astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties by smaller id, in that order."""
    if len(score) > k:
        kept = np.flatnonzero(score >= np.partition(score, -k)[-k])
    else:
        kept = np.arange(len(score))
    return kept[np.lexsort((ids[kept], -score[kept]))[:k]]


def _walk(block: _Candidates, order: np.ndarray, bound: np.ndarray, a: np.ndarray, own: int,
          takes, floor: int, tops: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ceiling of ``tops`` the k best rows that ``takes`` admits with scores of
    at least ``floor`` and at most the ceiling: their ids and scores."""
    reach = bound * np.sqrt(a @ a)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in tops]
    at, step = 0, STEP
    while at < len(order):
        # What a row must reach to count for at least one ceiling.
        bars = [s[-1] if len(s) == k else floor for _, s in found]
        if reach[at] < max(floor, min(bars, default=floor)):
            break
        rows = order[at : at + step]
        rows = rows[takes(rows) & (block.ids[rows] != own)]
        score = block.scores(rows, a)
        for i, top in enumerate(tops):
            fits = (score >= bars[i]) & (score <= top)
            ids = np.concatenate([found[i][0], block.ids[rows[fits]]])
            sums = np.concatenate([found[i][1], score[fits]])
            best = _best(sums, ids, k)
            found[i] = ids[best], sums[best]
        at, step = at + step, 2 * step
    return found


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    k: int = 10,
    shares: tuple[int, int] = (30, 90),
    scale: float = 256.0,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    slot_values: int = SLOT_VALUES,
    chunk_values: int = CHUNK_VALUES,
    centres: int = CENTRES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for
    each row where ``is_anchor`` and each of its ``positives`` the k hardest negatives.

    A negative's score is between ``shares`` per cent of the positive's; for scores
    below zero no score is.
    """
    rows = saved(
        vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & valid(F.col(vector))).select(
            F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
            F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"),
            F.size(vector).alias("width"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        ), "negatives-rows")
    anchors = rows.where("asks").select("id", "label", "v", "width").distinct()
    widths = {r.width: r for r in rows.groupBy("width").agg(
        F.count("*").alias("n"), F.count_if("asks").alias("asked")).where("asked > 0").collect()}
    if not widths:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    chunked = saved(_clusters(anchors, list(widths), centres, chunk_values), "negatives-anchors")
    cores = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slots = {w: max(1, min(cores, -(-r.n // 1024)), -(-r.n * w // slot_values)) for w, r in widths.items()}
    return _windows(rows, chunked, slots, positives, k, shares)


def _sized(sizes: dict[int, int]) -> Column:
    """A number that depends on the width."""
    return F.create_map(*[F.lit(x) for w, n in sizes.items() for x in (w, n)])[F.col("width")]


def _clusters(anchors: DataFrame, widths: list[int], centres: int, chunk_values: int) -> DataFrame:
    """Anchors with the cluster that they belong to, its centre and their chunk."""
    fitted = {}
    for width in widths:
        sample = anchors.where(F.col("width") == width).orderBy(F.xxhash64("id", "v")).limit(FIT_ANCHORS)
        fitted[width] = fit_centres(_vectors(sample.select("v").toArrow().column("v")), centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                int((_directions(np.array([v.as_py()], float).reshape(1, -1)) @ fitted[w.as_py()].T).argmax())
                if w.as_py() else 0
                for w, v in zip(batch.column("width"), batch.column("v"))
            ]
            yield batch.append_column("cluster", pa.array(found, pa.int32()))

    schema = "id long, label long, v array<double>, width int, cluster int"
    near = saved(anchors.mapInArrow(nearest, schema), "negatives-clusters")
    # Clusters fill chunks one after the other; one beyond a chunk is split by a hash.
    sizes = near.groupBy("width", "cluster").agg(F.count("*").alias("n")).orderBy("width", "cluster").collect()
    place, chunk, held = {}, 0, 0
    for r in sizes:
        room = max(1, chunk_values // max(1, r.width))
        parts = -(-r.n // room)
        if held and (parts > 1 or held + r.n > room or (r.width, chunk) not in {(w, c) for (w, _), (c, _) in place.items()}):
            chunk, held = chunk + 1, 0
        place[r.width, r.cluster] = (chunk, parts)
        held += r.n
        if parts > 1:
            chunk, held = chunk + parts, 0
    known = F.create_map(*[F.lit(x) for (w, c), (first, parts) in place.items()
                           for x in (f"{w}:{c}", first * 2**20 + parts)])
    code = known[F.concat_ws(":", "width", "cluster")].cast("long")
    first, parts = F.shiftright(code, 20), code.bitwiseAND(F.lit(2**20 - 1))
    return near.withColumn("chunk", (first + F.pmod(F.xxhash64("id", "v"), parts)).cast("int"))


def _windows(rows: DataFrame, chunked: DataFrame, slots: dict[int, int], positives: int, k: int,
             shares: tuple[int, int]) -> DataFrame:
    spark = rows.sparkSession
    every = F.explode(F.sequence(F.lit(0), _sized(slots) - 1)).alias("slot")
    pairs = spark.createDataFrame(
        chunked.select("width", "chunk").distinct().collect(), "width int, chunk int")
    dealt = rows.where(F.col("width").isin(list(slots))).select(
        "id", "label", "v", "width",
        F.pmod(F.xxhash64("id", "v"), _sized(slots)).cast("int").alias("slot"))
    # Chunks of a width are few: all its anchors by the size of a chunk.
    block = dealt.join(F.broadcast(pairs), "width")

    def walk(asked: pa.Table, slot: pa.Table, first: bool) -> pa.Table:
        out: list[tuple] = []
        if len(asked) and len(slot):
            candidates = _Candidates(slot)
            cluster = asked.column("cluster").to_numpy()
            x, ids, labels = _vectors(asked.column("v")), asked.column("id").to_numpy(), asked.column("label").to_numpy()
            forms = asked.column("form").to_numpy()
            tops = asked.column("tops").to_pylist()
            for c in np.unique(cluster):
                members = np.flatnonzero(cluster == c)
                centre = _directions(_directions(x[members]).sum(axis=0, keepdims=True))[0]
                order, bound = candidates.shared_list(x[members], centre)
                for m in members:
                    if first:
                        low, ceilings, most = np.iinfo(np.int64).min, [np.iinfo(np.int64).max], positives
                        takes = lambda r, m=m: candidates.labels[r] == labels[m]
                    else:
                        # Whole numbers: 100 * s <= high * p and 100 * s >= low * p.
                        ceilings = [shares[1] * p // 100 for p in tops[m]]
                        low, most = min(-(-shares[0] * p // 100) for p in tops[m]), k
                        takes = lambda r, m=m: candidates.labels[r] != labels[m]
                    for i, (hits, score) in enumerate(_walk(
                            candidates, order, bound, x[m], ids[m], takes, low, np.array(ceilings), most)):
                        n = len(hits)
                        top = 0 if first else tops[m][i]
                        out.append((np.full(n, ids[m]), np.full(n, forms[m]), np.full(n, top), hits, score))
        columns = [np.concatenate([o[i] for o in out]) if out else [] for i in range(5)]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in
                         zip(("anchor", "form", "top", "other", "score"), columns)})

    found = "anchor long, form long, top long, other long, score long"
    form = F.xxhash64("label", "v").alias("form")
    asked = chunked.select("id", "label", "v", "width", "cluster", "chunk", form,
                           F.array().cast("array<long>").alias("tops"), every)
    near = (
        asked.groupBy(*_GROUP).cogroup(block.groupBy(*_GROUP))
        .applyInArrow(lambda a, b: walk(a, b, True), found)
    )
    order = Window.partitionBy("anchor", "form").orderBy(F.desc("score"), "other")
    chosen = saved(
        near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
        .select("anchor", "form", "place", F.col("other").alias("positive"), F.col("score").alias("top")),
        "negatives-positives")
    # No score is between shares of a negative one.
    tops = chosen.where("top >= 0").groupBy(F.col("anchor").alias("id"), "form").agg(
        F.sort_array(F.collect_set("top")).alias("tops"))
    again = chunked.select("id", "label", "v", "width", "cluster", "chunk", form).join(
        tops, ["id", "form"]).select("*", every)
    hard = (
        again.groupBy(*_GROUP).cogroup(block.groupBy(*_GROUP))
        .applyInArrow(lambda a, b: walk(a, b, False), found)
    )
    by_top = Window.partitionBy("anchor", "form", "top").orderBy(F.desc("score"), "other")
    ranked = hard.where(100 * F.col("score") >= shares[0] * F.col("top")).withColumn(
        "rank", F.row_number().over(by_top)).where(F.col("rank") <= k)
    return ranked.join(chosen, ["anchor", "form", "top"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
        F.col("other").alias("negative_id"), F.col("top").alias("positive_score"),
        F.col("score").alias("negative_score"))
