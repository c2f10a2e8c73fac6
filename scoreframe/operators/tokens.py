"""Metrics over token tables: embedding match and token log-likelihood.

The encoder stays outside; these operators take its output as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.scale import attach, cut, running_totals

# Token vectors per block. One block pair is one dense product in one task.
BLOCK = 512


def _blocks(tokens: DataFrame, side: str, block: int) -> DataFrame:
    """Pack each text's token vectors into blocks of at most ``block`` rows.

    Blocks follow token positions, so a text of any length never sits in one
    row or one task as a whole.
    """
    return (
        tokens.groupBy("id", F.floor(F.col("pos") / block).alias(f"{side}_block"))
        .agg(F.collect_list(F.struct("pos", "vector")).alias(f"{side}_rows"))
    )


def embedding_match(
    pred_tokens: DataFrame, ref_tokens: DataFrame, block: int = BLOCK
) -> DataFrame:
    """Precision, recall and F1 of best cosine matches per text pair.

    Inputs: ``id, pos, vector array<float>`` with unique positions per text.
    Each predicted token takes its best cosine to any reference token
    (precision is the mean), and the reverse for recall. Blocks of the two
    sides meet in an equi-join on ``id``; a task turns a block pair into one
    matrix product and keeps a row and a column maximum, so token pairs are
    never materialised. AQE splits a hot ``id`` by its prediction blocks.
    A side without tokens scores 0.
    """
    pairs = _blocks(pred_tokens, "pred", block).join(_blocks(ref_tokens, "ref", block), "id")

    return _scores(_best(pairs, pred_tokens), pred_tokens, ref_tokens)


def _unit_rows(block: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit vectors of one block, without Python objects."""
    tokens = block.values
    flat = tokens.field("vector").flatten().to_numpy(zero_copy_only=False)
    grid = flat.astype(np.float64).reshape(len(tokens), -1)
    norm = np.linalg.norm(grid, axis=1, keepdims=True)
    places = tokens.field("pos").to_numpy(zero_copy_only=False)
    return places, grid / np.where(norm == 0, 1.0, norm)


def _best(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Best cosine of each token inside each block pair: ``id, side, pos, best``."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sides, places, values = [], [], [], []
            for key, pred, ref in zip(*(batch.column(i) for i in range(3))):
                pred_at, pred_grid = _unit_rows(pred)
                ref_at, ref_grid = _unit_rows(ref)
                cosine = pred_grid @ ref_grid.T
                for side, at, top in (
                    ("pred", pred_at, cosine.max(axis=1)), ("ref", ref_at, cosine.max(axis=0)),
                ):
                    ids += [key.as_py()] * len(at)
                    sides += [side] * len(at)
                    places.append(at)
                    values.append(top)
            if not ids:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, batch.schema.field("id").type),
                    pa.array(sides, pa.string()),
                    pa.array(np.concatenate(places), pa.int64()),
                    pa.array(np.concatenate(values), pa.float64()),
                ],
                names=["id", "side", "pos", "best"],
            )

    id_type = tokens.schema["id"].dataType.simpleString()
    return pairs.select("id", "pred_rows", "ref_rows").mapInArrow(
        best, f"id {id_type}, side string, pos bigint, best double"
    )


def _scores(tops: DataFrame, pred_tokens: DataFrame, ref_tokens: DataFrame) -> DataFrame:
    """Precision, recall and F1 per text from the best cosines."""
    per_token = tops.groupBy("id", "side", "pos").agg(F.max("best").alias("best"))
    matched = per_token.groupBy("id").agg(
        F.avg(F.when(F.col("side") == "pred", F.col("best"))).alias("precision"),
        F.avg(F.when(F.col("side") == "ref", F.col("best"))).alias("recall"),
    )
    every = pred_tokens.select("id").union(ref_tokens.select("id")).distinct()
    p, r = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("precision", "recall"))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return every.join(matched, "id", "left").select(
        "id", p.alias("precision"), r.alias("recall"), f1.alias("f1")
    )


def direction_blocks(tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of at most ``block`` tokens of a text that point in similar directions.

    A token's code is the sides of some fixed random planes it lies on, one
    plane per doubling of the text's tokens beyond ``block``; tokens of one code
    are cut by their position. Returns ``id, block, rows, centre, radius``:
    the mean of the unit vectors and the largest distance from it. Runs jobs
    and stores the blocks, which the bounds and the products both read.
    """
    sizes = tokens.groupBy("id").agg(F.count(F.lit(1)).alias("__n"))
    bits = F.greatest(F.ceil(F.log2(F.col("__n") / block)), F.lit(0)).cast("int")
    known = attach(tokens, sizes.select("id", bits.alias("__bits")), ["id"], ["pos"])

    @F.arrow_udf("long")
    def code(vectors: pa.Array, planes: pa.Array) -> pa.Array:
        wanted = planes.to_numpy(zero_copy_only=False)
        top = int(wanted.max(initial=0))
        if not top:
            return pa.array(np.zeros(len(vectors), np.int64))
        grid = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        normals = np.random.default_rng(11).normal(size=(62, grid.shape[1]))[:top]
        sides = (grid @ normals.T > 0) & (np.arange(top) < wanted[:, None])
        return pa.array(sides @ (1 << np.arange(top, dtype=np.int64)), pa.int64())

    coded = known.select("id", "pos", "vector", code("vector", "__bits").alias("__code"))
    ranked = running_totals(coded, ["id", "__code"], ["pos"], {"one": F.lit(1)})
    packed = ranked.groupBy("id", "__code", F.floor(F.col("one_before") / block).alias("__part")).agg(
        F.collect_list(F.struct("pos", "vector")).alias("rows")
    )

    @F.arrow_udf("struct<centre:array<double>,radius:double>")
    def ball(blocks: pa.Array) -> pa.Array:
        out = []
        for one in blocks:
            units = _unit_rows(one)[1]
            centre = units.mean(axis=0)
            out.append({"centre": centre, "radius": np.linalg.norm(units - centre, axis=1).max()})
        kind = pa.struct([("centre", pa.list_(pa.float64())), ("radius", pa.float64())])
        return pa.array(out, kind)

    named = packed.select("id", F.struct("__code", "__part").alias("block"), "rows", ball("rows").alias("ball"))
    return cut(named.select("id", "block", "rows", "ball.centre", "ball.radius"))


def surviving_pairs(pred: DataFrame, ref: DataFrame, group: int = BLOCK) -> DataFrame:
    """``id, pred_block, ref_block`` of the blocks that may hold a best cosine of either.

    For unit vectors within ``r`` of ``a`` and ``s`` of ``b`` the cosine is within
    ``r|b| + s|a| + r s`` of ``a b``. The largest lower end over all partners is a
    floor of every best cosine of a block; a pair whose upper end is below the
    floors of both its blocks is skipped. Centres meet in groups: a first pass
    gives the floors, a second the pairs, so skipped pairs are never rows. The floors are stored, one row a block.
    """
    id_type = pred.schema["id"].dataType.simpleString()

    def groups(blocks: DataFrame, name: str) -> DataFrame:
        held = [c for c in blocks.columns if c not in ("id", "rows")]
        number = blocks.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / group).alias("__groups"))
        dealt = blocks.drop("rows").join(number, "id")
        at = F.pmod(F.xxhash64("block"), F.col("__groups"))
        return dealt.groupBy("id", at.alias(f"__{name}")).agg(F.collect_list(F.struct(*held)).alias(name))

    def ends(one: pa.ListScalar, two: pa.ListScalar):
        (a, r, la), (b, s, lb) = map(_balls, (one.values, two.values))
        slack = r[:, None] * lb + s * la[:, None] + r[:, None] * s + 1e-9
        middle = a @ b.T
        return middle - slack, middle + slack

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, one, two in zip(*(batch.column(n) for n in ("id", "pred", "ref"))):
                low = ends(one, two)[0]
                names = pa.concat_arrays([one.values.field("block"), two.values.field("block")])
                sides = ["pred"] * len(one.values) + ["ref"] * len(two.values)
                lowest = np.concatenate([low.max(axis=1), low.max(axis=0)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(sides), batch.schema.field("id").type), names,
                     pa.array(sides), pa.array(lowest)], names=["id", "block", "side", "floor"],
                )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, one, two in zip(*(batch.column(n) for n in ("id", "pred", "ref"))):
                high = ends(one, two)[1]
                floor = [x.values.field("floor").to_numpy(zero_copy_only=False) for x in (one, two)]
                at = np.nonzero((high >= floor[0][:, None]) | (high >= floor[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(at[0]), batch.schema.field("id").type),
                     one.values.field("block").take(pa.array(at[0])),
                     two.values.field("block").take(pa.array(at[1]))],
                    names=["id", "pred_block", "ref_block"],
                )

    kind = pred.schema["block"].dataType.simpleString()
    low = cut(
        groups(pred, "pred").join(groups(ref, "ref"), "id")
        .mapInArrow(floors, f"id {id_type}, block {kind}, side string, floor double")
        .groupBy("id", "block", "side").agg(F.max("floor").alias("floor"))
    )
    with_floor = [
        blocks.join(low.filter(F.col("side") == side).drop("side"), ["id", "block"])
        for blocks, side in ((pred.drop("rows"), "pred"), (ref.drop("rows"), "ref"))
    ]
    return groups(with_floor[0], "pred").join(groups(with_floor[1], "ref"), "id").mapInArrow(
        pairs, f"id {id_type}, pred_block {kind}, ref_block {kind}"
    )


def _balls(blocks: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, radii and lengths of the centres."""
    flat = blocks.field("centre").flatten().to_numpy(zero_copy_only=False)
    centres = flat.reshape(len(blocks), -1)
    radii = blocks.field("radius").to_numpy(zero_copy_only=False)
    return centres, radii, np.linalg.norm(centres, axis=1)


def embedding_match_pruned(
    pred_tokens: DataFrame, ref_tokens: DataFrame, block: int = BLOCK
) -> DataFrame:
    """``embedding_match`` for texts of very many tokens: the same scores, fewer products.

    Tokens are blocked by direction, and only pairs of blocks whose bounds
    allow a best cosine are multiplied. The pairs are dealt by
    (id, prediction block, reference block), so one text that holds most tokens
    is spread over all tasks. Stores the blocks of both sides.
    """
    pred, ref = (direction_blocks(side, block) for side in (pred_tokens, ref_tokens))
    pairs = surviving_pairs(pred, ref).repartition("id", "pred_block", "ref_block")
    for side, blocks in (("pred", pred), ("ref", ref)):
        rows = blocks.select("id", F.col("block").alias(f"{side}_block"), F.col("rows").alias(f"{side}_rows"))
        pairs = pairs.join(rows, ["id", f"{side}_block"])
    return _scores(_best(pairs, pred_tokens), pred_tokens, ref_tokens)


def mean_loglik(token_logprobs: DataFrame) -> DataFrame:
    """Mean token log-probability per text: ``id, logprob`` to ``id, score``."""
    return token_logprobs.groupBy("id").agg(F.avg("logprob").alias("score"))


def mean_loglik_multi(
    token_logprobs: DataFrame, agg: str = "mean", strict: bool = True
) -> DataFrame:
    """Mean or best score over several references per text.

    Input: ``id, ref_no, logprob``. All texts must have the same number of
    references; ``strict`` makes the job fail otherwise.
    """
    pick = {"mean": F.avg, "max": F.max}
    if agg not in pick:
        raise ValueError(f"agg must be 'mean' or 'max', not {agg!r}")
    per_ref = token_logprobs.groupBy("id", "ref_no").agg(F.avg("logprob").alias("score"))
    per_id = per_ref.groupBy("id").agg(
        pick[agg]("score").alias("score"), F.count(F.lit(1)).alias("refs")
    )
    if not strict:
        return per_id
    refs = token_logprobs.groupBy("id").agg(F.count_distinct("ref_no").alias("refs"))
    most = refs.agg(F.max("refs")).scalar()
    unequal: Column = F.raise_error(F.lit("texts have different numbers of references"))
    return per_id.withColumn(
        "refs", F.when(F.col("refs") == most, F.col("refs")).otherwise(unequal.cast("long"))
    )
