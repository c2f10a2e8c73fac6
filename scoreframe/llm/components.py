"""Connected components of a link table that may have hot nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .base import saved


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches.

    ``links`` has long columns ``a`` and ``b``. Alternates large-star and
    small-star steps: every node points its larger neighbours, then its smaller
    ones, at the smallest node it knows, until nothing moves. Each round is
    written to the shared folder, so lineage stays short. Minima are combined
    before the shuffle; nothing about nodes reaches the driver.
    """

    def state(edges: DataFrame) -> tuple:
        sums = edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        )
        return tuple(sums.first())

    edges = saved(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    seen = state(edges)
    for _ in range(rounds):
        if seen[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(floor, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .unionByName(floor.select("a", F.col("m").alias("b")))
            .distinct()
        )
        edges = saved(small, "links")
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
