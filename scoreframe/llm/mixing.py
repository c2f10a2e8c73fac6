"""Mix sources to target weights by a low-discrepancy schedule.

Every source's documents, in a hashed order, form one stream of words that is
cut into equal blocks. The mix is a row of slots: slot ``k`` takes the golden
ratio point ``frac(k * 0.618...)``, the cumulative shares of the sources map it
to one of them, and the slot's rank among the slots of its source names the
block that it takes. Streams are repeated when a target exceeds the source, and
a source's last block is cut where its target is reached.

A source may hold most rows: its running sums and ranks are taken in two steps,
inside small buckets and over one row per bucket. Only numbers about sources
(count and totals) come to the driver.

Null texts have size 0 and are taken 0 times; the null source is a source of
its own. Repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.scale import BROADCAST_ROWS, fits
from .base import saved, word_count, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 1024
GOLDEN = 0.6180339887498949
#: Rows of one source that a bucket of the hashed order holds, about.
BUCKET_ROWS = 20_000
#: Neighbouring slots that are ranked together.
SLOT_CHUNK = 50_000


@dataclass(frozen=True)
class Mix:
    """``sized``: one row per document with its place in the stream of its source.
    ``spans``: the words [start, end) that each slot takes of each document."""

    sized: DataFrame
    spans: DataFrame


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Add ``sid``, ``weight`` and ``target`` to one row per source.

    ``sources`` has ``source`` and ``source_size``. The weights repeat over the
    sources by code point, null last. Together the targets are ``share`` of all
    sizes; a target stops at ``cap`` times its source and the excess goes to
    the others by weight. In the order of cap by weight the capped sources come
    first, so the first source whose share is below its cap sets the rate of
    all that follow.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    listed = sources.withColumn("sid", (F.row_number().over(by_name) - 1).cast("int")).withColumn(
        "weight", F.get(given, F.col("sid") % len(weights))
    )
    order = (F.col("top") / F.col("weight"), F.col("sid"))
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(
        F.sum("top").over(before), F.lit(0)
    )
    rated = listed.withColumn("top", F.col("source_size") * cap).withColumn(
        "rate", left / F.sum("weight").over(after)
    )
    # The first source in this order that stays below its cap.
    below = F.when(
        F.col("top") > F.col("rate") * F.col("weight"), F.struct(*order, F.col("rate").alias("rate"))
    )
    free = F.min(below).over(all_rows)["rate"]
    return rated.select(
        "sid", "source", "source_size", "weight",
        F.least(free * F.col("weight"), F.col("top").cast("double")).alias("target"),
    )


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """The hashed order of a source's documents."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def streams(docs: DataFrame, plan: DataFrame, key: str, seed: str, rows: int) -> DataFrame:
    """Add ``at``: the words of the same source before the document.

    The order is by hash; its first hex digits are the bucket.
    """
    digits, n = 1, max(1, rows // BUCKET_ROWS)
    while 16**digits < n and digits < 8:
        digits += 1
    placed = docs.withColumn("__key", shuffle_key(F.col(key), seed)).withColumn(
        "__bucket", F.substring("__key", 1, digits)
    )
    earlier = Window.partitionBy("sid").orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = (
        placed.groupBy("sid", "__bucket")
        .agg(F.sum("size").alias("__sum"))
        .select("sid", "__bucket",
                F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    )
    within = (
        Window.partitionBy("sid", "__bucket")
        .orderBy("__key", F.col(key), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = placed.withColumn("__in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return (
        inner.join(base, ["sid", "__bucket"])
        .withColumn("at", F.col("__base") + F.col("__in"))
        .drop("__key", "__bucket", "__in", "__base")
    )


def schedule(spark, plan: DataFrame, slots: int, n_sources: int) -> DataFrame:
    """(slot, sid, rank): ``need`` slots for each source, in low-discrepancy order.

    ``plan`` has sid and need (slots of the source). The points give a source
    its share of the slots up to a few; what it gets beyond ``need`` is left
    out, what it lacks follows at the end.
    """
    grid = max(1, 2 * n_sources)
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = plan.where("need > 0").withColumn("__upto", F.sum("need").over(upto)).select(
        "sid", "need",
        ((F.col("__upto") - F.col("need")) / F.lit(float(slots))).alias("__lo"),
        F.when(F.col("__upto") >= slots, F.lit(2.0))
        .otherwise(F.col("__upto") / F.lit(float(slots))).alias("__hi"),
    )
    last = F.least(F.floor(F.col("__hi") * grid), F.lit(grid - 1))
    cells = bounds.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__lo") * grid), last)))
    if n_sources <= BROADCAST_ROWS // 4:
        cells = F.broadcast(cells)
    turn = F.col("slot") * F.lit(GOLDEN)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn(
        "__x", turn - F.floor(turn)
    ).withColumn("__cell", F.floor(F.col("__x") * grid))
    drawn = points.join(
        cells,
        (points["__cell"] == cells["__cell"]) & (F.col("__x") >= F.col("__lo"))
        & (F.col("__x") < F.col("__hi")),
    ).select("slot", "sid", "need", F.floor(F.col("slot") / SLOT_CHUNK).alias("__chunk"))
    earlier = Window.partitionBy("sid").orderBy("__chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = (
        drawn.groupBy("sid", "__chunk").agg(F.count("*").alias("__n"))
        .select("sid", "__chunk", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    )
    within = Window.partitionBy("sid", "__chunk").orderBy("slot")
    ranked = (
        drawn.withColumn("__r", F.row_number().over(within) - 1)
        .join(base, ["sid", "__chunk"])
        .select("slot", "sid", (F.col("__base") + F.col("__r")).alias("rank"), "need")
        .where("rank < need")
    )
    got = drawn.groupBy("sid").agg(F.count("*").alias("__got"))
    lacking = (
        plan.where("need > 0").join(got, "sid", "left")
        .withColumn("__got", F.coalesce("__got", F.lit(0)))
        .where("__got < need")
        .withColumn("rank", F.explode(F.sequence(F.col("__got"), F.col("need") - 1)))
        .select((F.lit(slots) + F.col("rank")).alias("slot"), "sid", "rank")
    )
    return ranked.select("slot", "sid", "rank").unionByName(lacking)


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    block_words: int = BLOCK_WORDS,
    seed: str = "mix",
) -> Mix:
    """Plan the mix of ``docs``; columns other than the three named are not read."""
    spark = docs.sparkSession
    counted = saved(
        docs.select(
            F.col(key).alias("doc_id"), F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
        ),
        "mix-sizes",
    )
    sources = counted.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("rows")
    )
    plan = targets(sources.drop("rows"), weights, share, cap)
    quota = F.floor("target").cast("long")
    nb = F.ceil(F.col("source_size") / block_words)
    plan = saved(
        plan.withColumn("quota", quota)
        .withColumn("blocks", nb)
        .withColumn("full", F.when(F.col("source_size") > 0,
                                   F.expr("quota div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("quota") - F.col("full") * F.col("source_size"))
        .withColumn("need", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / block_words)),
        "mix-sources",
    )
    # Numbers about the sources, whatever their count, in one row.
    facts = plan.agg(F.sum("need"), F.count("*")).first()
    slots, n_sources = int(facts[0] or 0), int(facts[1])
    rows = counted.count()
    small = plan if n_sources > BROADCAST_ROWS // 4 else F.broadcast(plan)
    known = counted.join(
        small.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))
    ).drop("__source")
    columns = ("sid", "doc_id", "source", "size", "source_size", "target")
    sized = saved(streams(known.select(*columns), plan, "doc_id", seed, rows), "mix-streams")
    first, last = F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}")
    pieces = (
        sized.where("size > 0")
        .select("sid", "doc_id", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
        .withColumn("lo", F.greatest("at", F.col("block") * block_words))
        .withColumn("hi", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words))
    )
    chosen = schedule(spark, plan, slots, n_sources).join(
        small.select("sid", "blocks", "full", "rest"), "sid"
    ).select(
        "slot", "sid", F.expr("rank div blocks").alias("epoch"),
        F.expr("rank % blocks").alias("block"), "full", "rest",
    )
    stop = F.when(F.col("epoch") < F.col("full"), F.col("hi")).otherwise(
        F.least(F.col("hi"), F.col("rest"))
    )
    spans = (
        chosen.join(pieces, ["sid", "block"])
        .withColumn("stop", stop)
        .where("lo < stop")
        .select(
            "slot", "epoch", "sid", "doc_id", "at", (F.col("lo") - F.col("at")).alias("start"),
            (F.col("stop") - F.col("at")).alias("end"),
        )
    )
    return Mix(sized, spans)


def taken(plan: Mix) -> DataFrame:
    """One row per document: its size, its source's size and target, words taken."""
    words = plan.spans.groupBy("sid", "at").agg(F.sum(F.col("end") - F.col("start")).alias("taken"))
    present = plan.sized.where("size > 0").join(words, ["sid", "at"], "left")
    empty = plan.sized.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return present.unionByName(empty).withColumn("taken", F.coalesce("taken", F.lit(0)))


def texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: one row per pass over a document, columns as in ``docs``.

    A document that a source's target cuts gives its first words, joined by
    single spaces. Documents of which nothing is taken, and those without
    words, are left out. Needs ``doc_id``, ``text`` and ``source``.
    """
    plan = mix(docs, **options)
    passes = plan.spans.groupBy("sid", "at", "epoch").agg(
        F.sum(F.col("end") - F.col("start")).alias("__take")
    )
    takes = (
        plan.sized.where("size > 0").join(passes, ["sid", "at"])
        .groupBy("sid", "at", "doc_id", "source", "size")
        .agg(F.sort_array(F.collect_list("__take"), asc=False).alias("__takes"))
    )
    repeated = Window.partitionBy("doc_id", "source", "size")
    takes = saved(
        takes.select(
            F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
            F.col("size").alias("__size"), "__takes",
            F.row_number().over(repeated.orderBy("at")).alias("__nth"),
            F.count("*").over(repeated).alias("__same"),
        ),
        "mix-takes",
    )
    sized = docs.withColumn("__words", word_count(F.col("text"))).where("__words > 0")
    key = (
        F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("__words") == F.col("__size"))
    )
    alone = takes.where("__same = 1")
    some = takes.where("__same > 1")
    # Documents meet their takes where they are while those are few. Rows that
    # repeat id, source and size are matched one to one by their order.
    known = F.broadcast(alone) if fits(alone) else alone
    again = Window.partitionBy("doc_id", "source", "__words").orderBy(F.xxhash64("text"))
    keys = some.select("__id", "__source", "__size").distinct()
    numbered = sized.join(F.broadcast(keys) if fits(keys) else keys, key, "left_semi").withColumn(
        "__row", F.row_number().over(again)
    )
    columns = (*docs.columns, "__words", "__takes")
    copies = (
        sized.join(known, key).select(*columns)
        .unionByName(numbered.join(some, key & (F.col("__row") == F.col("__nth"))).select(*columns))
        .withColumn("__take", F.explode("__takes"))
    )
    part = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("__take").cast("int")), " ")
    text = F.when(F.col("__take") == F.col("__words"), F.col("text")).otherwise(part)
    return copies.withColumn("text", text).select(*docs.columns)
