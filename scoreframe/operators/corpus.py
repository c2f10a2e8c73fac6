"""Corpus metrics and the other aggregations over scored rows.

Every aggregate here is a sum or a count, so Spark combines it map-side and a
group that holds most of the rows still arrives at the reducer as a handful of
partial rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsers import MISSING
from ..functions.scores import span_counts
from ..functions.text import fold


def aggregate_metrics(scores_long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and count of each row metric: ``by…, metric, value, n``."""
    return (
        scores_long.filter(F.col("value").isNotNull())
        .groupBy(*by, "metric")
        .agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    )


def mean_metrics(rows: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``by…, metric, value, n`` straight from the ``metrics`` map of scored rows.

    The names are known, so each mean is one aggregate over the map. Exploding
    the map would multiply the rows, and Spark would add a size filter that
    computes every metric a second time.
    """
    cells = {f"__m{i}": F.element_at("metrics", F.lit(m)) for i, m in enumerate(metrics)}
    sums = [f(c) for c in cells for f in (
        lambda c: F.avg(c).alias(f"{c}_mean"), lambda c: F.count(c).alias(f"{c}_n"),
    )]
    wide = rows.select(*by, *[v.alias(c) for c, v in cells.items()]).groupBy(*by).agg(*sums)
    out = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(f"{c}_mean").alias("value"),
                F.col(f"{c}_n").alias("n"),
            )
            for c, m in zip(cells, metrics)
        ]
    )
    return wide.select(*by, F.inline(out)).filter(F.col("n") > 0)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def label_counts(
    df: DataFrame, by: Sequence[str] = (), pred: str = "parsed", ref: str = "reference"
) -> DataFrame:
    """Per label: ``support`` (in references), ``predicted`` and ``hits``.

    Rows collapse to (reference, prediction) pair counts first; each pair then
    feeds its two labels, so the second shuffle carries label pairs, not rows.
    """
    pairs = (
        df.select(
            *by,
            F.coalesce(fold(ref), F.lit(MISSING)).alias("__r"),
            F.coalesce(fold(pred), F.lit(MISSING)).alias("__p"),
        )
        .groupBy(*by, "__r", "__p")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    n, zero = F.col("__n"), F.lit(0).cast("long")
    hit = F.when(F.col("__r") == F.col("__p"), n).otherwise(zero)

    def side(label: str, support: Column, predicted: Column, hits: Column) -> Column:
        return F.struct(
            F.col(label).alias("label"), support.alias("support"),
            predicted.alias("predicted"), hits.alias("hits"),
        )

    sides = F.array(side("__r", n, zero, hit), side("__p", zero, n, zero))
    return (
        pairs.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(
            F.sum("support").alias("support"),
            F.sum("predicted").alias("predicted"),
            F.sum("hits").alias("hits"),
        )
    )


def _averages(per_label: DataFrame, by: Sequence[str], average: str) -> DataFrame:
    """Macro and weighted means of per-label F1 (0 where undefined)."""
    f1 = _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted"))
    scored = per_label.withColumn("__f1", f1)
    means = {
        "macro": F.avg("__f1").alias("macro_f1"),
        "weighted": _ratio(F.sum(F.col("__f1") * F.col("support")), F.sum("support")).alias(
            "weighted_f1"
        ),
    }
    wanted = list(means.values()) if average == "both" else [means[average]]
    return scored.groupBy(*by).agg(*wanted)


def f1_labels(
    df: DataFrame,
    average: str = "both",
    by: Sequence[str] = (),
    pred: str = "parsed",
    ref: str = "reference",
) -> DataFrame:
    """Macro and/or weighted F1 over the union of predicted and true labels.

    Labels are compared folded; null counts as the label "missing".
    """
    return _averages(label_counts(df, by, pred, ref), by, average)


def f1_multilabel(
    df: DataFrame,
    average: str = "both",
    by: Sequence[str] = (),
    pred: str = "parsed_vector",
    ref: str = "reference_vector",
) -> DataFrame:
    """F1 over the positions of two 0/1 vectors; empty classes count as 0."""
    pairs = F.arrays_zip(F.col(pred).alias("p"), F.col(ref).alias("r"))
    per_class = (
        # The outer form: a plain explode adds a filter that builds both vectors again.
        df.select(*by, F.posexplode_outer(pairs).alias("label", "__bit"))
        .filter(F.col("label").isNotNull())
        .select(*by, "label", "__bit.p", "__bit.r")
        .groupBy(*by, "label")
        .agg(
            F.sum("r").alias("support"),
            F.sum("p").alias("predicted"),
            F.sum(F.col("p") * F.col("r")).alias("hits"),
        )
    )
    return _averages(per_class, by, average)


def exact_match(
    df: DataFrame,
    by: Sequence[str] = (),
    pred: str = "parsed_spans",
    ref: str = "reference_spans",
) -> DataFrame:
    """Micro precision, recall and F1 over distinct (start, end, label) spans."""
    counted = df.select(*by, span_counts(pred, ref).alias("__c")).select(*by, "__c.*")
    totals = counted.groupBy(*by).agg(
        F.sum("shared").alias("shared"),
        F.sum("predicted").alias("predicted"),
        F.sum("expected").alias("expected"),
    )
    shared, predicted, expected = F.col("shared"), F.col("predicted"), F.col("expected")
    return totals.withColumns(
        {
            "exact_match_precision": _ratio(shared, predicted),
            "exact_match_recall": _ratio(shared, expected),
            "exact_match_f1": _ratio(2 * shared, predicted + expected),
        }
    )


def human_aggregate(state: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Mean (null without scores) and count (0) of human scores per evaluation."""
    rated = state.groupBy("evaluation_id").agg(
        F.avg("score").alias("human_evaluation_mean"),
        F.count("score").alias("human_evaluation_count"),
    )
    return (
        evaluations.select("evaluation_id")
        .join(rated, "evaluation_id", "left")
        .select(
            "evaluation_id",
            "human_evaluation_mean",
            F.coalesce("human_evaluation_count", F.lit(0)).alias("human_evaluation_count"),
        )
    )


def with_human(evaluations: DataFrame, human: DataFrame) -> DataFrame:
    """Put the human mean and count into ``aggregate`` where it was asked for.

    ``evaluations`` has ``evaluation_id, metrics array<string>, aggregate
    map<string,double>``; the mean is left out when nothing is rated.
    """
    joined = evaluations.join(human, "evaluation_id", "left")
    count = F.coalesce(F.col("human_evaluation_count"), F.lit(0)).cast("double")
    base = F.coalesce(F.col("aggregate"), F.create_map().cast("map<string,double>"))
    kept = F.map_filter(
        base, lambda k, v: ~k.isin("human_evaluation_count")
        & ~((k == "human_evaluation_mean") & F.col("human_evaluation_mean").isNotNull())
    )
    added = F.map_filter(
        F.create_map(
            F.lit("human_evaluation_mean"), F.col("human_evaluation_mean").cast("double"),
            F.lit("human_evaluation_count"), count,
        ),
        lambda k, v: v.isNotNull(),
    )
    asked = F.coalesce(F.array_contains("metrics", "human_evaluation"), F.lit(False))
    return joined.withColumn(
        "aggregate", F.when(asked, F.map_concat(kept, added)).otherwise(base)
    ).select(*evaluations.columns)


def run_progress(runs: DataFrame, dataset: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per run: rows in its dataset, rows answered, rounded percent.

    ``runs`` has ``inference_id, dataset_id``; ``dataset`` rows carry their
    ``dataset_id`` and ``outputs`` rows their ``inference_id``.
    """
    totals = dataset.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total"))
    done = outputs.groupBy("inference_id").agg(F.count(F.lit(1)).alias("processed"))
    total = F.coalesce(F.col("total"), F.lit(0))
    processed = F.coalesce(F.col("processed"), F.lit(0))
    percent = F.round(F.coalesce(F.try_divide(100.0 * processed, total), F.lit(0.0)))
    return (
        runs.select("inference_id", "dataset_id")
        .join(totals, "dataset_id", "left")
        .join(done, "inference_id", "left")
        .select(
            "inference_id",
            total.alias("total"),
            processed.alias("processed"),
            percent.cast("int").alias("percent"),
        )
    )


def facet_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column with their row counts."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def facets(df: DataFrame, columns: Sequence[str], chosen: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Counts of all facet columns in one pass: ``facet, value, n``.

    ``chosen`` holds the picked values of some columns. The values of a facet are
    counted over the rows that pass the choices of all others, its own left open, so
    that more of its values can be picked. One set of groups per column and one
    shuffle for all; values without rows are left out, null is a value.
    """
    chosen = chosen or {}
    passes = {c: F.coalesce(F.col(f"`{c}`").isin(*v), F.lit(False)) for c, v in chosen.items() if len(v)}
    if unknown := passes.keys() - set(columns):
        raise ValueError(f"no facets: {sorted(unknown)}")
    failed = sum((F.when(p, 0).otherwise(1) for p in passes.values()), F.lit(0))
    shown = df.select(
        *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(columns)],
        # How many choices a row fails, without the facet's own.
        *[(failed - (F.when(passes[c], 0).otherwise(1) if c in passes else F.lit(0)) == 0).alias(f"__in{i}")
          for i, c in enumerate(columns)],
    )
    keys = [f"__{i}" for i in range(len(columns))]
    every = 2 ** len(columns) - 1
    sets = {i: every - 2 ** (len(columns) - 1 - i) for i in range(len(columns))}  # grouping_id of each set
    which = F.coalesce(*[F.when(F.col("__set") == n, i) for i, n in sets.items()])
    counted = shown.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("__set"), *[F.count_if(f"__in{i}").alias(f"__n{i}") for i in range(len(columns))]
    )
    pick = lambda cells: F.element_at(F.array(*cells), which + 1)
    return counted.select(
        pick([F.lit(c) for c in columns]).alias("facet"),
        pick([F.col(k).cast("string") for k in keys]).alias("value"),
        pick([F.col(f"__n{i}") for i in range(len(columns))]).alias("n"),
    ).filter("n > 0")


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
