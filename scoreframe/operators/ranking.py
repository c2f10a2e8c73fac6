"""Leaderboards: best values, placements, average ranks, overall positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.metricmaps import finite, metric_value
from ..plans.scale import BROADCAST_ROWS, cut, fits, running_totals

# The metric a task is ranked by. Relation Extraction has none.
PRIMARY_METRIC = {
    "Named-entity Recognition": "exact_match_f1",
    "Multiple Choice Questions": "accuracy",
    "Multi-label Classification": "macro_f1",
    "Single-label Classification": "macro_f1",
    "Generation": "rougel",
}

# Tiers of the first three places.
TIERS = ("gold", "silver", "bronze")

# Medals of the first three positions.
MEDALS = ("🥇", "🥈", "🥉")


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of a small plan-time table, null for unknown keys."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")


def primary_metric(
    task: Column | str, overrides: Mapping[str, str] | None = None
) -> Column:
    key = F.col(task) if isinstance(task, str) else task
    return lookup(key, {**PRIMARY_METRIC, **(overrides or {})})


def completed(evals: DataFrame) -> DataFrame:
    """Evaluations that are effectively done and have a stored result.

    Reads ``effective_status``: one whose human rating is open is not done.
    """
    return evals.filter((F.col("effective_status") == "done") & F.col("object_key").isNotNull())


def best_primary(evals: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Best finite primary-metric value per run over its completed evaluations.

    ``evals``: ``inference_id, task, effective_status, object_key, aggregate``.
    """
    key = primary_metric("task", overrides)
    valued = completed(evals).select(
        "inference_id",
        key.alias("metric_key"),
        metric_value(F.col("aggregate"), key).alias("value"),
    )
    return (
        valued.filter(F.col("value").isNotNull())
        .groupBy("inference_id", "metric_key")
        .agg(F.max("value").alias("value"))
    )


def latest_completed(evals: DataFrame, keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """Newest completed evaluation per run; a missing time is the oldest.

    Equal times go to the smaller evaluation id. Each map task keeps one row
    per run (window group limit), so a run with many evaluations is cheap.
    """
    newest = Window.partitionBy("inference_id").orderBy(
        F.desc_nulls_last("created_at"), "evaluation_id"
    )
    return (
        completed(evals)
        .select("inference_id", "evaluation_id", *{*keep, "created_at"})
        .withColumn("__k", F.row_number().over(newest))
        .filter(F.col("__k") == 1)
        .select("inference_id", "evaluation_id", *keep)
    )


def effective_status(evals: DataFrame, human: DataFrame) -> DataFrame:
    """Status after human rating: done with unrated rows is still processing.

    ``evals``: ``evaluation_id, status, metrics, total_examples``; ``human`` is
    the output of ``human_aggregate``. Adds ``effective_status, rated_rows,
    total_rows``.
    """
    asked = F.coalesce(F.array_contains("metrics", "human_evaluation"), F.lit(False))
    counted = asked & (F.col("status") == "done")
    rated = F.coalesce(F.col("human_evaluation_count"), F.lit(0))
    known = F.col("total_examples") > 0
    total = F.when(known, F.col("total_examples")).otherwise(rated)
    open_rows = (total > 0) & (rated < total)
    return (
        evals.join(human.select("evaluation_id", "human_evaluation_count"),
                   "evaluation_id", "left")
        .withColumns(
            {
                "effective_status": F.when(counted & open_rows, "processing").otherwise(
                    F.col("status")
                ),
                "rated_rows": F.when(counted, rated).otherwise(F.lit(0)),
                "total_rows": F.when(counted, total).otherwise(
                    F.coalesce(F.col("total_examples"), F.lit(0))
                ),
            }
        )
        .drop("human_evaluation_count")
    )


def run_summary(evals: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Per run: evaluation count, any running, latest completed, best primary.

    ``evals`` holds ``inference_id, evaluation_id, task, status,
    effective_status, object_key, created_at, aggregate``. Both flags read the
    effective status. Everything is one aggregation, combined map-side.
    """
    status = F.col("effective_status")
    done = (status == "done") & F.col("object_key").isNotNull()
    # Newest first, a missing time last, then the smaller id.
    age = -F.unix_micros(F.col("created_at").try_cast("timestamp"))
    oldest = F.lit(2**63 - 1)
    key = primary_metric("task", overrides)
    value = F.when(done, metric_value(F.col("aggregate"), key))
    return (
        evals.select(
            "inference_id",
            status.alias("__status"),
            F.when(
                done, F.struct(F.coalesce(age, oldest).alias("age"), F.col("evaluation_id"))
            ).alias("__done"),
            key.alias("__key"),
            value.alias("__value"),
        )
        .groupBy("inference_id")
        .agg(
            F.count(F.lit(1)).alias("evaluations"),
            F.bool_or(F.col("__status").isin("pending", "processing")).alias("has_running"),
            F.min("__done")["evaluation_id"].alias("latest_evaluation_id"),
            F.max(F.when(F.col("__value").isNotNull(), F.col("__key"))).alias("metric_key"),
            F.max("__value").alias("best_value"),
        )
    )


def dataset_placements(best: DataFrame) -> DataFrame:
    """Gold, silver and bronze run of each dataset; ties go by run id.

    ``best``: ``inference_id, dataset, value``. Spark prunes to three rows per
    dataset inside each map task (window group limit) before the shuffle.
    """
    order = Window.partitionBy("dataset").orderBy(F.desc("value"), F.asc("inference_id"))
    place = F.col("place")
    tier = F.element_at(F.array(*map(F.lit, TIERS)), place)
    return (
        best.filter(finite("value"))
        .withColumn("place", F.row_number().over(order))
        .filter(place <= len(TIERS))
        .withColumn("tier", tier)
    )


def model_dataset_scores(best: DataFrame) -> DataFrame:
    """Best value of each model on each dataset: ``model_key, dataset, value``."""
    return best.groupBy("model_key", "dataset").agg(F.max("value").alias("value"))


def comparable_models(scores: DataFrame) -> DataFrame:
    """Scores of the models that have one on every dataset (division)."""
    universe = scores.agg(F.count_distinct("dataset")).scalar()
    complete = (
        scores.groupBy("model_key")
        .agg(F.count_distinct("dataset").alias("__n"))
        .filter(F.col("__n") == universe)
        .select("model_key")
    )
    return scores.join(complete, "model_key", "left_semi")


def average_rank(
    df: DataFrame, part: Sequence[str], value: str, name: str = "rank", descending: bool = True
) -> DataFrame:
    """Rank within ``part``; tied values share the mean of their positions.

    Ranks are found on distinct values with their counts and joined back, so
    one large part is ranked by many tasks.
    """
    key = -F.col(value) if descending else F.col(value)
    counts = df.groupBy(*part, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = running_totals(
        counts.withColumn("__key", key), part, ["__key"], {"__n": F.col("__n")}
    ).select(
        *part, value, (F.col("__n_before") + (F.col("__n") + 1) / 2.0).alias(name)
    )
    return df.join(placed, [*part, value])


def overall_ranking(scores: DataFrame, small_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Overall positions of comparable models by mean rank over all datasets.

    ``scores``: ``model_key, dataset, value``. Equal mean ranks share a
    position and the next one skips. Empty with fewer than two models. Means
    are compared as doubled integer rank sums, which keeps ties exact. The
    table, a row per model and dataset, is made once and counted: up to
    ``small_rows`` plain windows rank it, beyond that ``running_totals`` does,
    with the same result.
    """
    known = cut(scores)
    small = fits(known, small_rows)
    if small:
        within = Window.partitionBy("dataset").orderBy(F.desc("value"))
        tied = F.count(F.lit(1)).over(Window.partitionBy("dataset", "value"))
        ranked = comparable_models(known).withColumn(
            "rank", F.rank().over(within) + (tied - 1) / 2.0
        )
    else:
        ranked = average_rank(cut(comparable_models(known)), ["dataset"], "value")
    means = cut(
        ranked.groupBy("model_key").agg(
            F.sum((F.col("rank") * 2).cast("long")).alias("__sum"),
            F.count(F.lit(1)).alias("dataset_count"),
        )
    )
    if small:
        place = F.rank().over(Window.orderBy("__sum")).cast("long")
        positions = means.select("__sum", place.alias("position")).distinct()
    else:
        levels = means.groupBy("__sum").agg(F.count(F.lit(1)).alias("__n"))
        positions = running_totals(levels, [], ["__sum"], {"__n": F.col("__n")}).select(
            "__sum", (F.col("__n_before") + 1).alias("position")
        )
    models = means.agg(F.count(F.lit(1))).scalar()
    return (
        means.join(positions, "__sum")
        .select(
            "model_key",
            "position",
            (F.col("__sum") / 2.0 / F.col("dataset_count")).alias("average_rank"),
            "dataset_count",
            models.alias("model_count"),
        )
        .filter(F.col("model_count") >= 2)
    )


def medal(position: Column | str) -> Column:
    at = F.col(position) if isinstance(position, str) else position
    cases = F.when(at == 1, MEDALS[0])
    for i, mark in enumerate(MEDALS[1:], start=2):
        cases = cases.when(at == i, mark)
    return cases


def ranking_table(ranking: DataFrame) -> DataFrame:
    """One row per model at its best position, ordered for display.

    ``ranking`` may repeat a model, once per run that carries its ranking.
    """
    rest = ["average_rank", "dataset_count", "model_count"]
    return (
        ranking.groupBy("model_key")
        .agg(
            F.min("position").alias("position"),
            *[F.min_by(c, F.struct("position", "average_rank")).alias(c) for c in rest],
        )
        .withColumn("medal", medal("position"))
        .orderBy("position", "average_rank", "model_key")
    )


def shared_datasets(runs: DataFrame) -> DataFrame:
    """Sorted distinct names of the datasets of ranked runs."""
    return runs.filter(F.col("dataset").isNotNull()).select("dataset").distinct().orderBy(
        "dataset"
    )


def select_evaluation(evals: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """The evaluation shown for each run.

    A requested id wins when it is done; without a request the first done one
    (by creation time, then id) is taken. ``problem`` is set when a requested
    evaluation is not done, or when a run has none that is.
    """
    runs = evals.select("inference_id").distinct()
    done = evals.filter(F.col("status") == "done")
    first = done.groupBy("inference_id").agg(
        F.min(F.struct("created_at", "evaluation_id"))["evaluation_id"].alias("__first")
    )
    joined = runs.join(first, "inference_id", "left")
    if requested is None:
        joined = joined.withColumn("__asked", F.lit(None).cast("string")).withColumn(
            "__ok", F.lit(None).cast("string")
        )
    else:
        asked = requested.select("inference_id", F.col("evaluation_id").alias("__asked"))
        ready = done.select("inference_id", F.col("evaluation_id").alias("__asked"),
                            F.col("evaluation_id").alias("__ok"))
        joined = joined.join(asked, "inference_id", "left").join(
            ready, ["inference_id", "__asked"], "left"
        )
    chosen = F.when(F.col("__asked").isNull(), F.col("__first")).otherwise(F.col("__ok"))
    return joined.select(
        "inference_id",
        chosen.alias("evaluation_id"),
        F.when(F.col("__asked").isNotNull() & F.col("__ok").isNull(),
               "requested evaluation is not done")
        .when(chosen.isNull(), "no evaluation is done").alias("problem"),
    )
