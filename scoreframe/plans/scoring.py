"""Whole jobs: score runs, compare them, rank them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.overlap import rouge
from ..functions.parsers import (
    extract_spans, lower_spans, multi_hot, sort_spans, spans_from_json, spans_to_json,
)
from ..functions.registry import ParserSpec, apply_parsers, default_parsers, metric_plan
from ..functions.scores import accuracy, accuracy_spans, accuracy_vector
from ..operators.corpus import (
    aggregate_metrics, exact_match, f1_labels, f1_multilabel, mean_metrics,
)
from ..operators.ranking import best_primary, model_dataset_scores, overall_ranking
from ..operators.textscores import meteor
from ..operators.views import check_alignment, nest_evaluation, require_aligned
from ..sources.storage import load_outputs, write_scores
from .scale import cut, scratch_path


class ScoringPlan(NamedTuple):
    """What to compute for the runs of one task.

    ``raw_corpus`` scores multi-label corpus F1 on unparsed outputs.
    """

    task: str
    metrics: tuple[str, ...]
    parsers: tuple[ParserSpec, ...] = ()
    classes: tuple[str, ...] = ()
    raw_corpus: bool = False
    on_error: str = "null"


class Evaluation(NamedTuple):
    rows: DataFrame
    aggregates: DataFrame
    alignment: DataFrame | None = None


RUN = ("inference_id",)


def parse_predictions(outputs: DataFrame, plan: ScoringPlan) -> DataFrame:
    """Add ``parsed`` and the structured prediction, in one projection."""
    chain = list(plan.parsers) or default_parsers(plan.task, plan.classes)
    parsed = apply_parsers("output", chain)
    if plan.task == "ner":
        spans = sort_spans(extract_spans(parsed))
        return outputs.withColumn("parsed_spans", spans).withColumn(
            "parsed", spans_to_json("parsed_spans")
        )
    out = outputs.withColumn("parsed", parsed)
    if plan.task == "mlc":
        vectors = {"parsed_vector": "parsed"}
        if plan.raw_corpus:
            vectors["raw_vector"] = "output"
        out = out.withColumns({v: multi_hot(c, plan.classes) for v, c in vectors.items()})
    return out


def parse_references(dataset: DataFrame, plan: ScoringPlan) -> DataFrame:
    """Add the structured reference that the task compares with."""
    if plan.task == "ner":
        return dataset.withColumn("reference_spans", lower_spans(spans_from_json("reference")))
    if plan.task == "mlc":
        return dataset.withColumn("reference_vector", multi_hot("reference", plan.classes))
    return dataset


def parse_outputs(df: DataFrame, plan: ScoringPlan) -> DataFrame:
    """Both sides of joined rows ``inference_id, id, output, reference``."""
    return parse_references(parse_predictions(df, plan), plan)


def _row_accuracy(plan: ScoringPlan) -> Column:
    if plan.task == "ner":
        return accuracy_spans("parsed_spans", "reference_spans")
    if plan.task == "mlc":
        return accuracy_vector("parsed_vector", "reference_vector")
    return accuracy("parsed", "reference")


def score_rows(
    df: DataFrame, plan: ScoringPlan, synonyms: DataFrame | None = None
) -> DataFrame:
    """Parse joined rows and add ``metrics`` (see ``score_parsed``)."""
    return score_parsed(parse_outputs(df, plan), plan, synonyms)


def score_parsed(
    parsed: DataFrame, plan: ScoringPlan, synonyms: DataFrame | None = None
) -> DataFrame:
    """Add ``metrics map<string,double>`` with every row metric of the plan."""
    metrics = metric_plan(plan.metrics)
    values: dict[str, Column] = {}
    if "accuracy" in metrics:
        values["accuracy"] = _row_accuracy(plan)
    wanted = tuple(m for m in ("rouge1", "rouge2", "rougeL") if m in metrics)
    if wanted:
        # One struct column: tokens are made once for all variants.
        parsed = parsed.withColumn(
            "__rouge", rouge("parsed", "reference", wanted, plan.on_error)
        )
        values |= {m: F.col(f"__rouge.{m}") for m in wanted}
    if "meteor" in metrics:
        parsed = meteor(parsed, "parsed", "reference", synonyms, name="__meteor")
        missing = F.lit(0.0 if plan.on_error == "zero" else None).cast("double")
        values["meteor"] = F.coalesce("__meteor", missing)
    for name, metric in metrics.items():
        if metric.row is not None:
            values[name] = metric.row(F.col("parsed"), F.col("reference"))
    entries = [x for name, value in values.items() for x in (F.lit(name), value)]
    built = F.create_map(*entries) if entries else F.create_map()
    return parsed.withColumn("metrics", built.cast("map<string,double>")).drop(
        "__rouge", "__meteor"
    )


def corpus_scores(
    scored: DataFrame,
    plan: ScoringPlan,
    by: Sequence[str] = RUN,
    external: DataFrame | None = None,
) -> DataFrame:
    """Corpus metrics and means of row metrics: ``by…, metric, value``.

    ``external`` holds row scores made elsewhere (judge, encoder metrics) as
    ``by…, id, metric, value``.
    """
    metrics = metric_plan(plan.metrics)

    def melt(wide: DataFrame, names: Sequence[str]) -> DataFrame:
        cells = F.array(
            *[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]
        )
        return wide.select(*by, F.inline(cells))

    parts: list[DataFrame] = []
    f1 = [m for m in ("macro_f1", "weighted_f1") if m in metrics]
    if f1:
        wide = (
            f1_multilabel(scored, "both", by, "raw_vector" if plan.raw_corpus else "parsed_vector")
            if plan.task == "mlc"
            else f1_labels(scored, "both", by)
        )
        parts.append(melt(wide, f1))
    em = [m for m in metrics if m.startswith("exact_match_")]
    if em:
        parts.append(melt(exact_match(scored, by), em))
    for name, metric in metrics.items():
        if metric.corpus is not None:
            parts.append(
                metric.corpus(scored, by).select(*by, F.lit(name).alias("metric"), "value")
            )
    rowwise = [m for m, k in metrics.items() if k.kind in ("row", "text") or k.row is not None]
    if rowwise:
        parts.append(mean_metrics(scored, by, rowwise).select(*by, "metric", "value"))
    if external is not None:
        asked = [m for m, kind in metrics.items() if kind.kind == "external"]
        parts.append(
            aggregate_metrics(external.filter(F.col("metric").isin(*asked)), by).select(
                *by, "metric", "value"
            )
        )
    if not parts:
        raise ValueError("the plan has no metric that can be aggregated")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evaluate(
    dataset: DataFrame,
    outputs: DataFrame,
    plan: ScoringPlan,
    path: str | None = None,
    synonyms: DataFrame | None = None,
    external: DataFrame | None = None,
    on_misaligned: str = "raise",
    resume: bool = False,
) -> Evaluation:
    """Score all runs in ``outputs`` against the dataset.

    The output ids of every run must be exactly the dataset's ids. By default a
    run that misses ids, repeats them or names unknown ones is an error before
    anything is scored. ``on_misaligned="report"`` scores every run over the
    whole dataset instead: a missing output is an empty answer, of repeated
    outputs or dataset rows the smallest counts, unknown ids are not scored.
    The report itself is ``alignment`` of the result.

    Each side is parsed before the join: a reference once instead of once per
    run, and what is shuffled of an output is its parsed form, not its text.
    Outputs are parsed and scored once. The scored rows are written (to
    ``path`` or to the shared folder, one folder per run) and every corpus
    metric reads its columns of that table, so no parser or text metric runs
    twice. ``path`` must not exist yet, unless ``resume`` is set: then the
    rows that it has already are kept, and only the others are scored. The plan
    is stored with the rows before the first of them; going on with another
    plan, or with rows that name none, is an error.
    """
    if on_misaligned not in ("raise", "report"):
        raise ValueError(f"unknown choice {on_misaligned!r} for misaligned outputs")
    alignment = cut(check_alignment(dataset, outputs))
    if on_misaligned == "raise":
        require_aligned(alignment)
    else:
        dataset, outputs = complete(dataset, outputs)
    wanted = parse_references(dataset.select("id", "reference"), plan)
    target = path or scratch_path(dataset.sparkSession, "scores")
    _keep_plan(dataset.sparkSession, target, plan, synonyms is not None, resume)
    asked = outputs.select("inference_id", "id", "output")
    if resume:
        asked = _unscored(asked, target)
    answers = parse_predictions(asked, plan)
    rows = score_parsed(answers.drop("output").join(wanted, "id"), plan, synonyms)
    write_scores(rows, target)
    stored = load_outputs(rows.sparkSession, target, rows.schema)
    return Evaluation(stored, corpus_scores(stored, plan, external=external), alignment)


def _keep_plan(spark: SparkSession, path: str, plan: ScoringPlan, synonyms: bool, resume: bool) -> None:
    """Store the plan beside the rows to come, or compare it with the stored one."""
    parsers = [[spec.id, dict(spec.args)] for spec in plan.parsers]
    text = json.dumps({**plan._asdict(), "parsers": parsers, "synonyms": synonyms}, sort_keys=True, default=str)
    root = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folder = f"{path.rstrip('/')}/_plan"
    if files.exists(root) and not resume:
        raise ValueError(f"{path} exists already; resume=True goes on with it")
    if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")):
        stored = spark.read.text(folder).first()[0]
        if stored != text:
            raise ValueError(f"{path} holds rows of another plan: {stored}")
    elif files.exists(root) and any(
        not s.getPath().getName().startswith(("_", ".")) for s in files.listStatus(root)
    ):
        raise ValueError(f"{path} holds rows, but no plan that they were scored by")
    else:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def _unscored(outputs: DataFrame, path: str) -> DataFrame:
    """Outputs that the table under ``path``, which need not exist, does not have."""
    keys = "inference_id string, id string"
    spark = outputs.sparkSession
    spark.createDataFrame([], keys).write.mode("append").parquet(path)
    return outputs.join(spark.read.schema(keys).parquet(path), ["inference_id", "id"], "left_anti")


def stored_form(done: Evaluation, chunk_rows: int) -> DataFrame:
    """Scored runs as stored evaluations: ``evaluation_id, chunk, rows, aggregate``.

    Rows hold ``id, parsed, metrics`` and, for multi-label tasks,
    ``parsedVector, referenceVector``; see ``nest_evaluation``.
    """
    names = {"parsed_vector": "parsedVector", "reference_vector": "referenceVector"}
    kept = [F.col(c).alias(names[c]) for c in names if c in done.rows.columns]
    run = F.col("inference_id").alias("evaluation_id")
    rows = done.rows.select(run, "id", "parsed", "metrics", *kept)
    return nest_evaluation(rows, done.aggregates.select(run, "metric", "value"), chunk_rows)


def complete(dataset: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per id, and for every run one output per id of the dataset.

    The names of the runs are one small list; ids meet outputs in an equi-join.
    """
    rows = dataset.groupBy("id").agg(F.min("reference").alias("reference"))
    first = outputs.groupBy("inference_id", "id").agg(F.min("output").alias("output"))
    runs = outputs.agg(F.collect_set("inference_id")).scalar()
    wanted = dataset.select("id").distinct().withColumn("inference_id", F.explode(runs))
    filled = wanted.join(first, ["inference_id", "id"], "left").withColumn(
        "output", F.coalesce("output", F.lit(""))
    )
    return rows, filled


def leaderboard(evals: DataFrame, runs: DataFrame) -> DataFrame:
    """Overall model ranking of a project.

    ``evals`` as for ``best_primary``, with the effective status; ``runs``: ``inference_id, dataset,
    provider_id, model``.
    """
    key = F.concat_ws("::", "provider_id", "model").alias("model_key")
    best = best_primary(evals).join(
        runs.select("inference_id", "dataset", key), "inference_id"
    )
    return overall_ranking(model_dataset_scores(best))
