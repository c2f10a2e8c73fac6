"""Row views: prompts, filters, reshaping, joins and paging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsers import extract_spans
from ..functions.text import pystrip
from ..plans.scale import attach, running_totals

INPUT, REFERENCE, OUTPUT = "{{input}}", "{{reference}}", "{{output}}"
CRITERION, SCALE = "{{criterion}}", "{{scale}}"


# --- prompts ---------------------------------------------------------------


def render_prompt(df: DataFrame, template: str, name: str = "prompt") -> DataFrame:
    """Add the prompt: every ``{{input}}`` replaced by the row's input."""
    return df.withColumn(name, F.replace(F.lit(template), F.lit(INPUT), F.col("input")))


def render_judge_prompt(
    df: DataFrame, template: str, criterion: str, scale: int = 5, name: str = "judge_prompt"
) -> DataFrame:
    """Add the judge prompt.

    Placeholders are filled in the order reference, output, criterion, scale,
    each over the text so far, so those inside a reference are filled too.
    """
    steps = (
        (REFERENCE, F.col("reference")),
        (OUTPUT, pystrip("output")),
        (CRITERION, F.lit(criterion)),
        (SCALE, F.lit(str(scale))),
    )
    text: Column = F.lit(template)
    for mark, value in steps:
        text = F.replace(text, F.lit(mark), value)
    return df.withColumn(name, text)


def has_placeholder(template: Column | str) -> Column:
    """True when a prompt template contains ``{{input}}``."""
    c = F.col(template) if isinstance(template, str) else template
    return F.coalesce(F.contains(c, F.lit(INPUT)), F.lit(False))


# --- filters ---------------------------------------------------------------


class Condition(NamedTuple):
    """``metric op value``, on one run's column when ``run`` is given."""

    metric: str
    op: str
    value: float
    run: str | None = None


_COMPARE = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
}


def metric_column(run: str, metric: str) -> str:
    """Name of a metric column in a comparison view."""
    return f"{run}:{metric}"


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def filter_by_metrics(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Rows that satisfy every condition.

    Without a run the metric is read from the ``metrics`` map, with one from
    the comparison column. Rows whose metric is missing or NaN never match,
    also not for "!=".
    """

    def test(c: Condition) -> Column:
        value = (
            F.get(F.map_values(F.map_filter("metrics", lambda k, v: k == c.metric)), F.lit(0))
            if c.run is None
            else _quoted(metric_column(c.run, c.metric))
        )
        return value.isNotNull() & ~F.isnan(value) & _COMPARE[c.op](value, c.value)

    return df.filter(reduce(and_, map(test, conditions), F.lit(True)))


def search(df: DataFrame, text: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows where any shown column contains the text, ignoring case."""
    if not text:
        return df
    needle = F.lower(F.lit(text))
    hits = [
        F.coalesce(F.lower(_quoted(c).cast("string")).contains(needle), F.lit(False))
        for c in (cols or df.columns)
    ]
    return df.filter(reduce(or_, hits))


def facet_filter(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(*values))


def visible_to(df: DataFrame, user: str) -> DataFrame:
    """Rows the user owns or that are public, with ``user_owned``."""
    owned = F.coalesce(F.col("user_id") == user, F.lit(False))
    return df.filter(owned | F.coalesce(F.col("is_public"), F.lit(False))).withColumn(
        "user_owned", owned
    )


def browse(df: DataFrame, task: str = "All", text: str = "") -> DataFrame:
    """Catalogue rows of a task whose name contains the text.

    ``df`` comes from ``visible_to``; adds ``section``: "owned" or "public".
    """
    if task != "All":
        df = df.filter(F.col("task") == task)
    if text:
        df = df.filter(F.lower("name").contains(F.lower(F.lit(text))))
    return df.withColumn("section", F.when(F.col("user_owned"), "owned").otherwise("public"))


def completed_runs(runs: DataFrame, project: str) -> DataFrame:
    """Runs of a project that are done, newest first."""
    return runs.filter((F.col("project_id") == project) & (F.col("status") == "done")).orderBy(
        F.desc_nulls_last("created_at"), "inference_id"
    )


# --- reshaping -------------------------------------------------------------


def unnest_evaluation(df: DataFrame) -> DataFrame:
    """Wrapper rows to one row per example, other columns except the map kept."""
    keep = [c for c in df.columns if c not in {"rows", "aggregate", "chunk"}]
    return df.select(*keep, F.inline("rows"))


def nest_evaluation(
    rows: DataFrame, aggregates: DataFrame, chunk_rows: int
) -> DataFrame:
    """Rows to wrapper rows ``evaluation_id, chunk, rows, aggregate``.

    The stored form keeps a whole evaluation in one cell. An evaluation of
    unknown size cannot be one cell here, so its rows are dealt by id hash
    into chunks of about the ``chunk_rows`` that the caller chooses, and
    (evaluation_id, chunk) is the key at any size. The aggregate stands in one
    row of an evaluation, its first chunk. Evaluations without rows have an
    empty list, those without an aggregate an empty map.
    """
    per_evaluation = rows.groupBy("evaluation_id").agg(
        F.ceil(F.count(F.lit(1)) / chunk_rows).alias("__chunks")
    )
    fields = [c for c in rows.columns if c != "evaluation_id"]
    maps = aggregates.groupBy("evaluation_id").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("aggregate")
    )
    chunk = F.pmod(F.xxhash64("id"), F.col("__chunks"))
    chunks = (
        attach(rows, per_evaluation, ["evaluation_id"], ["id"])
        .groupBy("evaluation_id", chunk.alias("chunk"))
        .agg(F.collect_list(F.struct(*fields)).alias("rows"))
    )
    kinds = {f.name: f.dataType for f in chunks.schema.fields}
    first = chunks.groupBy("evaluation_id").agg(F.min("chunk").alias("chunk"))
    # Chunks may be empty, so an evaluation's first need not be number 0.
    placed = maps.join(first, "evaluation_id", "left").withColumn(
        "chunk", F.coalesce("chunk", F.lit(0).cast("long"))
    )
    joined = chunks.join(placed, ["evaluation_id", "chunk"], "full")
    empty = F.create_map().cast(maps.schema["aggregate"].dataType)
    return joined.select(
        "evaluation_id", "chunk",
        F.coalesce("rows", F.array().cast(kinds["rows"])).alias("rows"),
        F.coalesce("aggregate", empty).alias("aggregate"),
    )


def spans_table(df: DataFrame, column: str = "output", keep: Sequence[str] = ("id",)) -> DataFrame:
    """Markup text to one row per entity span: ``keep…, s, e, label``.

    The outer form of inline is used because the plain one adds a filter that
    parses every text a second time.
    """
    return df.select(*keep, F.inline_outer(extract_spans(column))).filter(
        F.col("label").isNotNull()
    )


def metrics_to_long(df: DataFrame, keys: Sequence[str] = ("inference_id", "id")) -> DataFrame:
    """``metrics`` map to one row per metric: ``keys…, metric, value``."""
    return df.select(*keys, F.explode("metrics").alias("metric", "value"))


def metrics_to_map(df: DataFrame, keys: Sequence[str] = ("inference_id", "id")) -> DataFrame:
    """Long scores to one ``metrics`` map per row, null values left out."""
    entry = F.when(F.col("value").isNotNull(), F.struct("metric", "value"))
    return df.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metrics")
    )


def select_compare_columns(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Base columns, outputs, parsed values and the chosen metrics."""
    chosen = set(metrics)

    def keep(name: str) -> bool:
        return ":" not in name or name.rsplit(":", 1)[1] in chosen

    return df.select(*[_quoted(c).alias(c) for c in df.columns if keep(c)])


def number_labels(runs: DataFrame, label: str = "label", order: str = "seq") -> DataFrame:
    """Equal labels get " (1)", " (2)" … in order; single labels stay."""
    counts = runs.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    numbered = running_totals(runs, [label], [order], {"__one": F.lit(1)})
    shown = F.when(
        F.col("__n") > 1,
        F.concat(F.col(label), F.lit(" ("), (F.col("__one_before") + 1).cast("string"),
                 F.lit(")")),
    ).otherwise(F.col(label))
    return attach(numbered, counts, [label], [order]).withColumn("shown_label", shown).drop(
        "__n", "__one_before"
    )


# --- joins -----------------------------------------------------------------


def join_outputs(dataset: DataFrame, outputs: DataFrame) -> DataFrame:
    """Dataset rows with their outputs; ids without an output drop out."""
    return dataset.join(outputs, "id", "inner")


def evaluation_view(dataset: DataFrame, outputs: DataFrame, scores: DataFrame) -> DataFrame:
    """Dataset, output and score of one run; both joins hash on the id."""
    return dataset.join(outputs, "id").join(scores, "id")


def with_notes(df: DataFrame, notes: DataFrame) -> DataFrame:
    """Add ``note``: the row's note or an empty text."""
    named = notes.select("inference_id", F.col("row_id").alias("id"),
                         F.col("content").alias("note"))
    return df.join(named, ["inference_id", "id"], "left").withColumn(
        "note", F.coalesce("note", F.lit(""))
    )


def with_human_scores(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Add ``human_score``: the row's rating or null."""
    named = scores.select("evaluation_id", F.col("row_id").alias("id"),
                          F.col("score").alias("human_score"))
    return df.join(named, ["evaluation_id", "id"], "left")


def check_alignment(dataset: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per run, whether its output ids are exactly the dataset ids.

    ``inference_id, dataset_rows, output_rows, missing, unknown,
    duplicate_outputs, duplicate_ids, aligned``. Both sides are counted per id
    before they meet, so repeated ids arrive as one row.
    """
    ids = dataset.groupBy("id").agg(F.count(F.lit(1)).alias("__copies"))
    per_id = outputs.groupBy("inference_id", "id").agg(F.count(F.lit(1)).alias("__n"))
    known = F.col("__copies").isNotNull()
    per_run = (
        per_id.join(ids, "id", "left")
        .groupBy("inference_id")
        .agg(
            F.sum("__n").alias("output_rows"),
            F.count_if(known).alias("__matched"),
            F.sum(F.when(known, 0).otherwise(F.col("__n"))).alias("unknown"),
            F.sum(F.col("__n") - 1).alias("duplicate_outputs"),
        )
    )
    total = ids.agg(
        F.struct(
            F.coalesce(F.sum("__copies"), F.lit(0)).alias("dataset_rows"),
            F.count(F.lit(1)).alias("ids"),
        )
    ).scalar()
    report = per_run.withColumn("__total", total).select(
        "inference_id",
        F.col("__total.dataset_rows").alias("dataset_rows"),
        "output_rows",
        (F.col("__total.ids") - F.col("__matched")).alias("missing"),
        "unknown",
        "duplicate_outputs",
        (F.col("__total.dataset_rows") - F.col("__total.ids")).alias("duplicate_ids"),
    )
    problems = ("missing", "unknown", "duplicate_outputs", "duplicate_ids")
    return report.withColumn("aligned", sum(F.col(c) for c in problems) == 0)


def require_alignment(dataset: DataFrame, outputs: DataFrame) -> DataFrame:
    """The outputs, if every run is aligned; otherwise an error."""
    require_aligned(check_alignment(dataset, outputs))
    return outputs


def require_aligned(report: DataFrame) -> None:
    """An error if a run of the report of ``check_alignment`` is not aligned."""
    bad = report.filter(~F.col("aligned")).limit(5).collect()
    if bad:
        raise ValueError("outputs do not match the dataset: " + "; ".join(map(str, bad)))


def compare_outputs(dataset: DataFrame, outputs: DataFrame, runs: Sequence[str]) -> DataFrame:
    """One row per id with ``<run>Output`` columns; ids a run misses drop out.

    One grouped pass over all runs instead of a join per run.
    """
    run = F.col("inference_id")
    names = list(dict.fromkeys(runs))
    wide = (
        outputs.filter(run.isin(*names))
        .groupBy("id")
        .agg(
            *[F.count_if(run == r).alias(f"__n{i}") for i, r in enumerate(names)],
            *[F.max(F.when(run == r, F.col("output"))).alias(f"{r}Output") for r in names],
        )
        .filter(reduce(and_, [F.col(f"__n{i}") > 0 for i in range(len(names))]))
        .drop(*[f"__n{i}" for i in range(len(names))])
    )
    return dataset.join(wide, "id")


def compare_view(
    dataset: DataFrame,
    outputs: DataFrame,
    scores_long: DataFrame,
    runs: Sequence[str],
    metrics: Sequence[str],
    parsed: DataFrame | None = None,
) -> DataFrame:
    """Comparison rows: outputs, ``<run>Parsed`` and ``<run>:<metric>`` columns.

    Columns are keyed by run, so two runs of one model stay apart. Rows a run
    has no score for keep nulls.
    """
    wide = (
        scores_long.filter(F.col("inference_id").isin(*runs) & F.col("metric").isin(*metrics))
        .groupBy("id")
        .agg(
            *[
                F.max(
                    F.when(
                        (F.col("inference_id") == r) & (F.col("metric") == m), F.col("value")
                    )
                ).alias(metric_column(r, m))
                for r in runs
                for m in metrics
            ]
        )
    )
    view = compare_outputs(dataset, outputs, runs)
    if parsed is not None:
        labels = (
            parsed.filter(F.col("inference_id").isin(*runs))
            .groupBy("id")
            .agg(
                *[
                    F.max(F.when(F.col("inference_id") == r, F.col("parsed"))).alias(
                        f"{r}Parsed"
                    )
                    for r in runs
                ]
            )
        )
        view = view.join(labels, "id", "left")
    return view.join(wide, "id", "left")


def pending_rows(dataset: DataFrame, outputs: DataFrame) -> DataFrame:
    """Dataset rows that have no output yet; gaps in the middle are found too."""
    return dataset.join(outputs.select("id"), "id", "left_anti")


def unknown_ids(
    changes: DataFrame, scores: DataFrame, keys: Sequence[str] = ("evaluation_id", "row_id")
) -> DataFrame:
    """Changes whose row is not part of the evaluation."""
    known = scores.select(F.col("evaluation_id"), F.col("id").alias("row_id"))
    return changes.join(known, list(keys), "left_anti")


def keep_existing(df: DataFrame, ref: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(ref.select(*keys), list(keys), "left_semi")


def purge(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table without the children of the deleted keys."""
    return table.join(gone.select(*keys), list(keys), "left_anti")


# --- order and pages -------------------------------------------------------


def view_order(column: str, ascending: bool = True, tie: str = "id") -> list[Column]:
    c = _quoted(column)
    keys = [c.asc_nulls_last() if ascending else c.desc_nulls_last()]
    return keys + ([] if column == tie else [F.col(tie).asc()])


def sort_view(df: DataFrame, column: str, ascending: bool = True, tie: str = "id") -> DataFrame:
    return df.orderBy(*view_order(column, ascending, tie))


def page(df: DataFrame, number: int = 0, size: int = 50) -> DataFrame:
    """Page ``number`` (from 0) of an ordered view.

    Spark turns this into a top-k per task, not a full sort.
    """
    return df.offset(number * size).limit(size)


def page_after(
    df: DataFrame, column: str, last: tuple | None = None, size: int = 50,
    ascending: bool = True, tie: str = "id",
) -> DataFrame:
    """The page after the row ``last`` = (value, tie) of ``sort_view``'s order.

    The next page starts from where the last one ended, so page n costs what
    page 0 does; ``page`` carries all earlier rows along. Values are in order,
    nulls last.
    """
    ordered = sort_view(df, column, ascending, tie)
    if last is None:
        return ordered.limit(size)
    value, at = last
    c, later = _quoted(column), F.col(tie) > F.lit(at)
    if value is None:
        return ordered.filter(c.isNull() & later).limit(size)
    beyond = c > F.lit(value) if ascending else c < F.lit(value)
    return ordered.filter(c.isNull() | beyond | ((c == F.lit(value)) & later)).limit(size)


def favourites_first(runs: DataFrame, order: str = "seq") -> DataFrame:
    return runs.orderBy(F.coalesce(F.col("is_favorite"), F.lit(False)).desc(), order)


def order_metrics(metrics: DataFrame, order: str = "seq") -> DataFrame:
    """Plain metrics first, then judge metrics, then human evaluation."""
    group = (
        F.when(F.col("metric_id") == "human_evaluation", 2)
        .when(F.col("metric_id").startswith("llm_judge_"), 1)
        .otherwise(0)
    )
    return metrics.orderBy(group, order)


def assert_same_dataset(runs: DataFrame) -> DataFrame:
    """The runs, if they all belong to one dataset; otherwise the job fails."""
    datasets = runs.agg(F.count_distinct("dataset_id")).scalar()
    mixed = F.raise_error(F.lit("compared runs must share one dataset"))
    return runs.withColumn(
        "dataset_id",
        F.when(datasets <= 1, F.col("dataset_id")).otherwise(mixed.cast(
            runs.schema["dataset_id"].dataType
        )),
    )
