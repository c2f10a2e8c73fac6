"""Run metadata: registry tables, star joins, grouped options, parameters.

These tables describe runs, not rows. They are joined without hints: Spark
broadcasts them when their size, known at run time, allows it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.scale import running_totals

# Task ids and names.
TASKS = {
    "mcq": "Multiple Choice Questions",
    "ner": "Named-entity Recognition",
    "re": "Relation Extraction",
    "mlc": "Multi-label Classification",
    "generation": "Generation",
}

# Metric ids, names and the tasks they apply to.
METRICS = (
    ("accuracy", "Accuracy", ("mcq",)),
    ("macro_f1", "Macro F1-score", ("mcq", "mlc", "re")),
    ("weighted_f1", "Weighted F1-score", ("mcq", "mlc", "re")),
    ("exact_match_precision", "Exact-match Precision", ("ner",)),
    ("exact_match_recall", "Exact-match Recall", ("ner",)),
    ("exact_match_f1", "Exact-match F1-score", ("ner",)),
    ("rouge1", "ROUGE-1", ("generation",)),
    ("rouge2", "ROUGE-2", ("generation",)),
    ("rougeL", "ROUGE-L", ("generation",)),
    ("bertscore", "BERTScore", ("generation",)),
    ("bartscore", "BARTScore", ("generation",)),
    ("meteor", "METEOR", ("generation",)),
    ("llm_judge_correctness", "LLM Judge: Correctness", tuple(TASKS)),
    ("llm_judge_completeness", "LLM Judge: Completeness", tuple(TASKS)),
    ("llm_judge_relevance", "LLM Judge: Relevance", tuple(TASKS)),
    ("human_evaluation", "Human Evaluation", tuple(TASKS)),
)

# Fixed values: (provider, parameter, type, min, max, default).
PARAMETERS = (
    ("huggingface", "max_new_tokens", "number", 1.0, None, "4096"),
    ("huggingface", "do_sample", "boolean", None, None, "false"),
    ("huggingface", "temperature", "number", 0.0, 1.0, "0.7"),
    ("huggingface", "top_k", "number", 0.0, None, "50"),
    ("huggingface", "top_p", "number", 0.0, 1.0, "1.0"),
    ("huggingface", "num_beams", "number", 1.0, None, "1"),
    ("huggingface", "repetition_penalty", "number", 0.0, None, "1.0"),
    ("azure", "max_tokens", "number", 1.0, None, "4096"),
    ("azure", "temperature", "number", 0.0, 1.0, "0"),
    ("azure", "top_p", "number", 0.0, 1.0, "1.0"),
    ("azure", "frequency_penalty", "number", 0.0, 2.0, "0"),
    ("azure", "presence_penalty", "number", 0.0, 2.0, "0"),
    ("azure", "reasoning_effort", "effort", None, None, "medium"),
    ("anthropic", "max_tokens", "number", 1.0, None, "4096"),
    ("anthropic", "temperature", "number", 0.0, 1.0, "0"),
    ("google", "max_tokens", "number", 1.0, None, "4096"),
    ("google", "temperature", "number", 0.0, 1.0, "0.7"),
    ("google", "top_p", "number", 0.0, 1.0, "0.95"),
)

# Sampling parameters, unused when do_sample is false.
SAMPLING = ("temperature", "top_k", "top_p")

# Efforts by reasoning model; other models use the last list.
EFFORTS = {
    "gpt-5": ("minimal", "low", "medium", "high"),
    "o1": ("low", "medium", "high"),
    "o3": ("low", "medium", "high"),
    "o3-mini": ("low", "medium", "high"),
    "o4-mini": ("low", "medium", "high"),
}
DEFAULT_EFFORTS = ("none", "low", "medium", "high", "xhigh")


def metric_table(spark: SparkSession) -> DataFrame:
    """Built-in metrics: ``metric_id, name, tasks, seq``."""
    rows = [(m, n, list(t), i) for i, (m, n, t) in enumerate(METRICS)]
    return spark.createDataFrame(
        rows, "metric_id string, name string, tasks array<string>, seq int"
    )


def task_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TASKS.items()), "task_id string, name string")


def parameter_table(spark: SparkSession) -> DataFrame:
    """Allowed parameters per provider with type, range and default."""
    return spark.createDataFrame(
        list(PARAMETERS),
        "provider_id string, parameter string, type string, low double, high double, "
        "default_value string",
    )


def metric_tasks(metrics: DataFrame) -> DataFrame:
    """One row per (metric, task): ``metric_id, name, task_id``."""
    return metrics.select("metric_id", "name", F.explode("tasks").alias("task_id"))


def provider_models(providers: DataFrame) -> DataFrame:
    """One row per model: ``provider_id, model``."""
    return providers.select("provider_id", F.explode("models").alias("model"))


def build_registry(metrics: DataFrame, providers: DataFrame) -> dict[str, DataFrame]:
    return {"metric": metric_tasks(metrics), "model": provider_models(providers)}


def run_details(
    evaluations: DataFrame,
    inferences: DataFrame,
    datasets: DataFrame,
    providers: DataFrame,
    tasks: DataFrame,
) -> DataFrame:
    """Evaluation with its run, dataset, provider and task."""
    return (
        evaluations.join(inferences, "inference_id")
        .join(datasets, "dataset_id")
        .join(providers, "provider_id")
        .join(tasks, "task_id")
    )


def job_details(
    evaluations: DataFrame, inferences: DataFrame, datasets: DataFrame
) -> DataFrame:
    """What scoring a run needs; a missing dataset leaves nulls."""
    return evaluations.join(inferences, "inference_id").join(datasets, "dataset_id", "left")


def lookup_parsers(functions: DataFrame, ids: Sequence[str]) -> DataFrame:
    return functions.filter(F.col("function_id").isin(*ids))


def listed(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    size: int,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Values of each group as ordered lists: ``by…, part, <value>s``.

    Rows must be unique in ``by`` + ``order`` (default: the value). The caller
    chooses the ``size`` of a list, and (by…, part) is the key of the result at
    any size of the data: a longer group goes on in the next ``part``, so that
    no cell and no task holds a group of unknown length.
    """
    keys = list(order or [value])
    numbered = running_totals(
        df.select(*dict.fromkeys([*by, *keys, value])), by, keys, {"__one": F.lit(1)}
    )
    rows = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*keys, value]))))
    return (
        numbered.withColumn("part", F.floor(F.col("__one_before") / size))
        .groupBy(*by, "part")
        .agg(F.transform(rows, lambda r: r[value]).alias(f"{value}s"))
    )


def _with_lists(parents: DataFrame, lists: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with their lists; one without values has an empty list."""
    return parents.join(lists, key, "left").withColumns(
        {
            "part": F.coalesce("part", F.lit(0).cast("long")),
            name: F.coalesce(name, F.array().cast("array<string>")),
        }
    )


def providers_per_project(projects: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """Project and part with the provider of each of its runs; repeats kept, nulls not.

    One row per (project, part), see ``listed``.
    """
    known = runs.filter(F.col("provider_id").isNotNull())
    lists = listed(known, ["project_id"], "provider_id", size, ["provider_id", "inference_id"])
    return _with_lists(projects, lists, "project_id", "provider_ids")


def models_per_provider(providers: DataFrame, models: DataFrame, size: int) -> DataFrame:
    """Provider and part with the sorted list of its models (empty without any)."""
    lists = listed(models.select("provider_id", "model").distinct(), ["provider_id"], "model", size)
    return _with_lists(providers, lists, "provider_id", "models")


def options_by_task(tasks: DataFrame, options: DataFrame, name: str, size: int) -> DataFrame:
    """Task and part with the sorted list of its options (metrics or datasets)."""
    lists = listed(options.select("task_id", name).distinct(), ["task_id"], name, size)
    return _with_lists(tasks, lists, "task_id", f"{name}s")


# --- run planning ----------------------------------------------------------


def plan_runs(
    datasets: DataFrame, models: Sequence[Mapping], prompt: str, project: str
) -> DataFrame:
    """One pending run per dataset and requested model.

    ``models`` is the request: dicts with ``provider``, ``model`` and
    ``parameters``. The run id is a hash of the request, so planning twice
    gives the same ids.
    """
    requested = F.array(
        *[
            F.struct(
                F.lit(m["provider"]).alias("provider_id"),
                F.lit(m["model"]).alias("model"),
                F.to_json(F.create_map(*[F.lit(str(x)) for kv in m["parameters"].items()
                                         for x in kv])).alias("parameters")
                if m.get("parameters") else F.lit("{}").alias("parameters"),
            )
            for m in models
        ]
    )
    key = F.concat_ws("|", F.lit(project), "dataset_id", "provider_id", "model", "parameters",
                      F.lit(prompt))
    return datasets.select("dataset_id", "task_id", F.inline(requested)).select(
        F.substring(F.sha2(key, 256), 1, 12).alias("inference_id"),
        F.lit(project).alias("project_id"),
        "dataset_id", "task_id", "provider_id", "model", "parameters",
        F.lit(prompt).alias("prompt"), F.lit("pending").alias("status"),
    )


def copy_runs(runs: DataFrame, suffix: str = "copy") -> DataFrame:
    """New pending runs with the settings of existing ones and no results."""
    fresh = F.substring(F.sha2(F.concat_ws("|", "inference_id", F.lit(suffix)), 256), 1, 12)
    reset = {"inference_id": fresh, "status": F.lit("pending")}
    for name in ("object_key", "processed_examples", "total_examples", "created_at"):
        if name in runs.columns:
            reset[name] = F.lit(None).cast(runs.schema[name].dataType)
    if "is_favorite" in runs.columns:
        reset["is_favorite"] = F.lit(False)
    return runs.withColumns(reset)


def check_params(params: DataFrame, spec: DataFrame) -> DataFrame:
    """Add ``problem`` to run parameters that are unknown or out of range.

    ``params``: ``run_id, provider_id, model, parameter, value`` (text).
    """
    value = F.col("value")
    number = value.try_cast("double")
    allowed: Column = F.array(*map(F.lit, DEFAULT_EFFORTS))
    for model, efforts in EFFORTS.items():
        allowed = F.when(F.col("model") == model, F.array(*map(F.lit, efforts))).otherwise(
            allowed
        )
    outside = (
        F.when(
            F.col("type") == "number",
            number.isNull()
            | (number < F.coalesce("low", number))
            | (number > F.coalesce("high", number)),
        )
        .when(F.col("type") == "boolean", ~F.lower(value).isin("true", "false"))
        .when(F.col("type") == "effort", ~F.array_contains(allowed, value))
    )
    problem = F.when(F.col("type").isNull(), "unknown parameter").when(
        F.coalesce(outside, F.lit(True)), "invalid value"
    )
    return (
        params.join(spec, ["provider_id", "parameter"], "left")
        .withColumn("problem", problem)
        .select(*params.columns, "problem")
    )


def fill_params(params: DataFrame, spec: DataFrame) -> DataFrame:
    """Parameters as sent: blanks take the default, unused ones are dropped.

    Sampling parameters go when the run sets ``do_sample`` to false. Azure
    reasoning models keep only max_tokens and reasoning_effort, other Azure
    models lose reasoning_effort.
    """
    # Models that reason.
    reasoning = F.col("model").isin(*EFFORTS) | F.col("model").startswith("gpt-5")
    greedy = (
        params.filter((F.col("parameter") == "do_sample") & (F.lower("value") == "false"))
        .select("run_id", F.lit(True).alias("__greedy"))
        .distinct()
    )
    azure = F.col("provider_id") == "azure"
    unused = (
        F.when(azure & reasoning, ~F.col("parameter").isin("max_tokens", "reasoning_effort"))
        .when(azure, F.col("parameter") == "reasoning_effort")
        .otherwise(F.coalesce("__greedy", F.lit(False)) & F.col("parameter").isin(*SAMPLING))
    )
    chosen = F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("default_value"))
    return (
        params.join(greedy, "run_id", "left")
        .filter(~unused)
        .join(spec.select("provider_id", "parameter", "default_value"),
              ["provider_id", "parameter"], "left")
        .withColumn("value", chosen)
        .filter(F.col("value").isNotNull() & (F.col("value") != ""))
        .select(*params.columns)
    )


# What the providers' requests take, by kind of model.
REQUEST_PARAMETERS = {
    "azure": ("temperature", "top_p", "presence_penalty", "frequency_penalty", "stop", "n", "stream",
              "logprobs", "response_format", "max_tokens"),
    "azure reasoning": ("max_completion_tokens", "reasoning_effort"),
    "anthropic": ("max_tokens", "temperature"),
    "google": ("maxOutputTokens", "temperature", "topP"),
}
REQUEST_NAMES = {
    "azure": {"max_new_tokens": "max_tokens", "repetition_penalty": "frequency_penalty"},
    "azure reasoning": {"max_new_tokens": "max_completion_tokens",
                        "max_tokens": "max_completion_tokens"},
    "google": {"max_tokens": "maxOutputTokens", "top_p": "topP"},
}
# The limit that a request must state, and its default.
REQUEST_LIMIT = {"azure reasoning": "max_completion_tokens", "anthropic": "max_tokens",
                 "google": "maxOutputTokens"}
DEFAULT_LIMIT = "4096"
REASONING = r"^(o1|o3|o4|gpt-5)"


def request_params(params: DataFrame) -> DataFrame:
    """Parameters as a provider's request has them: ``run_id, parameter, value, problem``.

    Names are those of the provider, what it does not take is left out, and a
    limit that must be stated is. Models are known as reasoning ones by the
    start of their names; an effort that such a model does not have is a
    problem. A renamed parameter wins over one that had the name already.
    Providers that are not listed take everything as it is.
    """
    azure = F.col("provider_id") == "azure"
    reasoning = azure & F.lower("model").rlike(REASONING)
    kind = F.when(reasoning, "azure reasoning").otherwise(F.col("provider_id"))
    rows = params.withColumn("__kind", kind)
    name, taken = F.col("parameter"), F.lit(True)
    for group, names in REQUEST_NAMES.items():
        for old, new in names.items():
            here = (F.col("__kind") == group) & (F.col("parameter") == old)
            name = F.when(here, new).otherwise(name)
    rows = rows.withColumn("__name", name)
    for group, allowed in REQUEST_PARAMETERS.items():
        taken = F.when(F.col("__kind") == group, F.col("__name").isin(*allowed)).otherwise(taken)
    stated = ~F.col("provider_id").isin("anthropic", "google") | (
        F.coalesce("value", F.lit("")) != ""
    )
    sent = (
        rows.filter(taken & stated)
        .groupBy("run_id", "model", "__kind", "__name")
        .agg(F.max_by("value", F.col("__name") != F.col("parameter")).alias("value"))
    )
    limit: Column = F.lit(None).cast("string")
    for group, needed in REQUEST_LIMIT.items():
        limit = F.when(F.col("__kind") == group, needed).otherwise(limit)
    runs = rows.select("run_id", "model", "__kind").distinct().withColumn("__name", limit)
    missing = runs.filter(F.col("__name").isNotNull()).join(
        sent.select("run_id", "__name"), ["run_id", "__name"], "left_anti"
    )
    efforts: Column = F.array(*map(F.lit, DEFAULT_EFFORTS))
    for model, known in EFFORTS.items():
        efforts = F.when(F.lower("model") == model, F.array(*map(F.lit, known))).otherwise(efforts)
    wrong = (F.col("__name") == "reasoning_effort") & (F.col("__kind") == "azure reasoning")
    wrong = wrong & ~F.array_contains(efforts, F.col("value"))
    return sent.unionByName(missing.withColumn("value", F.lit(DEFAULT_LIMIT))).select(
        "run_id", F.col("__name").alias("parameter"), "value",
        F.when(wrong, "unsupported effort").alias("problem"),
    )
