"""Metric maps and lists: cleaning, lookup, labels and display formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col

# Display names by lower-cased metric id.
METRIC_LABELS = {
    "accuracy": "Accuracy",
    "macro_f1": "Macro-F1",
    "micro_f1": "Micro-F1",
    "precision": "Precision",
    "recall": "Recall",
    "f1": "F1",
    "bertscore": "BERTScore",
    "bartscore": "BARTScore",
    "bleu": "BLEU",
    "meteor": "METEOR",
    "rouge1": "ROUGE-1",
    "rouge2": "ROUGE-2",
    "rougel": "ROUGE-L",
    "exact_match_precision": "Exact Match Precision",
    "exact_match_recall": "Exact Match Recall",
    "exact_match_f1": "Exact Match F1",
    "llm_judge_correctness": "LLM Judge Correctness",
    "llm_judge_completeness": "LLM Judge Completeness",
    "llm_judge_relevance": "LLM Judge Relevance",
    "human_evaluation": "Human Evaluation",
    "human_evaluation_mean": "Human Score (Avg)",
    "human_evaluation_count": "Rated Rows",
}

# Metrics shown first, by task.
PREFERRED_METRICS = {
    "Multiple Choice Questions": ("accuracy",),
    "Named-entity Recognition": (
        "exact_match_f1", "exact_match_precision", "exact_match_recall",
    ),
    "Multi-label Classification": ("macro_f1", "accuracy"),
    "Single-label Classification": ("macro_f1", "accuracy"),
    "Generation": (
        "rougel", "bertscore", "llm_judge_completeness", "bartscore", "meteor",
        "rouge1", "rouge2",
    ),
}


def finite(c: Column | str) -> Column:
    """True for numbers: neither null, NaN nor infinite (Spark sorts NaN last)."""
    return F.coalesce(F.abs(col(c)) < float("inf"), F.lit(False))


def clean_metric_list(c: Column | str) -> Column:
    """Metric ids without nulls; a missing list is empty."""
    return F.coalesce(F.filter(col(c), lambda m: m.isNotNull()), F.array().cast("array<string>"))


def clean_aggregate(c: Column | str) -> Column:
    """Keep the finite numbers of an aggregate map; missing becomes empty."""
    return F.coalesce(
        F.map_filter(col(c), lambda k, v: finite(v)), F.create_map().cast("map<string,double>")
    )


def entries_to_aggregate(c: Column | str) -> Column:
    """``array<struct<key,value>>`` to a clean map; a later equal key wins."""
    typed = F.transform(
        col(c),
        lambda e: F.struct(e["key"].alias("key"), e["value"].try_cast("double").alias("value")),
    )
    usable = F.filter(typed, lambda e: e["key"].isNotNull() & finite(e["value"]))

    def last_of_key(entries: Column) -> Column:
        size = F.size(entries)
        return F.filter(
            entries,
            lambda e, i: ~F.exists(
                F.slice(entries, i + 2, F.greatest(size, F.lit(1))),
                lambda later: later["key"] == e["key"],
            ),
        )

    # A one-element transform names a value, so that it is computed once.
    unique = F.get(F.transform(F.array(usable), last_of_key), F.lit(0))
    return F.coalesce(
        F.map_from_entries(unique), F.create_map().cast("map<string,double>")
    )


def metric_value(metrics: Column | str, key: Column | str) -> Column:
    """Finite value under the key, else under the key in any case, else null.

    An exact key with a non-finite value still falls through to the first
    entry that matches without case.
    """
    metrics = col(metrics)
    key = F.lit(key) if isinstance(key, str) else key
    exact = F.element_at(metrics, key)
    wanted = F.lower(key)
    entry = F.get(
        F.filter(F.map_entries(metrics), lambda e: F.lower(e["key"]) == wanted), F.lit(0)
    )["value"]
    return F.coalesce(
        F.when(finite(exact), exact), F.get(F.filter(F.array(entry), finite), F.lit(0))
    )


def metric_label(c: Column | str) -> Column:
    """Display name of a metric id; unknown ids are shown as they are."""
    name = col(c)
    pairs = [F.lit(x) for item in METRIC_LABELS.items() for x in item]
    known = F.element_at(F.create_map(*pairs), F.lower(name))
    return F.coalesce(known, name)


def compare_label(c: Column | str) -> Column:
    """Display name in comparison views: any ROUGE variant is spelled out."""
    name = col(c)
    digits = F.regexp_replace(name, "[^0-9]", "")
    rouge = (
        F.when(F.length(digits) > 0, F.concat(F.lit("ROUGE-"), digits))
        .when(F.lower(name) == "rougel", "ROUGE-L")
        .otherwise(F.upper(name))
    )
    # These ids have no label in comparison views.
    plain = F.lower(name).isin(
        "macro_f1", "micro_f1", "exact_match_precision", "exact_match_recall",
        "exact_match_f1",
    )
    return (
        F.when(F.upper(name).startswith("ROUGE"), rouge)
        .when(plain, name)
        .otherwise(metric_label(name))
    )


def metric_summary(c: Column | str, n: int = 3) -> Column:
    """First ``n`` labels of a metric list, then " +k"; "no metrics" if empty."""
    named = F.filter(clean_metric_list(c), lambda m: m != "")
    labels = F.transform(named, compare_label)
    shown = F.array_join(F.slice(labels, 1, n), ", ")
    more = F.size(labels) - n
    return (
        F.when(F.size(labels) == 0, "no metrics")
        .when(more > 0, F.concat(shown, F.lit(" +"), more.cast("string")))
        .otherwise(shown)
    )


def summary_metrics(aggregate: Column | str, task: Column | str, k: int = 2) -> Column:
    """The ``k`` metrics shown for a run: preferred ones first, then the rest."""
    aggregate, task = col(aggregate), col(task)
    preferred = F.array().cast("array<string>")
    for name, metrics in PREFERRED_METRICS.items():
        preferred = F.when(task == name, F.array(*map(F.lit, metrics))).otherwise(preferred)
    ordered = F.array_distinct(F.concat(preferred, F.map_keys(aggregate)))
    present = F.filter(ordered, lambda key: F.map_contains_key(aggregate, key))
    return F.transform(
        F.slice(present, 1, k),
        lambda key: F.struct(
            key.alias("key"),
            metric_label(key).alias("label"),
            F.element_at(aggregate, key).alias("value"),
        ),
    )


def format_metric(c: Column | str, style: str = "row") -> Column:
    """Number as text: "row" 4 decimals, "summary" 4 significant digits,
    "rank" 2 decimals. Anything that is not a number is a dash."""
    value = col(c).try_cast("double")
    if style == "row":
        text = F.format_string("%.4f", F.round(value, 4))
    elif style == "rank":
        text = F.format_string("%.2f", F.round(value, 2))
    elif style == "summary":
        # Digits after the point so that four significant ones remain; plain
        # decimal notation without trailing zeros.
        size = F.floor(F.log10(F.nullif(F.abs(value), F.lit(0.0))))
        scale = F.pow(F.lit(10.0), 3 - F.coalesce(size, F.lit(0)))
        plain = (F.round(value * scale) / scale).try_cast("decimal(38,18)").cast("string")
        text = F.rtrim(F.rtrim(plain, F.lit("0")), F.lit("."))
        # Beyond the range of the decimal type the digits are written out.
        digits = F.round(F.abs(value) * scale).cast("long").cast("string")
        sign = F.when(value < 0, "-").otherwise("")
        zeros = F.repeat(F.lit("0"), (-size - 1).cast("int"))
        tiny = F.concat(sign, F.lit("0."), zeros, F.rtrim(digits, F.lit("0")))
        huge = F.concat(sign, digits, F.repeat(F.lit("0"), (size - 3).cast("int")))
        text = F.when(size >= 15, huge).when(size < -12, tiny).otherwise(text)
    else:
        raise ValueError(f"unknown style {style!r}")
    return F.when(F.abs(value) < float("inf"), text).otherwise(F.lit("—"))


def format_created(c: Column | str) -> Column:
    """Stored time shown in New York; no zone means UTC, bad or null is "-".

    The wall time is computed from the instant, not from the session's zone.
    """
    text = F.regexp_replace(F.trim(col(c).cast("string")), "^(\\S+) ", "$1T")
    zoned = F.when(text.rlike(r"([zZ]|[+-]\d{2}:\d{2})$"), text).otherwise(
        F.concat(text, F.lit("Z"))
    )
    since_epoch = F.unix_micros(F.try_to_timestamp(zoned))
    utc = F.timestamp_add("MICROSECOND", since_epoch, F.lit("1970-01-01").cast("timestamp_ntz"))
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), utc)
    zone = F.when(F.timestamp_diff("HOUR", local, utc) == 4, "EDT").otherwise("EST")
    return F.coalesce(
        F.concat(F.date_format(local, "MMM dd, yyyy, hh:mm a"), F.lit(" "), zone), F.lit("-")
    )


def apply_highlight(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """Split a text into ``before, marked, after`` by [start, end).

    Offsets count characters and are clamped to the text; an empty range or
    one past the end leaves everything in ``before``.
    """
    text, start, end = col(text), col(start), col(end)
    size = F.length(text)
    lo, hi = F.greatest(start, F.lit(0)), F.least(end, size)
    active = F.coalesce((start < end) & (start < size), F.lit(False))
    return F.struct(
        F.when(active, F.substring(text, F.lit(1), lo)).otherwise(text).alias("before"),
        F.when(active, F.substring(text, lo + 1, hi - lo)).otherwise("").alias("marked"),
        F.when(active, F.substring(text, hi + 1, size - hi)).otherwise("").alias("after"),
    )
