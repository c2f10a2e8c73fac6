"""Named parsers and metrics, built in and user supplied."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import parsers as P


class ParserSpec(NamedTuple):
    """One step of a parser chain: a parser id and its arguments."""

    id: str
    args: Mapping[str, object] = {}


class Parser(NamedTuple):
    build: Callable[[Column, Mapping[str, object]], Column]
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()


def _choice(letters: str) -> Parser:
    return Parser(lambda c, args: P.parse_choice(c, letters))


def _keywords(*labels: str) -> Parser:
    return Parser(lambda c, args: P.parse_keyword(c, labels))


_PARSERS: dict[str, Parser] = {
    "extract_first_character": Parser(lambda c, args: P.parse_first_char(c)),
    "extract_first_word": Parser(lambda c, args: P.parse_first_word(c)),
    "process_mcq_abcde": _choice("abcde"),
    "process_mcq_abcd": _choice("abcd"),
    "process_mcq_abc": _choice("abc"),
    "process_mcq_yes_no_maybe": _keywords("yes", "no", "maybe"),
    "process_mcq_true_false": _keywords("true", "false"),
    "process_mcq_positive_negative": _keywords("positive", "negative"),
    "process_mcq_option": Parser(
        lambda c, args: P.parse_option(c, args.get("option_type", P.DEFAULT_OPTION_TYPE)),
        optional=("option_type",),
    ),
    "process_mlc_option": Parser(
        lambda c, args: P.parse_labels(c, args["labels"]), ("labels",), ("delimiter",)
    ),
    "process_mlc_option_hoc": Parser(lambda c, args: P.parse_labels(c, P.HALLMARKS)),
    "process_mlc_option_litcovid": Parser(lambda c, args: P.parse_labels(c, P.COVID_TOPICS)),
    "extract_ner_spans": Parser(lambda c, args: P.spans_to_json(P.extract_spans(c))),
}


def register_parser(
    name: str,
    fn: Callable,
    kind: str = "python",
    required: Sequence[str] = (),
    optional: Sequence[str] = (),
) -> None:
    """Add a parser.

    ``kind="column"``: ``fn(column, args) -> Column``, which stays in the JVM.
    ``kind="python"``: ``fn(text, args) -> str | None``, run on Arrow batches.
    """
    if kind == "column":
        build = fn
    elif kind == "python":

        def build(c: Column, args: Mapping[str, object]) -> Column:
            settings = dict(args)

            @F.arrow_udf("string")
            def parse(batch: pa.Array) -> pa.Array:
                return pa.array([fn(text, settings) for text in batch.to_pylist()], pa.string())

            return parse(c)

    else:
        raise ValueError(f"unknown parser kind {kind!r}")
    _PARSERS[name] = Parser(build, tuple(required), tuple(optional))


def check_spec(spec: ParserSpec) -> Parser:
    """The parser of a step; an unknown id or argument is an error."""
    if spec.id not in _PARSERS:
        raise KeyError(f"unknown parser {spec.id!r}")
    parser = _PARSERS[spec.id]
    given = set(spec.args)
    missing = set(parser.required) - given
    unknown = given - set(parser.required) - set(parser.optional)
    if missing or unknown:
        raise ValueError(
            f"parser {spec.id!r}: missing {sorted(missing)}, unknown {sorted(unknown)}"
        )
    return parser


def apply_parsers(c: Column | str, specs: Sequence[ParserSpec]) -> Column:
    """A parser chain as one column, applied left to right."""
    out = F.col(c) if isinstance(c, str) else c
    for spec in specs:
        out = check_spec(spec).build(out, spec.args)
    return out


def default_parsers(task: str, classes: Sequence[str] = ()) -> list[ParserSpec]:
    """The chain used when none is given: label matching for multi-label."""
    if task == "mlc" and classes:
        return [ParserSpec("process_mlc_option", {"labels": list(classes)})]
    return []


# --- metrics -----------------------------------------------------------------


class Metric(NamedTuple):
    """``row(pred, ref) -> Column`` and/or ``corpus(rows, by) -> DataFrame``.

    A corpus metric returns ``by…, value``. A metric with only a row form is
    averaged. ``kind`` "human" and "external" have no form of their own.
    """

    kind: str
    row: Callable[[Column, Column], Column] | None = None
    corpus: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None


# How each built-in metric is computed.
_METRICS: dict[str, Metric] = {
    "accuracy": Metric("row"),
    "macro_f1": Metric("corpus"),
    "weighted_f1": Metric("corpus"),
    "exact_match_precision": Metric("corpus"),
    "exact_match_recall": Metric("corpus"),
    "exact_match_f1": Metric("corpus"),
    "rouge1": Metric("text"),
    "rouge2": Metric("text"),
    "rougeL": Metric("text"),
    "meteor": Metric("text"),
    "bertscore": Metric("external"),
    "bartscore": Metric("external"),
    "llm_judge_correctness": Metric("external"),
    "llm_judge_completeness": Metric("external"),
    "llm_judge_relevance": Metric("external"),
    "human_evaluation": Metric("human"),
}


def register_metric(
    name: str,
    row: Callable[[Column, Column], Column] | None = None,
    corpus: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None,
) -> None:
    if (row is None) == (corpus is None):
        raise ValueError("give either a row function or a corpus function")
    _METRICS[name] = Metric("custom", row, corpus)


def metric_plan(metric_ids: Sequence[str]) -> dict[str, Metric]:
    """How each requested metric is computed; an unknown id is an error."""
    unknown = [m for m in metric_ids if m not in _METRICS]
    if unknown:
        raise KeyError(f"unknown metrics {unknown}")
    return {m: _METRICS[m] for m in metric_ids}
