"""Evaluation of text-model outputs as Spark DataFrame transforms.

Column functions are in ``functions``, DataFrame transforms in ``operators``,
readers and writers in ``sources``, whole jobs and plan helpers in ``plans``,
Structured Streaming jobs in ``streaming``. The names below are the usual way
in.
"""

from .functions.registry import ParserSpec, register_metric, register_parser
from .operators.generation import generate
from .operators.stats import compare_runs
from .operators.views import Condition, compare_view, filter_by_metrics
from .plans.scoring import Evaluation, ScoringPlan, evaluate, leaderboard
from .sources.ingest import read_dataset
from .streaming.jobs import stream_scores

__all__ = [
    "Condition", "Evaluation", "ParserSpec", "ScoringPlan", "compare_runs", "compare_view",
    "evaluate", "filter_by_metrics", "generate", "leaderboard", "read_dataset",
    "register_metric", "register_parser", "stream_scores",
]
