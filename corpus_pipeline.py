"""The corpus pipeline: quality rules, near duplicates, substrings, mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the driver
of the stages writes it as Parquet and reads it back as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark import cloudpickle  # noqa: E402
from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

import scoreframe  # noqa: E402
from scoreframe.llm import mixing, ngram_join, packing, quality, queries, substrings  # noqa: E402
from scoreframe.llm.base import saved, table  # noqa: E402

# Row functions travel inside the tasks, so executors need no copy of the repo.
cloudpickle.register_pickle_by_value(scoreframe)

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS[:-1], F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cascade."""
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles at 0.8 link."""
    return ngram_join.keep_one(docs, size=5, percent=80).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier text holds; texts left empty go."""
    cleaned = substrings.dedupe(docs.select(*COLUMNS))
    some = F.col("n_spans").isNull() | (F.col("n_spans") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _documents(cleaned.where(some))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the last one of a source in part."""
    return _documents(mixing.texts(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in the packed sequences."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("source mix", source_mix),
    ("best-fit packing", packing_stage),
]

#: Stages two, three and five have no SQL form; tests hold the run against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
