"""Batch generation with a deterministic client."""

from pyspark.sql import functions as F

from scoreframe.operators.generation import generate, generate_stored
from scoreframe.plans.scale import scratch_path

from . import fixtures as fx
from .base import query, table
from .fixtures import sql


class TooFast(Exception):
    pass


def _make_client():
    def answer(prompt: str) -> str:
        number = int(prompt.rsplit("#", 1)[1])
        if number % 10 == 0:
            raise TooFast("RATE_LIMIT reached")
        if number % 10 == 1:
            raise ValueError("no answer")
        return f"{len(prompt)} {prompt[:8]}"

    return answer


@query(
    sql(
        """SELECT d.id, CASE WHEN d.doc_id % 10 = 0 THEN '[ERROR: Rate limit exceeded]'
  WHEN d.doc_id % 10 = 1 THEN '[ERROR: ValueError]'
  ELSE length(p) || ' ' || substr(p, 1, 8) END AS output
FROM (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, 'Read: ' || text || ' #' || doc_id AS p
      FROM documents) d
WHERE d.id NOT IN (SELECT id FROM fx_label_outputs WHERE inference_id = 'run1'
  AND output <> '   ')""",
        "fx_label_outputs",
    )
)
def generate_pending(spark, sf_dir):
    dataset = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat("text", F.lit(" #"), F.col("doc_id").cast("string")).alias("input"),
    )
    done = fx.label_outputs(spark, sf_dir).filter(
        (F.col("inference_id") == "run1") & (F.col("output") != "   ")
    )
    return generate(dataset, _make_client, "Read: {{input}}", done, parallel=8)


@query(
    """SELECT id, CASE WHEN doc_id % 10 = 0 THEN '[ERROR: Rate limit exceeded]'
  WHEN doc_id % 10 = 1 THEN '[ERROR: ValueError]'
  ELSE length(p) || ' ' || substr(p, 1, 8) END AS output
FROM (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, 'Read: ' || text || ' #' || doc_id AS p
      FROM documents)"""
)
def generate_durable(spark, sf_dir):
    """Answers are stored in batches; the second run finds nothing left to ask."""
    dataset = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat("text", F.lit(" #"), F.col("doc_id").cast("string")).alias("input"),
    )
    path = scratch_path(spark, "generated")
    some = dataset.filter(F.col("id").cast("long") % 3 == 0)
    generate_stored(some, _make_client, "Read: {{input}}", path, batch_rows=100_000, parallel=8)
    return generate_stored(dataset, _make_client, "Read: {{input}}", path, 100_000, parallel=8)
