"""Change logs: scores, notes and highlights."""

from pyspark.sql import functions as F

from scoreframe.operators import annotations as A

from . import fixtures as fx
from .base import query, table
from .fixtures import sql


@query(sql("SELECT evaluation_id, row_id, score FROM fx_human_state", "fx_human_state"))
def human_scores(spark, sf_dir):
    return A.apply_changes(None, fx.human_log(spark, sf_dir), A.SCORE_KEYS, ["score"]).drop(
        "version"
    )


@query(sql("SELECT evaluation_id, row_id, score, version FROM (SELECT *, row_number() OVER "
           "(PARTITION BY evaluation_id, row_id ORDER BY version DESC) AS k FROM fx_human_log) "
           "WHERE k = 1 AND score IS NOT NULL", "fx_human_log"))
def human_scores_in_steps(spark, sf_dir):
    """Early changes make a state, late ones are applied to it."""
    log = fx.human_log(spark, sf_dir)
    early = log.filter(F.col("version") % 4 != 3)
    late = log.filter(F.col("version") % 4 == 3)
    state = A.apply_changes(None, early, A.SCORE_KEYS, ["score"], keep_deleted=True)
    return A.apply_changes(state, late, A.SCORE_KEYS, ["score"])


@query(
    """SELECT event_id, event_id % 8 BETWEEN 1 AND 5 OR event_type = 'error' AS accepted
FROM events"""
)
def score_checks(spark, sf_dir):
    score = F.when(F.col("event_type") != "error", F.col("event_id") % 8)
    return table(spark, sf_dir, "events").select(
        "event_id", A.valid_score(score).alias("accepted")
    )


@query(
    """SELECT concat('run', event_id % 4) AS inference_id, CAST(user_id AS VARCHAR) AS row_id,
  arg_max(props, event_id) AS content FROM events GROUP BY ALL"""
)
def notes(spark, sf_dir):
    e = F.col("event_id")
    changes = table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), (e % 4).cast("string")).alias("inference_id"),
        F.col("user_id").cast("string").alias("row_id"),
        e.alias("version"), F.col("props").alias("content"),
    )
    return A.apply_changes(None, changes, A.NOTE_KEYS, ["content"]).drop("version")


_MARKS = """SELECT concat('run', event_id % 4) AS inference_id, CAST(user_id AS VARCHAR) AS row_id,
  event_id AS version, event_id % 50 AS s, event_id % 50 + CAST(floor(value) AS BIGINT) % 30 - 5
  AS e FROM events"""


@query(
    sql(
        """SELECT row_id, s AS start, e AS "end" FROM (
  SELECT m.*, row_number() OVER (PARTITION BY inference_id, row_id ORDER BY version DESC) AS k
  FROM marks m WHERE e >= s) WHERE k = 1 AND inference_id = 'run1'
  AND row_id NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'signup' AND event_id % 5 = 0)""",
        marks=_MARKS,
    )
)
def highlights(spark, sf_dir):
    """Valid highlights of one run, after a deletion by row ids."""
    events = table(spark, sf_dir, "events")
    e = F.col("event_id")
    changes = events.select(
        F.concat(F.lit("run"), (e % 4).cast("string")).alias("inference_id"),
        F.col("user_id").cast("string").alias("row_id"),
        e.alias("version"), (e % 50).alias("start"),
        (e % 50 + F.floor("value") % 30 - 5).alias("end"),
    ).filter(A.valid_highlight())
    state = A.apply_changes(None, changes, A.NOTE_KEYS, ["start", "end"])
    gone = events.filter((F.col("event_type") == "signup") & (e % 5 == 0)).select(
        F.lit("run1").alias("inference_id"), F.col("user_id").cast("string").alias("row_id")
    ).distinct()
    deleted = A.deletions(gone, {"start": "bigint", "end": "bigint"}, F.lit(2**62))
    left = A.apply_changes(state, deleted, A.NOTE_KEYS, ["start", "end"])
    return A.current_state(left, "run1", "start", "inference_id").join(
        A.current_state(left, "run1", "end", "inference_id"), "row_id"
    )
