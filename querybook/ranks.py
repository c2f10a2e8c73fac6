"""Rankings and run summaries."""

from pyspark.sql import functions as F

from scoreframe.operators import ranking as R
from scoreframe.operators.annotations import SCORE_KEYS, apply_changes
from scoreframe.operators.corpus import human_aggregate

from . import fixtures as fx
from .base import query
from .fixtures import sql

_PRIMARY = """CASE task WHEN 'Generation' THEN 'rougel'
  WHEN 'Multiple Choice Questions' THEN 'accuracy' END"""
_VALUE = """CASE task WHEN 'Generation' THEN rougel
  WHEN 'Multiple Choice Questions' THEN accuracy END"""


_EFFECTIVE = """SELECT *, CASE WHEN status = 'done' AND wants_human AND total > 0
    AND rated < total THEN 'processing' ELSE status END AS effective
FROM (SELECT e.*, coalesce(h.rated, 0) AS rated,
        CASE WHEN total_examples > 0 THEN total_examples ELSE coalesce(h.rated, 0) END AS total
      FROM fx_evaluations e LEFT JOIN (SELECT evaluation_id, count(*) AS rated
        FROM fx_human_state GROUP BY evaluation_id) h USING (evaluation_id))"""


def _effective(spark, sf_dir):
    evals = fx.evaluations(spark, sf_dir)
    state = apply_changes(None, fx.human_log(spark, sf_dir), SCORE_KEYS, ["score"])
    return R.effective_status(evals, human_aggregate(state, evals))


@query(
    sql(
        f"""SELECT inference_id, {_PRIMARY} AS metric_key, max({_VALUE}) AS value
FROM effective WHERE effective = 'done' AND object_key IS NOT NULL AND {_VALUE} IS NOT NULL
GROUP BY ALL""",
        "fx_evaluations", "fx_human_state", effective=_EFFECTIVE,
    )
)
def best_primary(spark, sf_dir):
    return R.best_primary(_effective(spark, sf_dir))


_LATEST = """SELECT inference_id, evaluation_id, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY inference_id
    ORDER BY created_at DESC NULLS LAST, evaluation_id) AS k
  FROM fx_evaluations WHERE {status} = 'done' AND object_key IS NOT NULL) WHERE k = 1"""


@query(
    sql(
        _LATEST.format(status="effective").replace("fx_evaluations", "effective"),
        "fx_evaluations", "fx_human_state", effective=_EFFECTIVE,
    )
)
def latest_completed(spark, sf_dir):
    return R.latest_completed(_effective(spark, sf_dir))


@query(
    sql(
        """SELECT evaluation_id, effective AS effective_status,
  CASE WHEN status = 'done' AND wants_human THEN rated ELSE 0 END AS rated_rows,
  CAST(CASE WHEN status = 'done' AND wants_human THEN total ELSE total_examples END AS BIGINT)
    AS total_rows
FROM effective""",
        "fx_evaluations", "fx_human_state", effective=_EFFECTIVE,
    )
)
def effective_status(spark, sf_dir):
    return _effective(spark, sf_dir).select(
        "evaluation_id", "effective_status", "rated_rows",
        F.col("total_rows").cast("long").alias("total_rows"),
    )


@query(
    sql(
        f"""SELECT c.inference_id, c.evaluations, c.has_running,
  l.evaluation_id AS latest_evaluation_id, b.metric_key, b.best_value
FROM (SELECT inference_id, count(*) AS evaluations,
        bool_or(effective IN ('pending', 'processing')) AS has_running
      FROM effective GROUP BY inference_id) c
LEFT JOIN latest l USING (inference_id)
LEFT JOIN (SELECT inference_id, {_PRIMARY} AS metric_key, max({_VALUE}) AS best_value
  FROM effective WHERE effective = 'done' AND object_key IS NOT NULL AND {_VALUE} IS NOT NULL
  GROUP BY ALL) b USING (inference_id)""",
        "fx_evaluations", "fx_human_state", effective=_EFFECTIVE,
        latest=_LATEST.format(status="effective").replace("fx_evaluations", "effective"),
    )
)
def run_summary(spark, sf_dir):
    return R.run_summary(_effective(spark, sf_dir))


@query(
    sql(
        """SELECT dataset, inference_id, value, CAST(place AS INT) AS place,
  list_extract(['gold', 'silver', 'bronze'], place) AS tier
FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY value DESC, inference_id)
  AS place FROM fx_best) WHERE place <= 3""",
        "fx_best",
    )
)
def dataset_placements(spark, sf_dir):
    return R.dataset_placements(fx.best(spark, sf_dir)).select(
        "dataset", "inference_id", "value", "place", "tier"
    )


_MODELS = """SELECT model_key, dataset, max(value) AS value FROM fx_best GROUP BY ALL"""
_COMPARABLE = """SELECT * FROM models WHERE model_key IN (SELECT model_key FROM models
  GROUP BY model_key HAVING count(*) = (SELECT count(DISTINCT dataset) FROM models))"""
_RANKED = """SELECT *, rank() OVER (PARTITION BY dataset ORDER BY value DESC)
  + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2.0 AS rank FROM comparable"""


@query(sql("SELECT * FROM models", "fx_best", models=_MODELS))
def model_dataset_scores(spark, sf_dir):
    return R.model_dataset_scores(fx.best(spark, sf_dir))


@query(sql("SELECT * FROM comparable", "fx_best", models=_MODELS, comparable=_COMPARABLE))
def comparable_models(spark, sf_dir):
    return R.comparable_models(R.model_dataset_scores(fx.best(spark, sf_dir)))


@query(
    """SELECT l_orderkey, l_linenumber, l_returnflag, CAST(rank() OVER (PARTITION BY l_returnflag
  ORDER BY l_extendedprice DESC) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice)
  - 1) / 2.0 AS DOUBLE) AS rank FROM lineitem"""
)
def average_rank(spark, sf_dir):
    from .base import table

    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"
    )
    return R.average_rank(lines, ["l_returnflag"], "l_extendedprice").drop("l_extendedprice")


_OVERALL = """SELECT model_key, rank() OVER (ORDER BY total) AS position,
  round(CAST(total AS DOUBLE) / n, 9) AS average_rank, n AS dataset_count,
  count(*) OVER () AS model_count
FROM (SELECT model_key, sum(rank) AS total, count(*) AS n FROM ranked GROUP BY model_key)"""


@query(
    sql(
        _OVERALL, "fx_best", models=_MODELS, comparable=_COMPARABLE, ranked=_RANKED,
    )
)
def overall_ranking(spark, sf_dir):
    scores = R.model_dataset_scores(fx.best(spark, sf_dir))
    return R.overall_ranking(scores).withColumn("average_rank", F.round("average_rank", 9))


@query(
    sql(
        """SELECT model_key, position, average_rank, dataset_count, model_count,
  CASE position WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' END AS medal FROM overall""",
        "fx_best", models=_MODELS, comparable=_COMPARABLE, ranked=_RANKED, overall=_OVERALL,
    )
)
def ranking_table(spark, sf_dir):
    # Every run carries its model's ranking, as in a project listing.
    runs = fx.best(spark, sf_dir).select("model_key", "inference_id")
    overall = R.overall_ranking(R.model_dataset_scores(fx.best(spark, sf_dir)))
    carried = runs.join(overall, "model_key")
    return R.ranking_table(carried).withColumn("average_rank", F.round("average_rank", 9))


@query(
    sql(
        _OVERALL, "fx_evaluations", "fx_human_state", effective=_EFFECTIVE,
        models="""SELECT concat(c_mktsegment, '::', c_nationkey % 2) AS model_key,
  n_regionkey AS dataset, max(CASE task WHEN 'Generation' THEN rougel ELSE accuracy END) AS value
FROM effective JOIN customer ON inference_id = concat('run', c_custkey)
JOIN nation ON c_nationkey = n_nationkey
WHERE effective = 'done' AND object_key IS NOT NULL AND task <> 'Relation Extraction'
GROUP BY ALL HAVING value IS NOT NULL""",
        comparable=_COMPARABLE, ranked=_RANKED,
    )
)
def leaderboard(spark, sf_dir):
    """From evaluation records to overall positions of provider::model."""
    from scoreframe.plans.scoring import leaderboard as board

    from .base import table

    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("dataset")
    )
    runs = table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(
        F.concat(F.lit("run"), F.col("c_custkey").cast("string")).alias("inference_id"),
        "dataset", F.col("c_mktsegment").alias("provider_id"),
        (F.col("c_nationkey") % 2).cast("string").alias("model"),
    )
    return board(_effective(spark, sf_dir), runs).withColumn(
        "average_rank", F.round("average_rank", 9)
    )


@query(sql("SELECT DISTINCT dataset FROM fx_best", "fx_best"))
def shared_datasets(spark, sf_dir):
    return R.shared_datasets(fx.best(spark, sf_dir))


@query(
    sql(
        """SELECT r.inference_id,
  CASE WHEN a.asked IS NULL THEN f.first ELSE d.evaluation_id END AS evaluation_id,
  CASE WHEN a.asked IS NOT NULL AND d.evaluation_id IS NULL
         THEN 'requested evaluation is not done'
       WHEN a.asked IS NULL AND f.first IS NULL THEN 'no evaluation is done' END AS problem
FROM (SELECT DISTINCT inference_id FROM fx_evaluations) r
LEFT JOIN (SELECT inference_id, evaluation_id AS first FROM (SELECT *, row_number() OVER
    (PARTITION BY inference_id ORDER BY created_at NULLS FIRST, evaluation_id) AS k
  FROM fx_evaluations WHERE status = 'done') WHERE k = 1) f USING (inference_id)
LEFT JOIN (SELECT inference_id, max(evaluation_id) AS asked FROM fx_evaluations
  WHERE total_examples = 3 GROUP BY inference_id) a USING (inference_id)
LEFT JOIN fx_evaluations d ON d.inference_id = r.inference_id AND d.evaluation_id = a.asked
  AND d.status = 'done'""",
        "fx_evaluations",
    )
)
def select_evaluation(spark, sf_dir):
    evals = fx.evaluations(spark, sf_dir)
    requested = evals.filter(F.col("total_examples") == 3).groupBy("inference_id").agg(
        F.max("evaluation_id").alias("evaluation_id")
    )
    return R.select_evaluation(evals, requested)
