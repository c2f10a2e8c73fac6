"""Streaming jobs run to the end of their input; batch SQL is the oracle."""

from pyspark.sql import functions as F, types as T

from scoreframe.operators.annotations import SCORE_KEYS
from scoreframe.plans.scale import cut, scratch_path
from scoreframe.schemas import OUTPUTS
from scoreframe.streaming import jobs as J

from . import fixtures as fx
from .base import query
from .corpus import YES_NO
from .fixtures import sql

_COLUMNS = ["inference_id", "id", "output"]
_ARRIVED = T.StructType([*OUTPUTS.fields, T.StructField("arrived", T.TimestampType())])


def _arrivals(spark, sf_dir) -> str:
    """Outputs in ten files a minute apart, and a part of them delivered again later."""
    path = scratch_path(spark, "arrivals")
    minute = F.pmod(F.xxhash64("id"), F.lit(10))
    outputs = fx.label_outputs(spark, sf_dir).select(
        *_COLUMNS, F.timestamp_seconds(1_700_000_000 + 60 * minute).alias("arrived"))
    outputs.repartition(10, "id").write.parquet(path)
    again = outputs.filter(minute == 3).withColumn("arrived", F.expr("arrived + INTERVAL 20 MINUTES"))
    again.coalesce(1).write.mode("append").parquet(path)
    return path


def _once(spark, arrivals):
    """Arriving outputs; a key is remembered for an hour after it came."""
    stream = J.read_outputs(spark, arrivals, _ARRIVED, files_per_trigger=4)
    return J.dedupe_outputs(stream, arrived="arrived", delay="1 hour")


def _scored(spark, sf_dir, arrivals) -> str:
    stream = _once(spark, arrivals)
    scores = J.stream_scores(stream, fx.labels(spark, sf_dir), YES_NO)
    path = scratch_path(spark, "scored")
    done = J.write_stream(scores, path, scratch_path(spark, "scored-log"))
    done.awaitTermination()
    return path


@query(
    sql(
        "SELECT inference_id, id, parsed, accuracy FROM fx_label_scores", "fx_label_scores"
    )
)
def stream_scores(spark, sf_dir):
    path = _scored(spark, sf_dir, _arrivals(spark, sf_dir))
    return spark.read.parquet(path).select(
        "inference_id", "id", "parsed", F.element_at("metrics", "accuracy").alias("accuracy")
    )


@query(
    sql(
        """SELECT inference_id, id, CAST(id AS BIGINT) % 9 <> 0 AS known,
  CASE WHEN CAST(id AS BIGINT) % 9 <> 0 THEN accuracy END AS accuracy FROM fx_label_scores""",
        "fx_label_scores",
    )
)
def stream_unknown_ids(spark, sf_dir):
    """Outputs for ids that the dataset lacks are kept and marked."""
    stream = _once(spark, _arrivals(spark, sf_dir))
    labels = fx.labels(spark, sf_dir).filter(F.col("id").cast("long") % 9 != 0)
    path = scratch_path(spark, "scored")
    done = J.write_stream(
        J.stream_scores(stream, labels, YES_NO), path, scratch_path(spark, "scored-log")
    )
    done.awaitTermination()
    return spark.read.parquet(path).select(
        "inference_id", "id", "known", F.element_at("metrics", "accuracy").alias("accuracy")
    )


@query(
    sql(
        """SELECT inference_id, 'accuracy' AS metric, round(sum(accuracy), 9) AS total,
  count(*) AS n FROM fx_label_scores GROUP BY inference_id""",
        "fx_label_scores",
    )
)
def stream_aggregates(spark, sf_dir):
    scored = _scored(spark, sf_dir, _arrivals(spark, sf_dir))
    schema = spark.read.parquet(scored).schema
    updates = J.stream_aggregates(J.read_outputs(spark, scored, schema, files_per_trigger=5))
    path = scratch_path(spark, "aggregates")
    J.write_updates(updates, path, scratch_path(spark, "aggregates-log")).awaitTermination()
    return J.latest_updates(spark, path, ["inference_id", "metric"]).withColumn(
        "total", F.round("total", 9)
    )


@query(
    sql(
        """SELECT inference_id, count(*) AS processed, 2 * count(*) AS total, 50 AS percent
FROM fx_label_outputs GROUP BY inference_id""",
        "fx_label_outputs",
    )
)
def stream_progress(spark, sf_dir):
    totals = fx.label_outputs(spark, sf_dir).groupBy("inference_id").agg(
        (2 * F.count(F.lit(1))).alias("total")
    )
    stream = _once(spark, _arrivals(spark, sf_dir))
    path = scratch_path(spark, "progress")
    J.write_updates(
        J.stream_progress(stream, totals), path, scratch_path(spark, "progress-log")
    ).awaitTermination()
    return J.latest_updates(spark, path, ["inference_id"])


@query(
    sql(
        """SELECT inference_id, 'accuracy' AS metric, round(sum(accuracy), 9) AS total,
  count(*) AS n FROM fx_label_scores GROUP BY inference_id""",
        "fx_label_scores",
    )
)
def stream_folded(spark, sf_dir):
    """Running aggregates whose batches were folded, then the newest one repeated."""
    scored = _scored(spark, sf_dir, _arrivals(spark, sf_dir))
    schema = spark.read.parquet(scored).schema
    path, log = scratch_path(spark, "aggregates"), scratch_path(spark, "aggregates-log")
    updates = J.stream_aggregates(J.read_outputs(spark, scored, schema, files_per_trigger=5))
    J.write_updates(updates, path, log).awaitTermination()
    keys = ["inference_id", "metric"]
    J.fold_updates(spark, path, keys)
    J.fold_updates(spark, path, keys)
    newest = max(r.batch for r in spark.read.parquet(path).select("batch").distinct().collect())
    again = spark.read.parquet(f"{path}/batch={newest}")
    cut(again).write.mode("overwrite").parquet(f"{path}/batch={newest}")
    return J.latest_updates(spark, path, keys).withColumn("total", F.round("total", 9))


@query(sql("SELECT evaluation_id, row_id, score FROM fx_human_state", "fx_human_state"))
def stream_changes(spark, sf_dir):
    arrivals = scratch_path(spark, "changes")
    log = fx.human_log(spark, sf_dir)
    log.repartition(6, "version").write.parquet(arrivals)
    stream = J.read_outputs(spark, arrivals, log.schema, files_per_trigger=2)
    path = scratch_path(spark, "state")
    J.stream_changes(
        stream, path, scratch_path(spark, "state-log"), SCORE_KEYS, ["score"]
    ).awaitTermination()
    J.fold_changes(spark, path, SCORE_KEYS, ["score"])
    return J.annotation_state(spark, path, SCORE_KEYS, ["score"]).drop("version")


@query(sql("SELECT evaluation_id, row_id, score FROM fx_human_state", "fx_human_state"))
def stream_keyed_state(spark, sf_dir):
    """One value of state per key; the stream is stopped and goes on with late changes."""
    log = fx.human_log(spark, sf_dir).withColumn(
        "at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("version")))
    arrivals, path, done = (scratch_path(spark, n) for n in ("changes", "keyed", "keyed-log"))

    def drain(part):
        log.filter(part).repartition(3, "version").write.mode("append").parquet(arrivals)
        stream = J.read_outputs(spark, arrivals, log.schema, files_per_trigger=2)
        J.keyed_state(stream, path, done, SCORE_KEYS, ["score"], "at", "365 days").awaitTermination()

    drain(F.col("version") % 4 != 3)
    drain(F.col("version") % 4 == 3)
    J.fold_updates(spark, path, SCORE_KEYS)
    return J.keyed_rows(spark, path, SCORE_KEYS).drop("version")


@query(
    sql(
        """SELECT coalesce(o.inference_id, e.inference_id) AS inference_id, coalesce(o.id, e.id) AS id,
  CASE WHEN e.id IS NULL THEN 'unknown' WHEN o.id IS NULL THEN 'missing' ELSE 'met' END AS status,
  CASE WHEN e.id IS NOT NULL AND o.id IS NOT NULL THEN o.accuracy END AS accuracy
FROM (SELECT * FROM fx_label_scores WHERE CAST(id AS BIGINT) % 7 <> 2) o
FULL JOIN (SELECT DISTINCT inference_id, l.id FROM fx_labels l, fx_label_outputs
  WHERE CAST(l.id AS BIGINT) % 7 <> 4) e ON o.inference_id = e.inference_id AND o.id = e.id""",
        "fx_label_scores", "fx_labels", "fx_label_outputs",
    )
)
def stream_late_rows(spark, sf_dir):
    """Examples come before or after their outputs, or never; so do outputs."""
    number = F.col("id").cast("long")
    outputs = fx.label_outputs(spark, sf_dir).select(*_COLUMNS).filter(number % 7 != 2)
    examples = fx.labels(spark, sf_dir).select("id", "reference").filter(number % 7 != 4)
    runs = [r[0] for r in outputs.select("inference_id").distinct().collect()]

    def arrive(frame, name, minutes):
        path = scratch_path(spark, name)
        stamped = frame.withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * minutes))
        # What has nothing to wait for comes five hours later and moves the time on.
        later = number % 7 == 0
        stamped.filter(~later).repartition(4, "id").write.parquet(path)
        late = stamped.filter(later).withColumn("arrived", F.expr("arrived + INTERVAL 5 HOURS"))
        late.coalesce(1).write.mode("append").parquet(path)
        return J.read_outputs(spark, path, stamped.schema, files_per_trigger=2)

    came = arrive(outputs, "outputs", number % 30)
    asked = arrive(examples, "examples", (number * 13) % 30)
    met = J.join_arrivals(came, J.expected_rows(asked, runs), wait="1 hour", delay="1 hour")
    path = scratch_path(spark, "met")
    J.write_stream(J.score_arrivals(met, YES_NO), path, scratch_path(spark, "met-log")).awaitTermination()
    return spark.read.parquet(path).select(
        "inference_id", "id", "status", F.element_at("metrics", "accuracy").alias("accuracy"))
