"""Structured Streaming jobs: incremental scoring, live aggregates, annotations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.annotations import apply_changes
from ..plans.scoring import ScoringPlan, score_rows


def read_outputs(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """Arriving output files as a stream; new files are found once each."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def dedupe_outputs(
    stream: DataFrame,
    keys: Sequence[str] = ("inference_id", "id"),
    arrived: str | None = None,
    delay: str = "1 hour",
) -> DataFrame:
    """Drop rows that were delivered before.

    With an arrival time the keys are forgotten after ``delay``, which bounds
    the state; without one every key is remembered.
    """
    if arrived is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_scores(stream: DataFrame, dataset: DataFrame, plan: ScoringPlan) -> DataFrame:
    """Arriving outputs joined with the dataset, parsed and scored.

    ``inference_id, id, parsed, metrics, known``. The dataset is a static side:
    only the id and reference columns are read per batch. An output whose id
    the dataset does not have is kept with ``known`` false and without metrics;
    missing ids show in the progress of the run.
    """
    wanted = dataset.select("id", "reference", F.lit(True).alias("known"))
    scored = score_rows(stream.join(wanted, "id", "left"), plan)
    known = F.coalesce("known", F.lit(False))
    return scored.select(
        "inference_id", "id", "parsed", F.when(known, F.col("metrics")).alias("metrics"),
        known.alias("known"),
    )


def expected_rows(examples: DataFrame, runs: Sequence[str]) -> DataFrame:
    """A row per arriving example and run that has to answer it."""
    return examples.withColumn("inference_id", F.explode(F.array(*[F.lit(r) for r in runs])))


def join_arrivals(
    outputs: DataFrame, expected: DataFrame, wait: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Outputs and the examples they answer, whichever of the two comes first.

    ``outputs``: ``inference_id, id, output, arrived``; ``expected``: ``inference_id,
    id, reference, arrived``; both may stream. A pair meets if its two sides arrive
    at most ``wait`` apart. What has met nothing when the watermarks (``delay`` behind
    each side's newest time) say that its time is up is named: an output as
    ``unknown``, an example as ``missing``. The state holds that span only. Rows are
    ``inference_id, id, output, reference, status``.
    """
    o = outputs.withWatermark("arrived", delay).select(
        F.col("inference_id").alias("__run"), F.col("id").alias("__id"), "output", F.col("arrived").alias("__came"))
    e = expected.withWatermark("arrived", delay).select("inference_id", "id", "reference", "arrived")
    span = F.expr(f"INTERVAL {wait}")
    met = o.join(e, (F.col("__run") == F.col("inference_id")) & (F.col("__id") == F.col("id"))
                 & (F.col("__came") >= F.col("arrived") - span) & (F.col("__came") <= F.col("arrived") + span),
                 "full_outer")
    status = F.when(F.col("id").isNull(), "unknown").when(F.col("__id").isNull(), "missing").otherwise("met")
    return met.select(
        F.coalesce("inference_id", "__run").alias("inference_id"), F.coalesce("id", "__id").alias("id"),
        "output", "reference", status.alias("status"))


def score_arrivals(met: DataFrame, plan: ScoringPlan) -> DataFrame:
    """Rows of ``join_arrivals``, parsed, with metrics where both sides have come."""
    return score_rows(met, plan).select(
        "inference_id", "id", "parsed", F.when(F.col("status") == "met", F.col("metrics")).alias("metrics"), "status")


def write_stream(
    scores: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ("inference_id",),
    files_per_run: int = 2,
) -> StreamingQuery:
    """Append to Parquet and stop when the present input is used up.

    The checkpoint remembers the files done, so a restart goes on after them. A
    batch leaves at most ``files_per_run`` files per run: its rows are dealt by run
    and a hash of their id. Raise it where one run has most rows of large batches.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(files_per_run))
    return (
        scores.repartition(*by, part).writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*by)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_aggregates(scores: DataFrame) -> DataFrame:
    """Running sum and count of each metric per run; the state is one row each."""
    return (
        scores.select("inference_id", F.explode("metrics").alias("metric", "value"))
        .filter(F.col("value").isNotNull())
        .groupBy("inference_id", "metric")
        .agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    )


def stream_progress(stream: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows answered so far per run, next to its total: ``inference_id, total``."""
    done = stream.groupBy("inference_id").agg(F.count(F.lit(1)).alias("processed"))
    percent = F.round(100.0 * F.col("processed") / F.col("total")).cast("int")
    return done.join(totals.select("inference_id", "total"), "inference_id").withColumn(
        "percent", percent
    )


def write_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write changed rows of a running aggregate, one folder per batch.

    A batch that is repeated after a failure replaces its own folder.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return (
        updates.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


#: A folded log stands beside the batches it holds, under a name that readers of
#: the batch folders pass over.
_FOLDED = "_folded-"


class _Log:
    """The batch folders of a log and the folded tables beside them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = self._path(self.path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in self.files.listStatus(self.root)]
        self.batches = self._numbers(names, "batch=")
        #: Complete folded tables by the last batch they hold.
        self.folded = [n for n in self._numbers(names, _FOLDED)
                       if self.files.exists(self._path(self.root, f"{_FOLDED}{n}/_SUCCESS"))]

    @staticmethod
    def _numbers(names: Sequence[str], prefix: str) -> list[int]:
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def rows(self, upto: int | None = None) -> DataFrame:
        """The newest folded table and the batches after it, with their ``batch``."""
        start = self.folded[-1] if self.folded else -1
        later = [f"{self.path}/batch={n}" for n in self.batches
                 if n > start and (upto is None or n <= upto)]
        parts = []
        if self.folded:
            parts.append(self.spark.read.parquet(f"{self.path}/{_FOLDED}{start}"))
        if later or not parts:
            read = self.spark.read.option("basePath", self.path).parquet(*(later or [self.path]))
            parts.append(read.withColumn("batch", F.col("batch").cast("long")))
        return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]

    def fold(self, merge: Callable[[DataFrame], DataFrame]) -> int:
        """Fold all batches but the newest; returns how many the new table holds.

        The newest batch may be repeated by the stream and replaces its own folder,
        so it is no part of a folded table. Every step leaves a state that readers
        understand: the new table counts as soon as it is complete, and what it
        holds is only read from it then. The folders that the table before it
        holds go now, so a reader that began before this fold finds all its files
        until the next one.
        """
        upto = self.batches[-2] if len(self.batches) > 1 else -1
        start = self.folded[-1] if self.folded else -1
        held = [n for n in self.batches if start < n <= upto]
        if held:
            merge(self.rows(upto)).write.mode("overwrite").parquet(f"{self.path}/{_FOLDED}{upto}")
        for number in self.batches:
            if number <= start:
                self.files.delete(self._path(self.root, f"batch={number}"), True)
        for number in self.folded[:-1]:
            self.files.delete(self._path(self.root, f"{_FOLDED}{number}"), True)
        return len(held)


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key of a folder made by ``write_updates``."""
    return _newest(_Log(spark, path).rows(), keys).drop("batch")


def _newest(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in log.columns if c not in {*keys, "batch"}]
    return (
        log.groupBy(*keys)
        .agg(F.max("batch").alias("batch"), F.max_by(F.struct(*values), "batch").alias("__last"))
        .select(*keys, "__last.*", "batch")
    )


def fold_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> int:
    """Fold the batch folders of ``write_updates`` into one table beside them.

    To be run between runs of the stream, any number of times. Returns how many
    batches it added; the folders go with the next fold. The newest batch stays
    as it is, since the stream may write it again.
    """
    return _Log(spark, path).fold(lambda log: _newest(log, keys))


def fold_changes(
    spark: SparkSession, path: str, keys: Sequence[str], values: Sequence[str], version: str = "version"
) -> int:
    """``fold_updates`` for the log of ``stream_changes``: the last change per key, deletions kept."""

    def merge(log: DataFrame) -> DataFrame:
        last = apply_changes(None, log, keys, values, version, keep_deleted=True)
        return last.withColumn("batch", F.lit(-1).cast("long"))

    return _Log(spark, path).fold(merge)


def stream_changes(
    changes: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    values: Sequence[str],
    version: str = "version",
) -> StreamingQuery:
    """Fold each batch of annotation changes and log it, one folder per batch.

    A batch is reduced to the last change per key before it is written, with
    deletions kept; ``annotation_state`` folds the batches.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        folded = apply_changes(None, batch, keys, values, version, keep_deleted=True)
        folded.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return (
        changes.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def annotation_state(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    values: Sequence[str],
    version: str = "version",
) -> DataFrame:
    """Current state from the batches that ``stream_changes`` wrote, folded or not."""
    return apply_changes(None, _Log(spark, path).rows(), keys, values, version)


class _Last(StatefulProcessor):
    """The last change of a key; a deletion is remembered until its time is up."""

    def __init__(self, values: Sequence[str], version: str, at: str, state: T.StructType, out: T.StructType):
        self.values, self.version, self.at = list(values), version, at
        self.state, self.names = state, out.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.state)

    @staticmethod
    def _order(change: tuple) -> tuple:
        # As in a batch: the version, then the values, nulls first.
        return tuple((v is not None, v if v is not None else 0) for v in change[:-1])

    @staticmethod
    def _deleted(change: tuple) -> bool:
        return all(v is None for v in change[1:-1])

    @staticmethod
    def _time(change: tuple) -> int:
        return int(change[-1].timestamp() * 1000)

    def handleInputRows(self, key, rows, timerValues):
        held = self.last.get()
        before = best = None if held is None else tuple(held)
        for row in rows:
            change = (row[self.version], *[row[v] for v in self.values], row[self.at])
            if best is None or self._order(change) > self._order(best):
                best = change
        if best == before:
            return
        # Every call asks the executor: the value says which timer there is, if any.
        if before is not None and self._deleted(before):
            self.handle.deleteTimer(self._time(before))
        deleted = self._deleted(best)
        if deleted:
            # An older change that comes after this is late and never gets here.
            self.handle.registerTimer(self._time(best))
        self.last.update(best)
        yield Row(**dict(zip(self.names, (*key, *best[1:-1], best[0], deleted))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.last.get()
        if held is not None and self._deleted(tuple(held)):
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_state(
    changes: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    values: Sequence[str],
    at: str,
    delay: str = "1 hour",
    version: str = "version",
) -> StreamingQuery:
    """Annotation changes folded per key by a state of one value each.

    The state holds the last change of every live key. A deletion stays as a mark
    against older changes that come later, with a timer at its time ``at``: when
    the watermark (``delay`` behind the newest time) is past it, older changes are
    late, the mark is dropped, and the state holds live keys only. Versions have
    to grow with ``at``. Each batch writes the keys that it changed, deletions
    marked ``deleted``, as ``write_updates`` does; ``keyed_rows`` reads them and
    ``fold_updates`` folds them. A restart goes on from the checkpoint.
    """
    spark = changes.sparkSession
    columns = {f.name: f.dataType for f in changes.schema.fields}
    fields = [T.StructField(c, columns[c]) for c in (version, *values, at)]
    out = T.StructType([
        *[T.StructField(c, columns[c]) for c in (*keys, *values, version)],
        T.StructField("deleted", T.BooleanType()),
    ])
    folded = (
        changes.withWatermark(at, delay).groupBy(*keys)
        .transformWithState(
            _Last(values, version, at, T.StructType(fields), out), out, "Update", "EventTime")
    )
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    # Timers need this store; a query keeps the store it was first started with.
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return write_updates(folded, path, checkpoint)
    finally:
        spark.conf.set(provider, before)


def keyed_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The live rows of a folder made by ``keyed_state``."""
    return latest_updates(spark, path, keys).filter(~F.col("deleted")).drop("deleted")
