"""Batch generation: prompts to outputs through a user-supplied client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.parsers import error_label
from ..plans.scale import scratch_path
from .views import pending_rows, render_prompt

Client = Callable[[str], str | None]


def generate(
    dataset: DataFrame,
    make_client: Callable[[], Client],
    template: str,
    done: DataFrame | None = None,
    parallel: int | None = None,
) -> DataFrame:
    """Outputs ``id, output`` for every dataset row that has none yet.

    ``make_client`` builds one client per partition. A row whose call raises
    gets an error label and the job goes on. ``parallel`` bounds the number of
    concurrent clients, which is the rate limit towards a provider. Rows are
    independent: a lost executor repeats only its own partition.
    """
    todo = dataset if done is None else pending_rows(dataset, done)
    prompts = render_prompt(todo, template).select("id", "prompt")
    if parallel is not None:
        prompts = prompts.repartition(parallel)
    id_type = dataset.schema["id"].dataType.simpleString()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for batch in batches:
            outputs, kinds, messages = [], [], []
            for prompt in batch.column("prompt").to_pylist():
                try:
                    outputs.append(client(prompt))
                    kinds.append(None)
                    messages.append(None)
                except Exception as problem:
                    outputs.append(None)
                    kinds.append(type(problem).__name__)
                    messages.append(str(problem))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id")]
                + [pa.array(c, pa.string()) for c in (outputs, kinds, messages)],
                names=["id", "output", "err_type", "err_msg"],
            )

    answered = prompts.mapInArrow(
        answer, f"id {id_type}, output string, err_type string, err_msg string"
    )
    label = F.when(F.col("err_type").isNull(), F.col("output")).otherwise(
        error_label("err_type", "err_msg")
    )
    return answered.select("id", label.alias("output"))


def generate_stored(
    dataset: DataFrame,
    make_client: Callable[[], Client],
    template: str,
    path: str,
    batch_rows: int,
    parallel: int | None = None,
) -> DataFrame:
    """Generate into a table under ``path`` and return it.

    Rows that the table has already are not asked again, so every later read
    and every restart costs no call for them. Pending rows are found in one pass,
    dealt by id hash to batches of about ``batch_rows`` and written by batch; each
    batch reads its own part and is stored before the next is asked, so a job
    that dies loses one batch of answers at most. The dataset and the store are
    read as often for a thousand batches as for one.
    """
    spark = dataset.sparkSession
    id_type = dataset.schema["id"].dataType.simpleString()

    def stored() -> DataFrame:
        return spark.read.schema(f"id {id_type}, output string").parquet(path)

    spark.createDataFrame([], f"id {id_type}, output string").write.mode("append").parquet(path)
    pending = pending_rows(dataset, stored())
    batches = max(1, -(-pending.count() // batch_rows))
    dealt = pending.withColumn("__batch", F.pmod(F.xxhash64("id"), F.lit(batches)))
    todo = scratch_path(spark, "pending")
    dealt.hint("rebalance", "__batch").write.partitionBy("__batch").parquet(todo)
    for number in sorted(r[0] for r in spark.read.parquet(todo).select("__batch").distinct().collect()):
        mine = spark.read.schema(pending.schema).parquet(f"{todo}/__batch={number}")
        answers = generate(mine, make_client, template, parallel=parallel)
        answers.write.mode("append").parquet(path)
    return stored()
