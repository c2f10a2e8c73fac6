"""Helpers shared by the operators: registration, tables, scratch, let-binding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.scale import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

#: ASCII white space; words are the runs of anything else.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs the tasks that it ran and not
    the whole history; every later reader sees the same rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch on its way to a Python worker, about.
BATCH_BYTES = 4_000_000
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches end by bytes as well as by rows.

    Ten thousand whole texts in a batch may be any size, and they are held by the
    executor and by the worker at once. A size that the session sets is left alone.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES, None) is None:
        conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    The optimizer may copy a projected expression into every place that names
    it, also into the body of a lambda; a lambda's own variable is never copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, ``[^\\x20\\x09-\\x0D]+``; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words, without the words."""
    plain = F.coalesce(text, F.lit(""))
    return F.regexp_count(plain, F.lit(f"[^{SPACE}]+")).cast("long")
