"""Stored tables: outputs, scores, registry and exports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.views import view_order
from ..plans.scale import cut

# The folder column of a stored view.
RANGE = "__range"


def load_outputs(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None
) -> DataFrame:
    """Stored rows; only the columns a query uses are read.

    A filter on ``inference_id`` prunes partition folders.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def write_scores(
    df: DataFrame,
    path: str,
    by: Sequence[str] = ("inference_id",),
    mode: str = "append",
    rebalance: bool = True,
) -> None:
    """Append rows under one folder per run.

    The rebalance hint groups rows by run for well-sized files, while AQE
    splits a run that holds most of the rows over several tasks. Without it
    each task writes a file per run it holds.
    """
    rows = df.hint("rebalance", *by) if rebalance else df
    rows.write.partitionBy(*by).mode(mode).parquet(path)


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table without rows, so that resuming starts from nothing."""
    return spark.createDataFrame([], schema)


def load_registry(
    spark: SparkSession, path: str, tables: Sequence[str], options: Mapping | None = None
) -> dict[str, DataFrame]:
    """Metadata tables by name, from Parquet folders or, with options, JDBC."""
    if options is not None:
        return {
            t: spark.read.format("jdbc").options(url=path, dbtable=t, **options).load()
            for t in tables
        }
    return {t: spark.read.parquet(f"{path.rstrip('/')}/{t}") for t in tables}


def stringify_longs(df: DataFrame) -> DataFrame:
    """64-bit integers as text, at any depth: JSON readers lose their digits."""

    def convert(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.LongType):
            return T.StringType()
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(convert(kind.elementType), kind.containsNull)
        if isinstance(kind, T.MapType):
            return T.MapType(kind.keyType, convert(kind.valueType), kind.valueContainsNull)
        if isinstance(kind, T.StructType):
            return T.StructType(
                [T.StructField(f.name, convert(f.dataType), f.nullable) for f in kind.fields]
            )
        return kind

    return df.select(
        *[
            F.col("`" + f.name.replace("`", "``") + "`").cast(convert(f.dataType)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def export_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The shown records as JSON Lines, one file per task."""
    stringify_longs(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def export_evaluation(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested evaluations as Parquet, with the stored 32-bit metric values."""
    floats = F.transform_values("aggregate", lambda k, v: v.cast("float"))
    df.withColumn("aggregate", floats).write.mode(mode).parquet(path)


def rewrite(spark: SparkSession, path: str, keep: Callable[[DataFrame], DataFrame]) -> None:
    """Replace a stored table by ``keep`` of it, for instance ``purge`` of deleted keys.

    The new table is complete next to the old one before their names change
    places. A call that finds what a crash left puts the table back first.
    ``delete_rows`` leaves the folders of other runs as they are.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path.rstrip("/"))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, old = root.suffix("-new"), root.suffix("-old")
    if not files.exists(root):
        whole = fresh if files.exists(hadoop(fresh, "_SUCCESS")) else old
        if not (files.exists(whole) and files.rename(whole, root)):
            raise OSError(f"there is no table at {path}")
    keep(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{path.rstrip('/')}-new")
    files.delete(old, True)
    if not (files.rename(root, old) and files.rename(fresh, root)):
        raise OSError(f"{path} could not be replaced")
    files.delete(old, True)


def delete_rows(spark: SparkSession, path: str, gone: DataFrame, by: str = "inference_id", key: str = "id") -> int:
    """Delete rows of a table with a folder per run; returns the number of folders touched.

    ``gone`` names a run by ``by`` and a row of it by ``key``, or with a null key all
    rows of the run. Whole runs lose their folder. Of the others only the folders
    with deleted rows are read and replaced, all other files stay as they are. The
    rows that remain are stored before the first folder is replaced; a call that
    dies is repeated.
    """
    named = gone.select(F.col(by).cast("string").alias(by), F.col(key).alias("__key")).distinct()
    whole = {r[0] for r in named.filter("__key IS NULL").select(by).distinct().collect()}
    part = {r[0] for r in named.filter("__key IS NOT NULL").select(by).distinct().collect()} - whole
    root = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    # Folder names are escaped, so they are taken from what is there.
    table = spark.read.option("basePath", path).parquet(path).withColumn("__run", F.col(by).cast("string"))
    folders = {
        r["__run"]: r["folder"] for r in table.filter(F.col("__run").isin(*whole, *part)).select(
            "__run", F.regexp_replace(F.input_file_name(), "/[^/]+$", "").alias("folder")).distinct().collect()
    } if whole | part else {}
    part &= folders.keys()
    if part:
        runs = table.filter(F.col("__run").isin(*part))
        lost = named.filter(F.col(by).isin(*part)).select(F.col(by).alias("__run"), F.col("__key").alias(key))
        rows = cut(runs.join(lost, ["__run", key], "left_anti").drop("__run").select(*table.drop("__run").columns))
        left = {str(r[0]) for r in rows.select(by).distinct().collect()}
        # One write replaces the folders that keep rows.
        (rows.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(by).parquet(path))
        whole |= part - left
    for run in whole & folders.keys():
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folders[run]), True)
    return len(part | (whole & folders.keys()))


def store_view(
    df: DataFrame, path: str, column: str, ascending: bool = True, tie: str = "id", ranges: int = 200
) -> None:
    """Store a view in the order of ``sort_view`` as ranges, with the rows of each.

    ``path/rows`` has a folder per range, ``path/directory`` a row per range.
    ``column`` and ``tie`` together name a row, so equal values are cut as well.
    """
    dealt = df.repartitionByRange(ranges, *view_order(column, ascending, tie)).withColumn(
        RANGE, F.spark_partition_id()
    )
    dealt.write.partitionBy(RANGE).parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
    held = stored.groupBy(RANGE).agg(F.count(F.lit(1)).alias("rows"))
    held.coalesce(1).write.parquet(f"{path}/directory")


def stored_page(
    spark: SparkSession, path: str, schema: T.StructType, column: str, number: int = 0,
    size: int = 50, ascending: bool = True, tie: str = "id",
) -> DataFrame:
    """Page ``number`` (from 0) of a stored view, by position.

    The directory names the ranges that hold the page; only those are read and
    sorted, whatever the number. ``schema`` is the view's.
    """
    first, last = number * size, (number + 1) * size
    before, skipped, wanted = 0, 0, []
    for held in spark.read.parquet(f"{path}/directory").orderBy(RANGE).collect():
        if before + held.rows <= first:
            skipped = before + held.rows
        elif before < last:
            wanted.append(held[RANGE])
        before += held.rows
    if not wanted:
        return empty_table(spark, schema)
    named = T.StructType([*schema.fields, T.StructField(RANGE, T.IntegerType())])
    rows = spark.read.schema(named).parquet(f"{path}/rows").filter(F.col(RANGE).isin(wanted))
    ordered = rows.orderBy(*view_order(column, ascending, tie)).drop(RANGE)
    return ordered.offset(first - skipped).limit(size)


def store_bucketed(df: DataFrame, name: str, path: str, key: str = "id", buckets: int = 200) -> DataFrame:
    """Store a table under ``path`` by hash of ``key``, known to the catalog as ``name``.

    Tables of as many buckets join on the key without a shuffle: dataset,
    outputs and scores are dealt once, when they are stored. One sorted file a
    bucket; choose ``buckets`` so that one fits a task.
    """
    (
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        .option("path", path).saveAsTable(name)
    )
    return df.sparkSession.table(name)
