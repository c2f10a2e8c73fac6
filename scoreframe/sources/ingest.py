"""Dataset files to checked ``id, input, reference`` rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

TARGETS = ("id", "input_raw", "reference")


class Checked(NamedTuple):
    good: DataFrame
    bad: DataFrame


def scan(
    spark: SparkSession, path: str | Sequence[str], fmt: str,
    schema: T.StructType | None = None, multi_line: bool = False,
) -> DataFrame:
    """Read CSV, JSON, JSON Lines or Parquet.

    CSV columns are text, as they stand in the file, so that an id ``007`` or a
    label ``1.10`` stays one; a quoted empty field is an empty text, an unquoted
    one is missing. ``json`` is one array of objects per file and
    cannot be split, nor can CSV with line ends inside quotes, which needs
    ``multi_line``; all else can. Give JSON a ``schema`` to skip its inference.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        # By default, Spark reads "" as missing too.
        options = {"header": True, "multiLine": multi_line, "escape": '"', "nullValue": None}
        return reader.options(**options).csv(paths)
    if fmt == "json":
        return reader.option("multiLine", True).json(paths)
    if fmt == "jsonl":
        return reader.json(paths)
    if fmt == "parquet":
        return reader.parquet(*paths)
    raise ValueError(f"unknown format {fmt!r}")


def map_columns(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Rename three source columns to ``id, input_raw, reference``.

    ``mapping`` is target to source; by default the first three columns in
    order. Each source column may be used once.
    """
    if mapping is None:
        if len(df.columns) < len(TARGETS):
            raise ValueError(f"need {len(TARGETS)} columns, found {len(df.columns)}")
        mapping = dict(zip(TARGETS, df.columns))
    missing = [t for t in TARGETS if t not in mapping]
    if missing:
        raise ValueError(f"no source column for {missing}")
    sources = [mapping[t] for t in TARGETS]
    if len(set(sources)) != len(sources):
        raise ValueError("a source column is used twice")
    return df.select(
        *[F.col("`" + s.replace("`", "``") + "`").alias(t) for t, s in zip(TARGETS, sources)]
    )


def _as_text(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.col(name)
    if isinstance(kind, T.ArrayType):
        return F.to_json(name)
    raise TypeError(f"column {name!r} must hold text or arrays, not {kind.simpleString()}")


def normalize_reference(df: DataFrame, columns: Sequence[str] = ("reference",)) -> DataFrame:
    """Arrays become JSON text, text stays, other types are an error; ids become text."""
    texts = {c: _as_text(c, df.schema[c].dataType) for c in columns}
    return df.withColumns({**texts, "id": F.col("id").cast("string")})


def row_problem() -> Column:
    """Why a row is rejected, null for a good row."""
    problem = F.lit(None).cast("string")
    for name in reversed(TARGETS):
        c = F.col(name)
        problem = (
            F.when(c.isNull(), F.lit(f"{name} is missing"))
            .when(F.length(c) == 0, F.lit(f"{name} is empty"))
            .otherwise(problem)
        )
    return problem


def validate_rows(df: DataFrame, mode: str = "fail") -> DataFrame | Checked:
    """Check that id, input and reference are non-empty text.

    ``split`` returns good rows (``id, input, reference``) and bad rows with
    their ``problem``. ``fail`` returns the good rows, or raises when any row
    is bad or the input is empty: a file is accepted whole or not at all.
    """
    checked = df.select(*TARGETS).withColumn("problem", row_problem())
    good = checked.filter(F.col("problem").isNull()).select(
        "id", F.col("input_raw").alias("input"), "reference"
    )
    if mode == "split":
        return Checked(good, checked.filter(F.col("problem").isNotNull()))
    if mode != "fail":
        raise ValueError(f"unknown mode {mode!r}")
    rows, bad = checked.agg(F.count(F.lit(1)), F.count("problem")).first()
    if not rows:
        raise ValueError("the dataset has no rows")
    if bad:
        raise ValueError(f"{bad} of {rows} rows are invalid")
    return good


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Ids that occur more than once, with their number of rows."""
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def read_dataset(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str,
    mapping: Mapping[str, str] | None = None,
    mode: str = "fail",
    schema: T.StructType | None = None,
    multi_line: bool = False,
) -> DataFrame | Checked:
    """Scan, map, normalise and check a dataset file."""
    mapped = map_columns(scan(spark, path, fmt, schema, multi_line), mapping)
    kinds = {f.name: f.dataType for f in mapped.schema.fields}
    # Numbers and dates of a given schema (CSV) are text in a dataset.
    plain = {
        c: F.col(c).cast("string")
        for c in TARGETS
        if not isinstance(kinds[c], (T.StringType, T.ArrayType, T.StructType, T.MapType))
    }
    if fmt == "csv" and plain:
        mapped = mapped.withColumns(plain)
    return validate_rows(normalize_reference(mapped, ("input_raw", "reference")), mode)
