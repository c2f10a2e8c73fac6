"""Text search by an index of trigrams, for tables that are searched many times.

``search`` reads every text of a table. Here the table is stored once with the
list of rows of each trigram of its lower-cased texts. A search reads the lists
of the rarest trigrams of its text, takes the rows that hold all of them in one
column, and looks at the texts of those rows alone.

Under a path lie ``rows`` (a folder per part of the table), ``postings``
(column, trigram, list of rows; a folder per bucket of trigrams, sorted) and
``grams`` (rows per trigram). A trigram is one number of three code points of 21
bits. A task joins the rows of a trigram in lists before it deals them, so what is
shuffled is a number per row and trigram and not a row. The lists are made from the
stored rows, so a task that is repeated changes nothing. Texts longer than ``SLICE``
are cut with an overlap.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..plans.scale import cut, fits
from ..sources.storage import empty_table
from .views import search

SLICE = 1_000_000  # characters whose trigrams are one array
FLUSH = 2_000_000  # trigrams of rows that a task joins in lists
SPARE_ROWS = 1_000_000  # entries of further lists that are always worth reading

_ROW, _PART = "__row", "__part"


def _grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, as numbers."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])


def _text(value: pa.Scalar) -> str:
    """A text of a column; bytes that are no UTF-8 are read as U+FFFD."""
    return value.as_buffer().to_pybytes().decode(errors="replace")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(col, gram, rows) of batches of (row, col, text): a row per trigram of many texts."""
    rows, cols, grams, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        each = [len(g) for g in grams]
        row, col, gram = np.repeat(rows, each), np.repeat(np.array(cols, np.int16), each), np.concatenate(grams)
        order = np.lexsort((gram, col))
        row, col, gram = row[order], col[order], gram[order]
        first = np.ones(len(gram), bool)
        first[1:] = (gram[1:] != gram[:-1]) | (col[1:] != col[:-1])
        at = np.flatnonzero(first)
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(gram)), pa.int32()), pa.array(row, pa.int64()))
        return pa.record_batch([pa.array(col[at], pa.int32()), pa.array(gram[at]), lists], ["col", "gram", "rows"])

    for batch in batches:
        for row, col, text in zip(*[batch.column(i) for i in range(3)]):
            found = _grams(_text(text))
            rows.append(row.as_py())
            cols.append(col.as_py())
            grams.append(found)
            held += len(found)
            if held >= FLUSH:
                yield flush()
                rows, cols, grams, held = [], [], [], 0
    if held:
        yield flush()


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def store_search_index(
    df: DataFrame, path: str, cols: Sequence[str] | None = None, parts: int | None = None,
    buckets: int = 256,
) -> None:
    """Store a table with the trigrams of ``cols`` (default: all columns).

    ``parts`` is the number of folders of rows, by default the table's own
    partitions. A null text has no trigrams. The lists of common trigrams are
    spread over several tasks by the rebalanced write.
    """
    spark, cols = df.sparkSession, list(cols or df.columns)
    dealt = df if parts is None else df.repartition(parts)
    kept = dealt.withColumns({_ROW: F.monotonically_increasing_id(), _PART: F.spark_partition_id()})
    kept.write.partitionBy(_PART).parquet(f"{path}/rows")
    stored = spark.read.schema(kept.schema).parquet(f"{path}/rows")

    texts = F.array(*[
        F.struct(F.lit(i).alias("col"), F.lower(_quoted(c).cast("string")).alias("text"))
        for i, c in enumerate(cols)
    ])
    one = stored.select(_PART, _ROW, F.inline(texts)).filter("length(text) >= 3")
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(SLICE))
    slices = one.select(_PART, _ROW, "col", "text", F.explode(starts).alias("start")).select(
        _PART, _ROW, "col", F.substring("text", F.col("start"), F.lit(SLICE + 2)).alias("text")
    )
    postings = slices.select(_ROW, "col", "text").mapInArrow(_lists, "col int, gram long, rows array<long>")
    (
        postings.withColumn("bucket", _bucket(F.col("gram"), buckets))
        .hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram")
        .write.partitionBy("bucket").parquet(f"{path}/postings")
    )
    counted = spark.read.schema(_postings_schema()).parquet(f"{path}/postings").groupBy("bucket", "gram", "col")
    (
        counted.agg(F.sum(F.size("rows")).alias("rows")).hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/grams")
    )
    about = [(cols, buckets, df.schema.json())]
    spark.createDataFrame(about, "cols array<string>, buckets int, schema string").coalesce(1).write.json(
        f"{path}/about"
    )


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _postings_schema() -> str:
    return "col int, gram long, rows array<long>, bucket int"


def search_stored(
    spark: SparkSession, path: str, text: str, cols: Sequence[str] | None = None
) -> DataFrame:
    """The rows that ``search`` finds, through the index under ``path``.

    ``cols`` are some of the indexed columns (default: all of them). A text of
    less than three characters names no trigram: all rows are read then.
    """
    about = spark.read.schema("cols array<string>, buckets int, schema string").json(f"{path}/about").first()
    schema = T.StructType.fromJson(json.loads(about.schema))
    named = T.StructType([*schema.fields, T.StructField(_ROW, T.LongType()), T.StructField(_PART, T.IntegerType())])
    rows = spark.read.schema(named).parquet(f"{path}/rows")
    cols = list(cols or about.cols)
    if unknown := set(cols) - set(about.cols):
        raise ValueError(f"columns without an index: {sorted(unknown)}")

    found = candidates(spark, path, text, cols)
    if found is None:
        return search(rows, text, cols).drop(_ROW, _PART)
    parts = [r[0] for r in found.select(_PART).distinct().collect()]  # folders, not rows
    if not parts:
        return empty_table(spark, schema)
    named_rows = rows.filter(F.col(_PART).isin(parts))
    small = F.broadcast(found) if fits(found) else found
    return search(named_rows.join(small, [_PART, _ROW], "left_semi"), text, cols).drop(_ROW, _PART)


def candidates(spark: SparkSession, path: str, text: str, cols: Sequence[str]) -> DataFrame | None:
    """Rows that hold the rarest trigrams of a text in one of ``cols``; None if it has none.

    Lists are read from the rarest on, while they are short enough to be worth
    it: a list left out only leaves more rows to be looked at.
    """
    about = spark.read.schema("cols array<string>, buckets int, schema string").json(f"{path}/about").first()
    lowered = spark.range(1).select(F.lower(F.lit(text))).first()[0]
    named = [(int(g),) for g in (_grams(lowered) if len(lowered) > 2 else ())]
    if not named:
        return None
    wanted = [
        tuple(r) for r in spark.createDataFrame(named, "gram long")
        .select("gram", _bucket(F.col("gram"), about.buckets)).collect()
    ]
    grams = [g for g, _ in wanted]
    at = [about.cols.index(c) for c in cols]

    def lists(table: DataFrame, some: Sequence[str]) -> DataFrame:
        buckets = sorted({b for g, b in wanted if g in some})
        return table.filter(
            F.col("bucket").isin(buckets) & F.col("gram").isin(list(some)) & F.col("col").isin(at)
        )

    counts = spark.read.schema("gram long, col int, rows long, bucket int").parquet(f"{path}/grams")
    known = lists(counts, grams).groupBy("gram").agg(F.sum("rows").alias("rows")).collect()
    size = {r.gram: r.rows for r in known}
    order = sorted(grams, key=lambda g: (size.get(g, 0), g))
    chosen, read = order[:1], 0
    for g in order[1:]:
        read += size.get(g, 0)
        if read > SPARE_ROWS + 8 * size.get(order[0], 0):
            break
        chosen.append(g)
    postings = spark.read.schema(_postings_schema()).parquet(f"{path}/postings")
    each = lists(postings, chosen).select("col", "gram", F.explode("rows").alias(_ROW))
    held = each.groupBy(_ROW, "col").agg(F.collect_set("gram").alias("grams"))
    # The upper bits of a row's number are the partition that it came from.
    part = F.shiftright(_ROW, 33).cast("int").alias(_PART)
    return cut(held.filter(F.size("grams") == len(chosen)).select(part, _ROW).distinct())
