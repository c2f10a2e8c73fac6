"""Sources and sinks."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from scoreframe.plans.scale import scratch_path
from scoreframe.schemas import OUTPUTS
from scoreframe.sources.ingest import duplicate_ids, normalize_reference, read_dataset, validate_rows
from scoreframe.sources.storage import (
    empty_table, export_json, load_outputs, load_registry, write_scores,
)

from . import fixtures as fx
from .base import query, table
from .fixtures import sql

#: Characters of an array of objects in one file; a longer object is a file of its own.
ARRAY_CHARS = 4_000_000


def _shape():
    return ["id", "reference", F.length("input").alias("chars"), F.md5("input").alias("digest")]


def _whole(checked):
    """Good and bad rows of a split read: a document may have no text, and its row counts too."""
    bad = checked.bad.select("id", F.col("input_raw").alias("input"), "reference")
    return checked.good.union(bad)


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS reference, CAST(length(text) AS INT) AS chars, "
    "md5(text) AS digest FROM documents"
)
def ingest_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    # Not quoteAll, which writes a missing text as an empty one.
    docs.write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    mapping = {"id": "doc_id", "input_raw": "text", "reference": "lang"}
    rows = read_dataset(spark, path, "csv", mapping, mode="split", multi_line=True)
    return _whole(rows).select(*_shape())


@query(
    "SELECT concat(lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0'), '.', doc_id) AS id, "
    "concat(doc_id % 7, '.10') AS reference, CAST(length(x) AS INT) AS chars, md5(x) AS digest "
    "FROM (SELECT *, concat('0', doc_id, 'e1 ', replace(replace(replace(text, chr(10), ' '), "
    "chr(13), ' '), chr(34), chr(39))) AS x FROM documents)"
)
def ingest_csv_text(spark, sf_dir):
    """Ids and labels that look like numbers stay as they are; the file can be split."""
    path = scratch_path(spark, "csv")
    line = F.translate("text", '\n\r"', "  '")
    table(spark, sf_dir, "documents").select(
        F.concat(F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit("."),
                 F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("0"), F.col("doc_id").cast("string"), F.lit("e1 "), line).alias("text"),
        F.concat((F.col("doc_id") % 7).cast("string"), F.lit(".10")).alias("label"),
    ).write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return read_dataset(spark, path, "csv").select(*_shape())


def _arrays(batches):
    """Rows of one column ``value``: arrays of objects, as many as a task's rows need."""

    def whole():
        return pa.RecordBatch.from_arrays([pa.array([f"[{','.join(held)}]"], pa.string())], ["value"])

    held, chars = [], 0
    for batch in batches:
        columns = [batch.column(c) for c in batch.schema.names]
        for row in zip(*columns):
            one = json.dumps(
                dict(zip(batch.schema.names, (x.as_py() for x in row))), ensure_ascii=False
            )
            if held and chars + len(one) + 2 > ARRAY_CHARS:
                yield whole()
                held, chars = [], 0
            held.append(one)
            chars += len(one) + 1
    if held:
        yield whole()


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS reference, CAST(length(text) AS INT) AS chars, "
    "md5(text) AS digest FROM documents"
)
def ingest_json_array(spark, sf_dir):
    """Files that hold one array of objects each, of ARRAY_CHARS at most."""
    path = scratch_path(spark, "json-array")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("input_raw"), F.col("lang").alias("reference")
    )
    rows.mapInArrow(_arrays, "value string").write.option("maxRecordsPerFile", 1).text(path)
    mapping = {c: c for c in ("id", "input_raw", "reference")}
    return _whole(read_dataset(spark, path, "json", mapping, mode="split")).select(*_shape())


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS id, concat('[\"', lang, '\",\"', source, '\"]') "
    "AS reference, CAST(length(text) AS INT) AS chars, md5(text) AS digest FROM documents"
)
def ingest_json(spark, sf_dir):
    path = scratch_path(spark, "json")
    table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("input_raw"),
        F.array("lang", "source").alias("reference"),
    ).write.json(path)
    mapping = {c: c for c in ("id", "input_raw", "reference")}
    return _whole(read_dataset(spark, path, "jsonl", mapping, mode="split")).select(*_shape())


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS reference, CAST(length(text) AS INT) AS chars, "
    "md5(text) AS digest FROM documents"
)
def ingest_parquet(spark, sf_dir):
    # The first three columns in order are the default mapping.
    rows = read_dataset(spark, f"{sf_dir}/documents.parquet", "parquet", mode="split")
    return _whole(rows).select(*_shape())


@query(
    sql(
        """SELECT problem, count(*) AS n FROM (SELECT CASE
  WHEN id = '' THEN 'id is empty'
  WHEN input_raw IS NULL THEN 'input_raw is missing'
  WHEN input_raw = '' THEN 'input_raw is empty'
  WHEN reference = '' THEN 'reference is empty' ELSE 'none' END AS problem FROM fx_upload)
GROUP BY problem""",
        "fx_upload",
    )
)
def upload_problems(spark, sf_dir):
    good, bad = validate_rows(fx.upload(spark, sf_dir), mode="split")
    found = bad.select("problem").union(good.select(F.lit("none").alias("problem")))
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    sql(
        "SELECT id, count(*) AS n FROM fx_upload GROUP BY id HAVING count(*) > 1", "fx_upload"
    )
)
def upload_duplicate_ids(spark, sf_dir):
    return duplicate_ids(fx.upload(spark, sf_dir))


@query(
    "SELECT CAST(event_id AS VARCHAR) AS id, concat('[', user_id, ',', event_id, ']') "
    "AS reference FROM events"
)
def reference_arrays(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.array("user_id", "event_id").alias("reference")
    )
    return normalize_reference(rows)


@query(
    sql(
        "SELECT id, output FROM fx_label_outputs WHERE inference_id = 'run2'",
        "fx_label_outputs",
    )
)
def stored_outputs(spark, sf_dir):
    path = scratch_path(spark, "outputs")
    write_scores(fx.label_outputs(spark, sf_dir).select(*OUTPUTS.fieldNames()), path)
    return load_outputs(spark, path, OUTPUTS).filter(F.col("inference_id") == "run2").select(
        "id", "output"
    )


@query("SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents")
def resume_from_nothing(spark, sf_dir):
    from scoreframe.operators.views import pending_rows

    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "lang"
    )
    return pending_rows(docs, empty_table(spark, OUTPUTS))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(n_chars AS VARCHAR) AS n_chars, lang, "
       "md5(text) AS digest FROM documents")
def json_export(spark, sf_dir):
    path = scratch_path(spark, "export")
    export_json(table(spark, sf_dir, "documents"), path)
    return spark.read.json(path).select("doc_id", "n_chars", "lang", F.md5("text").alias("digest"))


@query("SELECT r_name AS provider, n_name AS model FROM region JOIN nation "
       "ON r_regionkey = n_regionkey JOIN (SELECT DISTINCT c_nationkey FROM customer) "
       "ON c_nationkey = n_nationkey")
def registry_scan(spark, sf_dir):
    path = scratch_path(spark, "registry")
    for name in ("region", "nation", "customer"):
        table(spark, sf_dir, name).write.parquet(f"{path}/{name}")
    t = load_registry(spark, path, ("region", "nation", "customer"))
    used = t["customer"].select(F.col("c_nationkey").alias("n_nationkey"))
    return (
        t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .join(used, "n_nationkey", "left_semi")
        .select(F.col("r_name").alias("provider"), F.col("n_name").alias("model"))
    )
