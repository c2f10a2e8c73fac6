"""Evaluation-shaped inputs derived from the given tables.

Each fixture exists twice: a DataFrame function for Spark and SQL for the
oracle, written separately so that one checks the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scoreframe.plans.scale import balance

from .base import table

RUNS = ("run1", "run2", "run3")
CLASSES = ("treatment", "diagnosis", "prevention", "mechanism")
SCORE_METRICS = ("rouge1", "rougeL", "meteor")


def _numbers(values) -> F.Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def _with_runs(df: DataFrame) -> DataFrame:
    return df.withColumn("m", _numbers((1, 2, 3))).withColumn(
        "inference_id", F.concat(F.lit("run"), F.col("m").cast("string"))
    )


def _id() -> F.Column:
    return F.col("doc_id").cast("string").alias("id")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Yes/no dataset: ``id, doc_id, lang, reference``."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    marks = table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(marks, "doc_id").select(
        _id(), "doc_id", "lang",
        F.when(F.col("quality") == 1, "yes").otherwise("no").alias("reference"),
    )


def label_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs of yes/no answers with errors, blanks and wrong ones."""
    d, m = F.col("doc_id"), F.col("m")
    state = (d * 7 + m * 3) % 11
    yes = F.col("reference") == "yes"
    output = (
        F.when(state == 0, "[ERROR: Rate limit exceeded]")
        .when(state == 1, "   ")
        .when((d * 5 + m) % (m + 2) == 0, F.when(yes, " No. ").otherwise("Answer: YES"))
        .otherwise(F.when(yes, "answer: Yes!").otherwise("NO"))
    )
    return _with_runs(labels(spark, sf)).select(
        "id", "inference_id", "lang", "reference", output.alias("output")
    )


def choices(spark: SparkSession, sf: str) -> DataFrame:
    """Four-option answers of three runs."""
    d, m = F.col("doc_id"), F.col("m")
    slip = F.when(d % (m + 3) == 0, 1).otherwise(0)
    letter = F.upper(F.substring(F.lit("abcde"), (1 + (d + slip) % 4).cast("int"), F.lit(1)))
    output = F.when((d + m) % 9 == 0, "unsure").otherwise(
        F.concat(F.lit(" "), letter, F.lit(") because"))
    )
    docs = table(spark, sf, "documents").select("doc_id")
    return _with_runs(docs).select(
        _id(), "inference_id",
        F.substring(F.lit("abcd"), (1 + d % 4).cast("int"), F.lit(1)).alias("reference"),
        output.alias("output"),
    )


def multilabel(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")

    def named(pairs, sep):
        return F.concat_ws(sep, *[F.when(d % k == 0, name) for k, name in pairs])

    return table(spark, sf, "documents").select(
        _id(),
        named(((2, "treatment"), (3, "Diagnosis"), (5, "prevention")), ";").alias("reference"),
        named(((2, "Treatment"), (4, "diagnosis"), (7, "mechanism")), " and ").alias("output"),
    )


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Entity markup: ``id, output, reference``."""
    d = F.col("doc_id")
    first = F.concat(
        F.lit('<span class="Chemical">w0'), F.when(d % 2 == 1, " w1").otherwise(""),
        F.lit("</span> treats  pain"),
    )
    fenced = F.lit(
        '```html\na <span class="disease">b c</span> d '
        '<span class="chemical">e</span></span>\n```'
    )
    return table(spark, sf, "documents").select(
        _id(),
        F.when(d % 3 == 0, "no entity in this row").when(d % 3 == 1, first).otherwise(fenced)
        .alias("output"),
        F.when(d % 4 == 0, '[[0,0,"Chemical"]]').when(d % 4 == 1, '[[0,1,"chemical"]]')
        .otherwise('[[1,2,"Disease"],[3,3,"chemical"]]').alias("reference"),
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Generation pairs with real overlap: ``id, prediction, reference``."""
    text = F.col("text")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return balance(turns).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("id"),
        text.alias("reference"),
        F.concat(F.expr("substr(text, 11)"), F.lit(" "), F.substring(text, 1, 40))
        .alias("prediction"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Long scores with ties and nulls; run3 has no meteor."""
    d, m = F.col("doc_id"), F.col("m")
    value = ((d * (13 + m) + F.length("metric")) % 21).cast("double") / 20
    return (
        _with_runs(table(spark, sf, "documents").select("doc_id"))
        .withColumn("metric", _numbers(SCORE_METRICS))
        .filter(~((m == 3) & (F.col("metric") == "meteor")))
        .select(
            _id(), "inference_id", "metric",
            F.when((d + m) % 37 == 0, F.lit(None)).otherwise(value).alias("value"),
        )
    )


def evaluations(spark: SparkSession, sf: str) -> DataFrame:
    """One evaluation record per order.

    ``evaluation_id, inference_id, task, status, object_key, created_at,
    metrics, aggregate, total_examples``; the run is the customer.
    """
    key = F.col("o_orderkey")
    task = F.element_at(
        F.array(*map(F.lit, ("Generation", "Multiple Choice Questions", "Relation Extraction"))),
        (F.col("o_custkey") % 3 + 1).cast("int"),
    )
    status = (
        F.when(F.col("o_orderstatus") == "F", "done")
        .when(F.col("o_orderstatus") == "O", F.when(key % 2 == 0, "done").otherwise("pending"))
        .otherwise(F.when(key % 3 == 0, "failed").otherwise("done"))
    )
    value = F.col("o_totalprice")
    asked = F.when(
        key % 4 == 0, F.array(F.lit("accuracy"), F.lit("human_evaluation"))
    ).otherwise(F.array(F.lit("accuracy"), F.lit("rougeL")))
    return table(spark, sf, "orders").select(
        F.concat(F.lit("ev"), key.cast("string")).alias("evaluation_id"),
        F.concat(F.lit("run"), F.col("o_custkey").cast("string")).alias("inference_id"),
        task.alias("task"),
        status.alias("status"),
        F.when(key % 10 != 0, F.concat(key.cast("string"), F.lit(".parquet"))).alias(
            "object_key"
        ),
        F.when(key % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("created_at"),
        asked.alias("metrics"),
        F.create_map(
            F.lit("accuracy"), F.when(key % 17 == 0, F.lit(float("nan"))).otherwise(value),
            F.lit("rougeL"), value / 2,
        ).alias("aggregate"),
        (key % 5).cast("int").alias("total_examples"),
    )


def best(spark: SparkSession, sf: str) -> DataFrame:
    """Best values per run, one run per order priority and customer.

    ``inference_id, model_key, dataset, value``: the model is the supplier
    nation of a line, the dataset its return flag and line number.
    """
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linenumber", "l_quantity", "l_orderkey"
    )
    return lines.select(
        F.concat_ws("-", F.lit("run"), F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))
        .alias("inference_id"),
        F.concat(F.lit("prov::model"), (F.col("l_suppkey") % 12).cast("string")).alias(
            "model_key"
        ),
        F.concat_ws("-", "l_returnflag", F.col("l_linenumber").cast("string")).alias("dataset"),
        F.col("l_quantity").alias("value"),
    ).filter(~((F.col("model_key") == "prov::model3") & (F.col("dataset") == "N-1")))


def human_log(spark: SparkSession, sf: str) -> DataFrame:
    """Score changes; a null score deletes."""
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.concat(F.lit("ev"), (e % 3).cast("string")).alias("evaluation_id"),
        F.col("user_id").cast("string").alias("row_id"),
        e.alias("version"),
        F.when(F.col("event_type") != "error", (1 + e % 5).cast("int")).alias("score"),
    )


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token vectors, eight per text pair; even ones are the prediction."""
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.floor(v / 8).alias("id"),
        v.alias("pos"),
        F.when(v % 2 == 0, "pred").otherwise("ref").alias("side"),
        F.col("embedding").alias("vector"),
    )


def upload(spark: SparkSession, sf: str) -> DataFrame:
    """An upload with rows that must be rejected."""
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.when(d % 10 == 0, "").otherwise(d.cast("string")).alias("id"),
        F.when(d % 15 != 0, F.col("text")).alias("input_raw"),
        F.when(d % 21 == 0, "").otherwise(F.col("lang")).alias("reference"),
        F.col("source").alias("extra"),
    )


_SQL = {
    "fx_runs": ((), "SELECT unnest([1, 2, 3]) AS m"),
    "fx_labels": (
        (),
        """SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id, d.lang,
  CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS reference
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "fx_label_outputs": (
        ("fx_runs", "fx_labels"),
        """SELECT x.id, concat('run', r.m) AS inference_id, x.lang, x.reference,
  CASE WHEN (x.doc_id * 7 + r.m * 3) % 11 = 0 THEN '[ERROR: Rate limit exceeded]'
       WHEN (x.doc_id * 7 + r.m * 3) % 11 = 1 THEN '   '
       WHEN (x.doc_id * 5 + r.m) % (r.m + 2) = 0
         THEN CASE WHEN x.reference = 'yes' THEN ' No. ' ELSE 'Answer: YES' END
       ELSE CASE WHEN x.reference = 'yes' THEN 'answer: Yes!' ELSE 'NO' END
  END AS output
FROM fx_labels x CROSS JOIN fx_runs r""",
    ),
    "fx_label_scores": (
        ("fx_label_outputs",),
        """SELECT id, inference_id, lang, reference, output, parsed,
  CASE WHEN parsed = reference THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy
FROM (SELECT *, CASE WHEN contains(lower(output), 'yes') THEN 'yes'
                     WHEN contains(lower(output), 'no') THEN 'no'
                     WHEN contains(lower(output), 'maybe') THEN 'maybe'
                     ELSE 'missing' END AS parsed FROM fx_label_outputs)""",
    ),
    "fx_choices": (
        ("fx_runs",),
        """SELECT CAST(d.doc_id AS VARCHAR) AS id, concat('run', r.m) AS inference_id,
  substr('abcd', CAST(1 + d.doc_id % 4 AS INT), 1) AS reference,
  CASE WHEN (d.doc_id + r.m) % 9 = 0 THEN 'unsure'
       ELSE concat(' ', upper(substr('abcde', CAST(1 + (d.doc_id
         + CASE WHEN d.doc_id % (r.m + 3) = 0 THEN 1 ELSE 0 END) % 4 AS INT), 1)), ') because')
  END AS output
FROM documents d CROSS JOIN fx_runs r""",
    ),
    "fx_multilabel": (
        (),
        """SELECT CAST(doc_id AS VARCHAR) AS id, doc_id,
  concat_ws(';', CASE WHEN doc_id % 2 = 0 THEN 'treatment' END,
    CASE WHEN doc_id % 3 = 0 THEN 'Diagnosis' END,
    CASE WHEN doc_id % 5 = 0 THEN 'prevention' END) AS reference,
  concat_ws(' and ', CASE WHEN doc_id % 2 = 0 THEN 'Treatment' END,
    CASE WHEN doc_id % 4 = 0 THEN 'diagnosis' END,
    CASE WHEN doc_id % 7 = 0 THEN 'mechanism' END) AS output
FROM documents""",
    ),
    # Class bits by arithmetic on the id, so the oracle parses nothing.
    "fx_bits": (
        (),
        """SELECT CAST(doc_id AS VARCHAR) AS id, k AS pos,
  CASE k WHEN 0 THEN (doc_id % 2 = 0) WHEN 1 THEN (doc_id % 4 = 0)
         WHEN 2 THEN FALSE ELSE (doc_id % 7 = 0) END::INT AS p,
  CASE k WHEN 0 THEN (doc_id % 2 = 0) WHEN 1 THEN (doc_id % 3 = 0)
         WHEN 2 THEN (doc_id % 5 = 0) ELSE FALSE END::INT AS r
FROM documents, (SELECT unnest([0, 1, 2, 3]) AS k)""",
    ),
    # The spans the markup stands for, so the oracle parses no markup.
    "fx_spans": (
        (),
        """SELECT CAST(doc_id AS VARCHAR) AS id,
  CASE WHEN doc_id % 3 = 0 THEN '[]'
       WHEN doc_id % 3 = 1 THEN concat('[[0, ', doc_id % 2, ', "chemical"]]')
       ELSE '[[1, 2, "disease"], [4, 4, "chemical"]]' END AS parsed,
  CASE WHEN doc_id % 4 = 0 THEN '[[0, 0, "chemical"]]'
       WHEN doc_id % 4 = 1 THEN '[[0, 1, "chemical"]]'
       ELSE '[[1, 2, "disease"], [3, 3, "chemical"]]' END AS reference
FROM documents""",
    ),
    "fx_span_rows": (
        ("fx_spans",),
        """SELECT id, 'pred' AS side, unnest(CASE parsed WHEN '[]' THEN []
    WHEN '[[0, 0, "chemical"]]' THEN ['0|0|chemical']
    WHEN '[[0, 1, "chemical"]]' THEN ['0|1|chemical']
    ELSE ['1|2|disease', '4|4|chemical'] END) AS span FROM fx_spans
UNION ALL
SELECT id, 'ref', unnest(CASE reference WHEN '[[0, 0, "chemical"]]' THEN ['0|0|chemical']
    WHEN '[[0, 1, "chemical"]]' THEN ['0|1|chemical']
    ELSE ['1|2|disease', '3|3|chemical'] END) FROM fx_spans""",
    ),
    "fx_text": (
        (),
        """SELECT concat(conv_id, '-', turn) AS id, text AS reference,
  concat(substr(text, 11), ' ', substr(text, 1, 40)) AS prediction
FROM conversations""",
    ),
    "fx_scores": (
        ("fx_runs",),
        """SELECT CAST(d.doc_id AS VARCHAR) AS id, concat('run', r.m) AS inference_id, k.metric,
  CASE WHEN (d.doc_id + r.m) % 37 = 0 THEN NULL
       ELSE CAST((d.doc_id * (13 + r.m) + length(k.metric)) % 21 AS DOUBLE) / 20 END AS value
FROM documents d CROSS JOIN fx_runs r
CROSS JOIN (SELECT unnest(['rouge1', 'rougeL', 'meteor']) AS metric) k
WHERE NOT (r.m = 3 AND k.metric = 'meteor')""",
    ),
    "fx_evaluations": (
        (),
        """SELECT concat('ev', o_orderkey) AS evaluation_id, concat('run', o_custkey) AS inference_id,
  CASE o_custkey % 3 WHEN 0 THEN 'Generation' WHEN 1 THEN 'Multiple Choice Questions'
    ELSE 'Relation Extraction' END AS task,
  CASE WHEN o_orderstatus = 'F' THEN 'done'
       WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'pending' END
       ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'done' END END AS status,
  CASE WHEN o_orderkey % 10 <> 0 THEN concat(o_orderkey, '.parquet') END AS object_key,
  CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS created_at,
  o_orderkey % 4 = 0 AS wants_human,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS accuracy,
  o_totalprice / 2 AS rougel,
  CAST(o_orderkey % 5 AS INT) AS total_examples
FROM orders""",
    ),
    "fx_best": (
        (),
        """SELECT * FROM (SELECT
  concat_ws('-', 'run', l_orderkey, l_linenumber, l_suppkey) AS inference_id,
  concat('prov::model', l_suppkey % 12) AS model_key,
  concat(l_returnflag, '-', l_linenumber) AS dataset, l_quantity AS value
FROM lineitem) WHERE NOT (model_key = 'prov::model3' AND dataset = 'N-1')""",
    ),
    "fx_human_log": (
        (),
        """SELECT concat('ev', event_id % 3) AS evaluation_id, CAST(user_id AS VARCHAR) AS row_id,
  event_id AS version,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(1 + event_id % 5 AS INT) END AS score
FROM events""",
    ),
    "fx_human_state": (
        ("fx_human_log",),
        """SELECT evaluation_id, row_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY evaluation_id, row_id ORDER BY version DESC) AS k
  FROM fx_human_log) WHERE k = 1 AND score IS NOT NULL""",
    ),
    "fx_tokens": (
        (),
        """SELECT CAST(floor(vec_id / 8) AS BIGINT) AS id, vec_id AS pos,
  CASE WHEN vec_id % 2 = 0 THEN 'pred' ELSE 'ref' END AS side,
  CAST(embedding AS DOUBLE[]) AS vector
FROM embeddings""",
    ),
    "fx_upload": (
        (),
        """SELECT CASE WHEN doc_id % 10 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS id,
  CASE WHEN doc_id % 15 <> 0 THEN text END AS input_raw,
  CASE WHEN doc_id % 21 = 0 THEN '' ELSE lang END AS reference, source AS extra
FROM documents""",
    ),
}


def sql(body: str, *names: str, **extra: str) -> str:
    """A query text headed by the fixtures it names (and what those need)."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _SQL[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({_SQL[n][1]})" for n in order]
    parts += [f"{n} AS ({text})" for n, text in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
