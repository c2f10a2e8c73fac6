"""Row accuracies, corpus metrics and whole evaluations."""

from pyspark.sql import functions as F

from scoreframe.functions import parsers as P
from scoreframe.functions.registry import ParserSpec, register_metric
from scoreframe.functions.scores import accuracy, accuracy_spans, accuracy_vector
from scoreframe.operators import corpus as C
from scoreframe.plans.scale import scratch_path
from scoreframe.plans.scoring import ScoringPlan, corpus_scores, evaluate, score_rows
from scoreframe.sources import storage

from . import fixtures as fx
from .base import ORACLE, query, table
from .fixtures import CLASSES, sql

YES_NO = ScoringPlan("mcq", ("accuracy",), (ParserSpec("process_mcq_yes_no_maybe"),))


def scored_labels(spark, sf_dir):
    return fx.label_outputs(spark, sf_dir).withColumn(
        "parsed", P.parse_keyword("output", ("yes", "no", "maybe"))
    )


@query(
    sql(
        """SELECT inference_id, lang, round(avg(accuracy), 9) AS accuracy, count(*) AS n
FROM fx_label_scores GROUP BY inference_id, lang""",
        "fx_label_scores",
    )
)
def accuracy_by_lang(spark, sf_dir):
    rows = score_rows(fx.label_outputs(spark, sf_dir), YES_NO)
    return C.mean_metrics(rows, ["inference_id", "lang"], ["accuracy"]).select(
        "inference_id", "lang", F.round("value", 9).alias("accuracy"), "n"
    )


@query(
    sql(
        """SELECT inference_id, metric, round(avg(value), 9) AS value, count(value) AS n
FROM fx_scores GROUP BY inference_id, metric""",
        "fx_scores",
    )
)
def aggregate_metrics(spark, sf_dir):
    return C.aggregate_metrics(fx.scores(spark, sf_dir), ["inference_id"]).withColumn(
        "value", F.round("value", 9)
    )


def _f1_sql(by: str) -> str:
    return f"""SELECT {by}, round(avg(f1), 9) AS macro_f1,
  round(sum(f1 * support) / sum(support), 9) AS weighted_f1
FROM (SELECT {by}, label, sum(support) AS support,
        2.0 * sum(hits) / sum(support + predicted) AS f1
  FROM (SELECT {by}, reference AS label, 1 AS support, 0 AS predicted,
          CASE WHEN reference = parsed THEN 1 ELSE 0 END AS hits FROM rows
        UNION ALL SELECT {by}, parsed, 0, 1, 0 FROM rows)
  GROUP BY {by}, label) GROUP BY {by}"""


@query(
    sql(
        _f1_sql("inference_id"), "fx_choices",
        rows="""SELECT inference_id, reference, CASE WHEN output = 'unsure' THEN 'missing'
  WHEN contains('abcd', substr(trim(lower(output)), 1, 1)) THEN substr(trim(lower(output)), 1, 1)
  ELSE 'missing' END AS parsed FROM fx_choices""",
    )
)
def f1_labels(spark, sf_dir):
    rows = fx.choices(spark, sf_dir).withColumn("parsed", P.parse_choice("output", "abcd"))
    out = C.f1_labels(rows, by=["inference_id"])
    return out.select(
        "inference_id", F.round("macro_f1", 9).alias("macro_f1"),
        F.round("weighted_f1", 9).alias("weighted_f1"),
    )


@query(
    sql(
        _f1_sql("inference_id, lang"), "fx_label_scores",
        rows="SELECT inference_id, lang, reference, parsed FROM fx_label_scores",
    )
)
def f1_labels_by_lang(spark, sf_dir):
    out = C.f1_labels(scored_labels(spark, sf_dir), by=["inference_id", "lang"])
    return out.select(
        "inference_id", "lang", F.round("macro_f1", 9).alias("macro_f1"),
        F.round("weighted_f1", 9).alias("weighted_f1"),
    )


@query(
    sql(
        """SELECT label, CAST(sum(support) AS BIGINT) AS support,
  CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(hits) AS BIGINT) AS hits
FROM (SELECT reference AS label, 1 AS support, 0 AS predicted,
        CASE WHEN reference = parsed THEN 1 ELSE 0 END AS hits FROM fx_label_scores
      UNION ALL SELECT parsed, 0, 1, 0 FROM fx_label_scores) GROUP BY label""",
        "fx_label_scores",
    )
)
def label_universe(spark, sf_dir):
    return C.label_counts(scored_labels(spark, sf_dir))


@query(
    sql(
        """SELECT round(avg(f1), 9) AS macro_f1,
  round(sum(f1 * support) / sum(support), 9) AS weighted_f1
FROM (SELECT pos, sum(r) AS support,
  coalesce(2.0 * sum(p * r) / nullif(sum(p) + sum(r), 0), 0) AS f1 FROM fx_bits GROUP BY pos)""",
        "fx_bits",
    )
)
def f1_multilabel(spark, sf_dir):
    rows = fx.multilabel(spark, sf_dir).select(
        P.multi_hot(P.parse_labels("output", CLASSES), CLASSES).alias("parsed_vector"),
        P.multi_hot("reference", CLASSES).alias("reference_vector"),
    )
    out = C.f1_multilabel(rows)
    return out.select(
        F.round("macro_f1", 9).alias("macro_f1"), F.round("weighted_f1", 9).alias("weighted_f1")
    )


@query(
    sql(
        """SELECT shared, predicted, expected, round(shared / predicted, 9) AS p,
  round(shared / expected, 9) AS r, round(2.0 * shared / (predicted + expected), 9) AS f1
FROM (SELECT count(*) FILTER (side = 'pred') AS predicted,
  count(*) FILTER (side = 'ref') AS expected FROM fx_span_rows),
 (SELECT count(*) AS shared FROM fx_span_rows a JOIN fx_span_rows b
  ON a.id = b.id AND a.span = b.span AND a.side = 'pred' AND b.side = 'ref')""",
        "fx_span_rows",
    )
)
def exact_match(spark, sf_dir):
    rows = fx.spans(spark, sf_dir).select(
        P.extract_spans("output").alias("parsed_spans"),
        P.lower_spans(P.spans_from_json("reference")).alias("reference_spans"),
    )
    return C.exact_match(rows).select(
        "shared", "predicted", "expected",
        F.round("exact_match_precision", 9).alias("p"),
        F.round("exact_match_recall", 9).alias("r"),
        F.round("exact_match_f1", 9).alias("f1"),
    )


@query(
    sql(
        "SELECT id, CASE WHEN parsed = reference THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM fx_spans",
        "fx_spans",
    )
)
def span_accuracy(spark, sf_dir):
    parsed = P.sort_spans(P.extract_spans("output"))
    wanted = P.lower_spans(P.spans_from_json("reference"))
    return fx.spans(spark, sf_dir).select("id", accuracy_spans(parsed, wanted).alias("value"))


@query(
    sql(
        "SELECT id, CASE WHEN bool_and(p = r) THEN 1.0 ELSE 0.0 END::DOUBLE AS value "
        "FROM fx_bits GROUP BY id",
        "fx_bits",
    )
)
def vector_accuracy(spark, sf_dir):
    parsed = P.multi_hot(P.parse_labels("output", CLASSES), CLASSES)
    wanted = P.multi_hot("reference", CLASSES)
    return fx.multilabel(spark, sf_dir).select(
        "id", accuracy_vector(parsed, wanted).alias("value")
    )


@query(
    "SELECT doc_id, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM documents"
)
def label_accuracy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", accuracy(F.upper(F.concat(F.lit("\t"), "lang")), F.lit("En ")).alias("value")
    )


@query(
    sql(
        """SELECT inference_id, 'accuracy' AS metric, round(avg(accuracy), 9) AS value
FROM fx_label_scores GROUP BY inference_id
UNION ALL SELECT inference_id, unnest(['macro_f1', 'weighted_f1']),
  unnest([macro_f1, weighted_f1]) FROM f1""",
        "fx_label_scores",
        rows="SELECT inference_id, reference, parsed FROM fx_label_scores",
        f1=_f1_sql("inference_id"),
    )
)
def evaluate_choices(spark, sf_dir):
    outputs = fx.label_outputs(spark, sf_dir).select("inference_id", "id", "output")
    plan = YES_NO._replace(metrics=("accuracy", "macro_f1", "weighted_f1"))
    done = evaluate(fx.labels(spark, sf_dir), outputs, plan, scratch_path(spark, "scores"))
    return done.aggregates.withColumn("value", F.round("value", 9))


@query(ORACLE["evaluate_choices"])
def evaluate_resumed(spark, sf_dir):
    """A run that broke off after some outputs goes on with the others."""
    outputs = fx.label_outputs(spark, sf_dir).select("inference_id", "id", "output")
    labels, path = fx.labels(spark, sf_dir), scratch_path(spark, "scores")
    plan = YES_NO._replace(metrics=("accuracy", "macro_f1", "weighted_f1"))
    early = F.col("id").cast("long") % 3 == 0
    evaluate(labels.filter(early), outputs.filter(early), plan, path, resume=True)
    done = evaluate(labels, outputs, plan, path, resume=True)
    return done.aggregates.withColumn("value", F.round("value", 9))


@query(
    sql(
        """SELECT r.*, round(a.accuracy, 9) AS accuracy FROM (
  SELECT inference_id, (SELECT count(*) FROM fx_labels) AS dataset_rows, count(*) AS output_rows,
    (SELECT count(*) FROM fx_labels) - count(DISTINCT CASE WHEN known THEN id END) AS missing,
    count(*) FILTER (NOT known) AS unknown, count(*) - count(DISTINCT id) AS duplicate_outputs,
    0::BIGINT AS duplicate_ids,
    count(*) = (SELECT count(*) FROM fx_labels) AND count(DISTINCT id) = count(*)
      AND bool_and(known) AS aligned
  FROM (SELECT *, id IN (SELECT id FROM fx_labels) AS known FROM broken) GROUP BY inference_id) r
JOIN (SELECT inference_id, sum(CASE WHEN inference_id = 'run2' AND doc_id % 10 = 0 THEN 0.0
    ELSE accuracy END) / (SELECT count(*) FROM fx_labels) AS accuracy
  FROM (SELECT *, CAST(id AS BIGINT) AS doc_id FROM fx_label_scores) GROUP BY inference_id) a
  USING (inference_id)""",
        "fx_labels", "fx_label_scores",
        broken="""SELECT inference_id, id FROM (SELECT *, CAST(id AS BIGINT) AS d FROM fx_label_outputs)
  WHERE NOT (inference_id = 'run2' AND d % 10 = 0)
  UNION ALL SELECT inference_id, id FROM fx_label_outputs
    WHERE inference_id = 'run3' AND CAST(id AS BIGINT) % 7 = 0
  UNION ALL SELECT inference_id, 'x' || id FROM fx_label_outputs
    WHERE inference_id = 'run3' AND CAST(id AS BIGINT) % 11 = 0""",
    )
)
def evaluate_misaligned(spark, sf_dir):
    """Missing, repeated and unknown ids are reported; scores cover the whole dataset."""
    outputs = fx.label_outputs(spark, sf_dir).select("inference_id", "id", "output")
    d, run = F.col("id").cast("long"), F.col("inference_id")
    broken = (
        outputs.filter(~((run == "run2") & (d % 10 == 0)))
        .unionByName(outputs.filter((run == "run3") & (d % 7 == 0)))
        .unionByName(
            outputs.filter((run == "run3") & (d % 11 == 0))
            .withColumn("id", F.concat(F.lit("x"), "id"))
        )
    )
    done = evaluate(fx.labels(spark, sf_dir), broken, YES_NO, on_misaligned="report")
    accuracy = done.aggregates.filter("metric = 'accuracy'").select(
        "inference_id", F.round("value", 9).alias("accuracy")
    )
    return done.alignment.join(accuracy, "inference_id")


@query(
    sql(
        """SELECT metric, round(value, 9) AS value FROM (
  SELECT unnest(['exact_match_f1', 'accuracy', 'share_empty']) AS metric,
    unnest([2.0 * s / (np + nr), acc, empty]) AS value
  FROM (SELECT count(*) FILTER (side = 'pred') AS np, count(*) FILTER (side = 'ref') AS nr
        FROM fx_span_rows),
   (SELECT count(*) AS s FROM fx_span_rows a JOIN fx_span_rows b
    ON a.id = b.id AND a.span = b.span AND a.side = 'pred' AND b.side = 'ref'),
   (SELECT avg(CASE WHEN parsed = reference THEN 1.0 ELSE 0.0 END) AS acc,
      avg(CASE WHEN parsed = '[]' THEN 1.0 ELSE 0.0 END) AS empty FROM fx_spans))""",
        "fx_spans", "fx_span_rows",
    )
)
def evaluate_entities(spark, sf_dir):
    # share_empty is a user-defined row metric.
    register_metric("share_empty", row=lambda p, r: (p == "[]").cast("double"))
    rows = fx.spans(spark, sf_dir).withColumn("inference_id", F.lit("run1"))
    done = evaluate(
        rows.select("id", "reference"), rows.select("inference_id", "id", "output"),
        ScoringPlan("ner", ("exact_match_f1", "accuracy", "share_empty")),
    )
    return done.aggregates.select("metric", F.round("value", 9).alias("value"))


@query(
    sql(
        """SELECT metric, round(value, 9) AS value FROM (
  SELECT unnest(['macro_f1', 'accuracy', 'rows']) AS metric,
         unnest([macro, acc, n]) AS value
  FROM (SELECT avg(f1) AS macro FROM (SELECT pos,
      coalesce(2.0 * sum(p * r) / nullif(sum(p) + sum(r), 0), 0) AS f1 FROM fx_bits GROUP BY pos)),
   (SELECT avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS acc, CAST(count(*) AS DOUBLE) AS n
    FROM (SELECT id, bool_and(p = r) AS ok FROM fx_bits GROUP BY id)))""",
        "fx_bits",
    )
)
def evaluate_multilabel(spark, sf_dir):
    # rows is a user-defined corpus metric.
    register_metric(
        "rows",
        corpus=lambda df, by: df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("value")),
    )
    rows = fx.multilabel(spark, sf_dir).withColumn("inference_id", F.lit("run1"))
    plan = ScoringPlan("mlc", ("macro_f1", "accuracy", "rows"), classes=CLASSES)
    scored = score_rows(rows, plan)
    return corpus_scores(scored, plan).select("metric", F.round("value", 9).alias("value"))


_HUMAN = """SELECT e.evaluation_id, round(avg(s.score), 9) AS human_evaluation_mean,
  count(s.score) AS human_evaluation_count
FROM (SELECT DISTINCT evaluation_id FROM fx_human_log UNION SELECT 'ev-none') e
LEFT JOIN fx_human_state s ON e.evaluation_id = s.evaluation_id GROUP BY e.evaluation_id"""


def _human(spark, sf_dir):
    from scoreframe.operators.annotations import SCORE_KEYS, apply_changes

    log = fx.human_log(spark, sf_dir)
    state = apply_changes(None, log, SCORE_KEYS, ["score"])
    every = log.select("evaluation_id").distinct().union(
        spark.createDataFrame([("ev-none",)], "evaluation_id string")
    )
    return C.human_aggregate(state, every), every


@query(sql(_HUMAN, "fx_human_log", "fx_human_state"))
def human_aggregate(spark, sf_dir):
    return _human(spark, sf_dir)[0].withColumn(
        "human_evaluation_mean", F.round("human_evaluation_mean", 9)
    )


@query(
    sql(
        """SELECT evaluation_id, metric, value FROM (
  SELECT evaluation_id, 'accuracy' AS metric, 0.5::DOUBLE AS value FROM human
  UNION ALL SELECT evaluation_id, 'human_evaluation_mean', human_evaluation_mean FROM human
    WHERE evaluation_id <> 'ev1' AND human_evaluation_mean IS NOT NULL
  UNION ALL SELECT evaluation_id, 'human_evaluation_count', human_evaluation_count FROM human
    WHERE evaluation_id <> 'ev1')""",
        "fx_human_log", "fx_human_state", human=_HUMAN,
    )
)
def with_human(spark, sf_dir):
    human, every = _human(spark, sf_dir)
    asked = F.when(F.col("evaluation_id") == "ev1", F.array(F.lit("accuracy"))).otherwise(
        F.array(F.lit("accuracy"), F.lit("human_evaluation"))
    )
    evals = every.select(
        "evaluation_id", asked.alias("metrics"),
        F.create_map(F.lit("accuracy"), F.lit(0.5)).alias("aggregate"),
    )
    return C.with_human(evals, human).select(
        "evaluation_id", F.explode("aggregate").alias("metric", "value")
    ).withColumn("value", F.round("value", 9))


@query(
    """SELECT concat('run', o_custkey) AS inference_id, count(*) AS total,
  count(*) FILTER (o_orderstatus = 'F') AS processed,
  CAST(round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*)) AS INT) AS percent
FROM orders GROUP BY o_custkey"""
)
def run_progress(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    run = F.concat(F.lit("run"), F.col("o_custkey").cast("string")).alias("inference_id")
    dataset = orders.select(F.col("o_custkey").alias("dataset_id"))
    runs = orders.select(run, F.col("o_custkey").alias("dataset_id")).distinct()
    outputs = orders.filter(F.col("o_orderstatus") == "F").select(run)
    return C.run_progress(runs, dataset, outputs)


@query(
    "SELECT lang, count(*) AS n FROM documents WHERE source IN ('src0', 'src3', 'src5') "
    "GROUP BY lang"
)
def facet_counts(spark, sf_dir):
    from scoreframe.operators.views import facet_filter

    docs = facet_filter(table(spark, sf_dir, "documents"), "source", ["src0", "src3", "src5"])
    return C.facet_counts(docs, "lang")


@query(
    """SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents
WHERE source IN ('src0', 'src3', 'src5') GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM documents WHERE lang IN ('en', 'de') GROUP BY source
UNION ALL SELECT 'long', CAST(n_chars > 1000 AS VARCHAR), count(*) FROM documents
WHERE source IN ('src0', 'src3', 'src5') AND lang IN ('en', 'de') GROUP BY n_chars > 1000"""
)
def facets(spark, sf_dir):
    """All facets in one pass, each under the choices of the others."""
    docs = table(spark, sf_dir, "documents").withColumn("long", F.col("n_chars") > 1000)
    return C.facets(docs, ["lang", "source", "long"], {"source": ["src0", "src3", "src5"], "lang": ["en", "de"]})


@query("SELECT DISTINCT source FROM documents")
def distinct_sorted(spark, sf_dir):
    return C.distinct_sorted(table(spark, sf_dir, "documents"), "source")


@query(
    sql(
        """SELECT inference_id, id, output FROM fx_label_outputs
WHERE inference_id <> 'run2' AND NOT (inference_id = 'run1' AND CAST(id AS BIGINT) % 5 = 0)""",
        "fx_label_outputs",
    )
)
def delete_rows(spark, sf_dir):
    """A whole run and some rows of another leave a stored table; other folders stay."""
    path = scratch_path(spark, "outputs")
    outputs = fx.label_outputs(spark, sf_dir).select("inference_id", "id", "output")
    storage.write_scores(outputs, path)
    some = (F.col("inference_id") == "run1") & (F.col("id").cast("long") % 5 == 0)
    gone = outputs.filter(some).select("inference_id", "id").unionByName(
        spark.createDataFrame([("run2", None)], "inference_id string, id string"))
    storage.delete_rows(spark, path, gone)
    return spark.read.parquet(path)
