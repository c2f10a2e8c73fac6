"""Prompts, filters, reshaping, joins, paging and display."""

from pyspark.sql import functions as F

from scoreframe.functions import metricmaps as M
from scoreframe.operators import textindex, views as V
from scoreframe.operators.views import Condition
from scoreframe.plans.scale import balance, scratch_path
from scoreframe.sources import storage

from . import fixtures as fx
from .base import query, table
from .fixtures import RUNS, sql


def _dataset(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("input"),
        F.col("lang").alias("reference"),
    )


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS id, md5('Text: ' || text || chr(10) || 'Again: ' || text "
    "|| ' $1 \\n') AS digest, TRUE AS usable FROM documents"
)
def render_prompt(spark, sf_dir):
    template = "Text: {{input}}\nAgain: {{input}} $1 \\n"
    return V.render_prompt(_dataset(spark, sf_dir), template).select(
        "id", F.md5("prompt").alias("digest"), V.has_placeholder(F.lit(template)).alias("usable")
    )


@query(
    sql(
        "SELECT id, md5('Rate correctness 1-5 ' || reference || ' / ' || trim(prediction, "
        "' ' || chr(10) || chr(13) || chr(9))) AS digest FROM fx_text",
        "fx_text",
    )
)
def render_judge_prompt(spark, sf_dir):
    rows = fx.texts(spark, sf_dir).withColumnRenamed("prediction", "output")
    template = "Rate {{criterion}} 1-{{scale}} {{reference}} / {{output}}"
    return V.render_judge_prompt(rows, template, "correctness").select(
        "id", F.md5("judge_prompt").alias("digest")
    )


@query(
    sql(
        """SELECT id, inference_id FROM (
  SELECT id, inference_id, max(value) FILTER (metric = 'rouge1') AS r1,
    max(value) FILTER (metric = 'meteor') AS me FROM fx_scores GROUP BY id, inference_id)
WHERE r1 >= 0.35 AND me <> 0.5""",
        "fx_scores",
    )
)
def filter_one_run(spark, sf_dir):
    rows = V.metrics_to_map(fx.scores(spark, sf_dir))
    kept = V.filter_by_metrics(
        rows, [Condition("rouge1", ">=", 0.35), Condition("meteor", "!=", 0.5)]
    )
    return kept.select("id", "inference_id")


_WIDE = """SELECT o.id, o1, o2, o3, p1, r1, r2, r3 FROM (
  SELECT id, max(output) FILTER (inference_id = 'run1') AS o1,
    max(output) FILTER (inference_id = 'run2') AS o2,
    max(output) FILTER (inference_id = 'run3') AS o3, count(DISTINCT inference_id) AS n
  FROM fx_label_outputs
  WHERE NOT (inference_id = 'run2' AND output = '   ') GROUP BY id) o
LEFT JOIN (SELECT id, parsed AS p1 FROM fx_label_scores WHERE inference_id = 'run1') p USING (id)
LEFT JOIN (SELECT id, max(value) FILTER (inference_id = 'run1') AS r1,
    max(value) FILTER (inference_id = 'run2') AS r2,
    max(value) FILTER (inference_id = 'run3') AS r3
  FROM fx_scores WHERE metric = 'rouge1' GROUP BY id) s USING (id)
WHERE n = 3"""


def _compare(spark, sf_dir):
    outputs = fx.label_outputs(spark, sf_dir)
    # One run has gaps, so inner-join meaning shows.
    present = outputs.filter(
        ~((F.col("inference_id") == "run2") & (F.col("output") == "   "))
    )
    from scoreframe.functions.parsers import parse_keyword

    parsed = outputs.withColumn("parsed", parse_keyword("output", ("yes", "no", "maybe")))
    return V.compare_view(
        fx.labels(spark, sf_dir).select("id", "reference"), present, fx.scores(spark, sf_dir),
        RUNS, ["rouge1", "rougeL"], parsed,
    )


@query(sql(_WIDE, "fx_label_scores", "fx_scores"))
def compare_view(spark, sf_dir):
    view = V.select_compare_columns(_compare(spark, sf_dir), ["rouge1"])
    return view.select(
        "id", F.col("run1Output").alias("o1"), F.col("run2Output").alias("o2"),
        F.col("run3Output").alias("o3"), F.col("run1Parsed").alias("p1"),
        *[F.col(f"`run{i}:rouge1`").alias(f"r{i}") for i in (1, 2, 3)],
    )


@query(
    sql(
        "SELECT id FROM wide WHERE r1 > 0.5 AND r3 <= 0.8",
        "fx_label_scores", "fx_scores", wide=_WIDE,
    )
)
def filter_many_runs(spark, sf_dir):
    return V.filter_by_metrics(
        _compare(spark, sf_dir),
        [Condition("rouge1", ">", 0.5, "run1"), Condition("rouge1", "<=", 0.8, "run3")],
    ).select("id")


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS reference FROM documents "
    "WHERE contains(lower(text), 'the') OR contains(lower(lang), 'the') "
    "OR contains(CAST(doc_id AS VARCHAR), 'the') "
    "ORDER BY lang DESC, id LIMIT 50 OFFSET 50"
)
def search_page(spark, sf_dir):
    found = V.search(_dataset(spark, sf_dir), "THE")
    ordered = V.sort_view(found.select("id", "reference"), "reference", ascending=False)
    return V.page(ordered, 1, 50)


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS reference FROM documents "
    "WHERE lang < 'es' OR (lang = 'es' AND CAST(doc_id AS VARCHAR) > '3') "
    "ORDER BY lang DESC, id LIMIT 50"
)
def search_after(spark, sf_dir):
    """The page that follows a row, without the pages before it."""
    rows = _dataset(spark, sf_dir).select("id", "reference")
    return V.page_after(rows, "reference", ("es", "3"), 50, ascending=False)


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS reference FROM documents "
    "ORDER BY lang DESC, id LIMIT 50 OFFSET 150"
)
def stored_page(spark, sf_dir):
    """A page by its number: only the range that holds it is read and sorted."""
    rows = _dataset(spark, sf_dir).select("id", "reference")
    path = scratch_path(spark, "view")
    storage.store_view(rows, path, "reference", ascending=False, ranges=16)
    return storage.stored_page(spark, path, rows.schema, "reference", 3, 50, ascending=False)


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest, lang AS reference FROM documents "
    "WHERE contains(lower(text), 'licensed under') OR contains(lower(lang), 'licensed under') "
    "OR contains(CAST(doc_id AS VARCHAR), 'licensed under')"
)
def search_indexed(spark, sf_dir):
    """A text in any column, by the trigrams of the stored table."""
    path = scratch_path(spark, "search")
    textindex.store_search_index(balance(_dataset(spark, sf_dir)), path, buckets=8)
    found = textindex.search_stored(spark, path, "Licensed UNDER")
    return found.select("id", F.md5("input").alias("digest"), "reference")


@query(
    sql(
        """SELECT inference_id AS evaluation_id, id, metric, round(value, 6) AS value, n
FROM fx_scores JOIN (SELECT inference_id, count(DISTINCT id) AS n FROM fx_scores
  GROUP BY inference_id) USING (inference_id) WHERE value IS NOT NULL""",
        "fx_scores",
    )
)
def nested_evaluations(spark, sf_dir):
    """Rows to wrapper rows in chunks of a hundred and back."""
    long = fx.scores(spark, sf_dir)
    rows = V.metrics_to_map(long).withColumnRenamed("inference_id", "evaluation_id")
    counts = rows.groupBy("evaluation_id").agg(
        F.count(F.lit(1)).cast("double").alias("value")
    ).withColumn("metric", F.lit("n"))
    nested = V.nest_evaluation(rows, counts, chunk_rows=100)
    totals = nested.groupBy("evaluation_id").agg(
        F.max(F.element_at("aggregate", "n")).cast("long").alias("n")
    )
    flat = V.unnest_evaluation(nested)
    return V.metrics_to_long(flat, ("evaluation_id", "id")).withColumn(
        "value", F.round("value", 6)
    ).join(totals, "evaluation_id")


@query(
    sql(
        "SELECT id, inference_id, metric, value FROM fx_scores WHERE value IS NOT NULL",
        "fx_scores",
    )
)
def metric_maps(spark, sf_dir):
    return V.metrics_to_long(V.metrics_to_map(fx.scores(spark, sf_dir)))


@query(
    """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS by_case,
  CASE WHEN event_id % 4 <> 0 THEN value END AS exact, CAST(NULL AS DOUBLE) AS absent,
  CASE WHEN event_id % 4 <> 0 THEN 2 ELSE 1 END AS size FROM events"""
)
def metric_values(spark, sf_dir):
    bad = F.col("event_id") % 4 == 0
    pairs = F.array(
        F.struct(F.lit("k").alias("key"),
                 F.get_json_object("props", "$.k").alias("value")),
        F.struct(F.lit("v").alias("key"),
                 F.when(bad, "Infinity").otherwise(F.col("value").cast("string"))
                 .alias("value")),
        F.struct(F.lit("w").alias("key"), F.lit("high").alias("value")),
    )
    raw = F.create_map(
        F.lit("k"), F.get_json_object("props", "$.k").cast("double"),
        F.lit("v"), F.when(bad, F.lit(float("nan"))).otherwise(F.col("value")),
    )
    events = table(spark, sf_dir, "events").select(
        "event_id", M.entries_to_aggregate(pairs).alias("entries"),
        raw.alias("raw"), M.clean_aggregate(raw).alias("clean"),
    )
    return events.select(
        "event_id",
        M.metric_value("entries", "K").alias("by_case"),
        M.metric_value("raw", "v").alias("exact"),
        M.metric_value("clean", "other").alias("absent"),
        F.size("clean").alias("size"),
    )


@query(
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ROUGE-1, ROUGE-L, BERTScore +1'
  WHEN 1 THEN 'no metrics' ELSE 'macro_f1, Human Score (Avg)' END AS summary,
  CASE lang WHEN 'en' THEN 'Exact Match F1' ELSE lang END AS label FROM documents"""
)
def metric_labels(spark, sf_dir):
    d = F.col("doc_id")

    def names(*values):
        return F.array(*[F.lit(v).cast("string") for v in values])

    chosen = (
        F.when(d % 3 == 0, names("rouge1", "rougeL", None, "", "BertScore", "meteor"))
        .when(d % 3 == 1, names(None))
        .otherwise(names("macro_f1", "human_evaluation_mean"))
    )
    named = F.when(F.col("lang") == "en", "EXACT_match_f1").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", M.metric_summary(chosen).alias("summary"), M.metric_label(named).alias("label")
    )


@query(
    """SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%b %d, %Y, %I:%M %p') || ' EST' AS winter,
  strftime(ts + INTERVAL 182 DAY - INTERVAL 4 HOUR, '%b %d, %Y, %I:%M %p') || ' EDT' AS summer,
  '-' AS bad FROM events"""
)
def created_times(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    later = F.date_format(F.col("ts") + F.expr("INTERVAL 182 DAY"), "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select(
        "event_id",
        M.format_created(stamp).alias("winter"),
        M.format_created(F.concat(later, F.lit("Z"))).alias("summer"),
        M.format_created(F.col("props")).alias("bad"),
    )


@query(
    """SELECT doc_id,
  md5(CASE WHEN on_ THEN substr(text, 1, greatest(s, 0)) ELSE text END) AS before,
  md5(CASE WHEN on_ THEN substr(text, greatest(s, 0) + 1, least(e, length(text))
    - greatest(s, 0)) ELSE '' END) AS marked,
  md5(CASE WHEN on_ THEN substr(text, least(e, length(text)) + 1) ELSE '' END) AS after
FROM (SELECT *, s < e AND s < length(text) AS on_ FROM (SELECT doc_id, text,
  doc_id % 60 - 5 AS s, doc_id % 60 + doc_id % 400 - 20 AS e FROM documents))"""
)
def apply_highlight(spark, sf_dir):
    d = F.col("doc_id")
    start, end = (d % 60 - 5).cast("int"), (d % 60 + d % 400 - 20).cast("int")
    cut = M.apply_highlight("text", start, end)
    return table(spark, sf_dir, "documents").select(
        "doc_id", *[F.md5(cut[p]).alias(p) for p in ("before", "marked", "after")]
    )


@query(
    """SELECT event_id, printf('%.4f', round(value, 4)) AS row_text,
  printf('%.2f', round(value, 2)) AS rank_text,
  CASE WHEN value = 0 THEN '0' ELSE rtrim(rtrim(printf('%.8f', round(value
    * pow(10, 3 - floor(log10(abs(value))))) / pow(10, 3 - floor(log10(abs(value))))), '0'), '.')
  END AS summary_text, '—' AS word FROM events"""
)
def format_metric(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        M.format_metric("value", "row").alias("row_text"),
        M.format_metric("value", "rank").alias("rank_text"),
        M.format_metric("value", "summary").alias("summary_text"),
        M.format_metric("event_type").alias("word"),
    )


@query(
    """SELECT o_orderkey, CASE WHEN n > 1 THEN label || ' (' || k || ')' ELSE label END
  AS shown_label FROM (SELECT o_orderkey, label, count(*) OVER (PARTITION BY label) AS n,
    row_number() OVER (PARTITION BY label ORDER BY o_orderkey) AS k
  FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'big'
    ELSE 'c' || o_custkey END AS label FROM orders))"""
)
def number_labels(spark, sf_dir):
    # A third of the rows share one label.
    label = F.when(F.col("o_custkey") % 3 == 0, "big").otherwise(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    )
    runs = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))
    return V.number_labels(runs, "label", "o_orderkey").select("o_orderkey", "shown_label")


@query(
    sql(
        """SELECT x.id, o.inference_id, o.output, s.accuracy
FROM fx_labels x JOIN fx_label_outputs o ON x.id = o.id
JOIN fx_label_scores s ON s.id = x.id AND s.inference_id = o.inference_id
WHERE o.inference_id = 'run1'""",
        "fx_labels", "fx_label_outputs", "fx_label_scores",
    )
)
def evaluation_view(spark, sf_dir):
    from scoreframe.plans.scoring import score_rows

    from .corpus import YES_NO

    one = F.col("inference_id") == "run1"
    rows = fx.label_outputs(spark, sf_dir).filter(one)
    scores = score_rows(rows, YES_NO).select(
        "id", F.element_at("metrics", "accuracy").alias("accuracy")
    )
    outputs = rows.select("id", "inference_id", "output")
    return V.evaluation_view(fx.labels(spark, sf_dir).select("id"), outputs, scores)


@query(
    sql(
        "SELECT x.id, x.reference, o.inference_id, o.output FROM fx_labels x "
        "JOIN fx_label_outputs o ON x.id = o.id",
        "fx_labels", "fx_label_outputs",
    )
)
def join_outputs(spark, sf_dir):
    outputs = fx.label_outputs(spark, sf_dir).select("id", "inference_id", "output")
    return V.join_outputs(fx.labels(spark, sf_dir).select("id", "reference"), outputs)


@query(
    sql(
        "SELECT x.id, x.reference, o.inference_id, o.output FROM fx_labels x "
        "JOIN fx_label_outputs o ON x.id = o.id",
        "fx_labels", "fx_label_outputs",
    )
)
def join_bucketed(spark, sf_dir):
    """Dataset and outputs stored by id: their join shuffles nothing."""
    parts = {
        "dataset": fx.labels(spark, sf_dir).select("id", "reference"),
        "outputs": fx.label_outputs(spark, sf_dir).select("id", "inference_id", "output"),
    }
    stored = []
    for name, frame in parts.items():
        path = scratch_path(spark, name)
        known = f"{name}_{path.rsplit('-', 1)[-1]}"
        stored.append(storage.store_bucketed(frame, known, path, buckets=8))
    return V.join_outputs(*stored)


@query(
    sql(
        """SELECT inference_id, (SELECT count(*) FROM fx_labels) AS dataset_rows,
  count(*) AS output_rows,
  (SELECT count(*) FROM fx_labels) - count(*) FILTER (lang IS NOT NULL) AS missing,
  count(*) FILTER (lang IS NULL) AS unknown, 0::BIGINT AS duplicate_outputs, 0::BIGINT AS duplicate_ids,
  count(*) FILTER (lang IS NULL) = 0
    AND count(*) = (SELECT count(*) FROM fx_labels) AS aligned
FROM (SELECT o.inference_id, x.lang FROM (
    SELECT inference_id, CASE WHEN inference_id = 'run2' AND id LIKE '%7' THEN 'x' || id ELSE id
      END AS id FROM fx_label_outputs WHERE NOT (inference_id = 'run3' AND output = '   ')) o
  LEFT JOIN fx_labels x ON x.id = o.id) GROUP BY inference_id""",
        "fx_labels", "fx_label_outputs",
    )
)
def check_alignment(spark, sf_dir):
    run = F.col("inference_id")
    broken = F.when(
        (run == "run2") & F.col("id").endswith("7"), F.concat(F.lit("x"), "id")
    ).otherwise(F.col("id"))
    outputs = fx.label_outputs(spark, sf_dir).filter(
        ~((run == "run3") & (F.col("output") == "   "))
    )
    return V.check_alignment(
        fx.labels(spark, sf_dir), outputs.select("inference_id", broken.alias("id"))
    )


@query(
    sql(
        """SELECT l.id, l.inference_id, coalesce(n.content, '') AS note, h.score AS human_score
FROM fx_label_outputs l
LEFT JOIN (SELECT 'run' || (event_id % 3 + 1) AS inference_id, CAST(user_id AS VARCHAR) AS id,
    arg_max(props, event_id) AS content FROM events GROUP BY ALL) n
  ON n.inference_id = l.inference_id AND n.id = l.id
LEFT JOIN fx_human_state h ON h.evaluation_id = 'ev' || substr(l.inference_id, 4)
  AND h.row_id = l.id""",
        "fx_label_outputs", "fx_human_state",
    )
)
def annotated_rows(spark, sf_dir):
    from scoreframe.operators.annotations import NOTE_KEYS, SCORE_KEYS, apply_changes

    e = F.col("event_id")
    changes = table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), (e % 3 + 1).cast("string")).alias("inference_id"),
        F.col("user_id").cast("string").alias("row_id"), e.alias("version"),
        F.col("props").alias("content"),
    )
    notes = apply_changes(None, changes, NOTE_KEYS, ["content"])
    scores = apply_changes(None, fx.human_log(spark, sf_dir), SCORE_KEYS, ["score"])
    rows = fx.label_outputs(spark, sf_dir).withColumn(
        "evaluation_id", F.concat(F.lit("ev"), F.substring("inference_id", 4, 10))
    )
    return V.with_human_scores(V.with_notes(rows, notes), scores).select(
        "id", "inference_id", "note", "human_score"
    )


@query(
    sql(
        "SELECT id, lang FROM fx_labels WHERE id NOT IN (SELECT id FROM fx_label_outputs "
        "WHERE inference_id = 'run1' AND output <> '   ')",
        "fx_labels", "fx_label_outputs",
    )
)
def pending_rows(spark, sf_dir):
    done = fx.label_outputs(spark, sf_dir).filter(
        (F.col("inference_id") == "run1") & (F.col("output") != "   ")
    )
    return V.pending_rows(fx.labels(spark, sf_dir).select("id", "lang"), done)


@query(
    sql(
        """SELECT evaluation_id, row_id, version FROM fx_human_log
WHERE NOT (evaluation_id = 'ev1' AND row_id IN (SELECT id FROM fx_labels))""",
        "fx_human_log", "fx_labels",
    )
)
def unknown_ids(spark, sf_dir):
    known = fx.labels(spark, sf_dir).select(F.lit("ev1").alias("evaluation_id"), "id")
    return V.unknown_ids(fx.human_log(spark, sf_dir), known).select(
        "evaluation_id", "row_id", "version"
    )


@query(
    """SELECT o_orderkey, o_custkey % 5 = 0 AS is_favorite FROM orders
ORDER BY is_favorite DESC, o_orderkey LIMIT 20 OFFSET 20"""
)
def favourite_runs_page(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 5 == 0).alias("is_favorite")
    )
    return V.page(V.favourites_first(runs, "o_orderkey"), 1, 20)


@query(
    sql(
        """SELECT evaluation_id, CASE WHEN task = 'Multiple Choice Questions'
    THEN 'Accuracy, ROUGE-L, Rated Rows' ELSE CASE WHEN task = 'Generation'
    THEN 'ROUGE-1, Accuracy, ROUGE-L' ELSE 'Accuracy, ROUGE-L, ROUGE-1' END END AS labels
FROM fx_evaluations""",
        "fx_evaluations",
    )
)
def summary_metrics(spark, sf_dir):
    evals = fx.evaluations(spark, sf_dir)
    extra = F.when(
        F.col("task") == "Multiple Choice Questions",
        F.create_map(F.lit("human_evaluation_count"), F.lit(1.0), F.lit("rouge1"), F.lit(0.1)),
    ).otherwise(F.create_map(F.lit("rouge1"), F.lit(0.1)))
    shown = M.summary_metrics(F.map_concat("aggregate", extra), "task", 3)
    return evals.select(
        "evaluation_id",
        F.array_join(F.transform(shown, lambda s: s["label"]), ", ").alias("labels"),
    )


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'human_evaluation'
  WHEN 'view' THEN 'llm_judge_relevance' ELSE event_type END AS metric_id FROM events"""
)
def order_metrics(spark, sf_dir):
    named = (
        F.when(F.col("event_type") == "error", "human_evaluation")
        .when(F.col("event_type") == "view", "llm_judge_relevance")
        .otherwise(F.col("event_type"))
    )
    rows = table(spark, sf_dir, "events").select(
        named.alias("metric_id"), "event_id", F.col("event_id").alias("seq")
    )
    return V.order_metrics(rows).select("event_id", "metric_id")


@query("SELECT o_orderkey, 'd1' AS dataset_id FROM orders")
def same_dataset(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("d1").alias("dataset_id"))
    return V.assert_same_dataset(runs)


@query("SELECT min(doc_id) AS doc_id FROM documents")
def first_row(spark, sf_dir):
    """The first row of an ordered view, as a page of one."""
    return V.page(table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id"), 0, 1)
