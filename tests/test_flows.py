import re

import pytest
from pyspark.sql import functions as F, types as T

from scoreframe import schemas
from scoreframe.functions.registry import ParserSpec
from scoreframe.operators import annotations as A, catalog as K, views as V
from scoreframe.operators.generation import generate
from scoreframe.operators.views import Condition
from scoreframe.plans.scale import scratch_path
from scoreframe.plans.scoring import ScoringPlan, evaluate, leaderboard
from scoreframe.sources import ingest as I, storage as ST
from scoreframe.streaming import jobs as J


def test_mapping_and_validation(spark):
    frame = spark.createDataFrame([(1, "in", ["a", "b"], "x"), (2, "", ["c"], "y")],
                                  "k int, t string, r array<string>, extra string")
    mapped = I.normalize_reference(I.map_columns(frame))
    assert [tuple(r) for r in mapped.orderBy("id").collect()] == [
        ("1", "in", '["a","b"]'), ("2", "", '["c"]')
    ]
    checked = I.validate_rows(mapped, "split")
    assert checked.good.columns == ["id", "input", "reference"] and checked.good.count() == 1
    assert checked.bad.first().problem == "input_raw is empty"
    with pytest.raises(ValueError, match="1 of 2"):
        I.validate_rows(mapped)
    with pytest.raises(ValueError, match="no rows"):
        I.validate_rows(mapped.limit(0))
    with pytest.raises(ValueError, match="twice"):
        I.map_columns(frame, {"id": "k", "input_raw": "t", "reference": "t"})
    with pytest.raises(TypeError):
        I.normalize_reference(I.map_columns(frame.select("k", "t", F.lit(5).alias("r"))))


def test_json_array_file_and_csv_with_quotes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 7, "input_raw": "x\\ny", "reference": [[0, 1, "a"]]}]')
    row = I.read_dataset(spark, str(tmp_path / "a.json"), "json",
                         {c: c for c in ("id", "input_raw", "reference")}).first()
    assert (row.id, row.input) == ("7", "x\ny") and row.reference == '[["0","1","a"]]'
    (tmp_path / "b.csv").write_text('n,text,label\n1,"say ""hi""\nthere",yes\n')
    row = I.read_dataset(spark, str(tmp_path / "b.csv"), "csv", multi_line=True).first()
    assert tuple(row) == ("1", 'say "hi"\nthere', "yes")


def test_quoted_empty_csv_field_is_not_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,text,label\n1,"",x\n2,,""\n3,null,\n')
    for multi_line in (False, True):
        checked = I.read_dataset(spark, str(tmp_path / "a.csv"), "csv", mode="split", multi_line=multi_line)
        assert checked.good.count() == 0
        assert {r.id: (r.input_raw, r.reference, r.problem) for r in checked.bad.collect()} == {
            "1": ("", "x", "input_raw is empty"), "2": (None, "", "input_raw is missing"),
            "3": ("null", None, "reference is missing")}
    # A field of a given schema that can't be read is missing, quoted or not.
    (tmp_path / "b.csv").write_text('n,text,label\n"",a,x\n,b,y\n3,c,z\n')
    rows = I.scan(spark, str(tmp_path / "b.csv"), "csv", "n int, text string, label string")
    assert sorted(map(tuple, rows.collect()), key=str) == [(3, "c", "z"), (None, "a", "x"), (None, "b", "y")]


@pytest.mark.parametrize("name", ["ingest_csv", "ingest_json", "ingest_json_array", "ingest_parquet"])
def test_documents_without_text_are_read_too(spark, tmp_path, name):
    import querybook

    texts = {0: "", 1: "one", 2: None, 3: 'say "hi",\nthere\r\n', 4: "", 5: " ", 6: '"', 7: "null", 8: '""'}
    frame = spark.createDataFrame(
        [(i, t, "de", "web") for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = querybook.QUERIES[name](spark, str(tmp_path)).collect()
    reference = '["de","web"]' if name == "ingest_json" else "de"
    want = frame.select(F.col("doc_id").cast("string"), F.lit(reference), F.length("text"), F.md5("text"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_export_keeps_long_digits(spark):
    frame = spark.createDataFrame([(2**60, [2**55], 1.5)], "a long, b array<long>, c double")
    path = scratch_path(spark, "longs")
    ST.export_json(frame, path)
    row = spark.read.json(path).first()
    assert (row.a, row.b, row.c) == (str(2**60), [str(2**55)], 1.5)


def test_evaluate_and_leaderboard(spark):
    dataset = spark.createDataFrame([("1", "yes"), ("2", "no")], "id string, reference string")
    outputs = spark.createDataFrame(
        [("r1", "1", "Yes!"), ("r1", "2", "no"), ("r2", "1", "no"), ("r2", "2", "no")],
        "inference_id string, id string, output string",
    )
    plan = ScoringPlan("mcq", ("accuracy",), (ParserSpec("process_mcq_yes_no_maybe"),))
    done = evaluate(dataset, outputs, plan, scratch_path(spark, "rows"))
    got = {r.inference_id: r.value for r in done.aggregates.collect()}
    assert got == {"r1": 1.0, "r2": 0.5}
    evals = done.aggregates.groupBy("inference_id").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("aggregate")
    ).select("inference_id", "aggregate", F.lit("done").alias("effective_status"),
             F.lit("k").alias("object_key"), F.lit("Multiple Choice Questions").alias("task"))
    runs = spark.createDataFrame([("r1", "d", "p", "a"), ("r2", "d", "p", "b")],
                                 "inference_id string, dataset string, provider_id string, model string")
    board = {r.model_key: r.position for r in leaderboard(evals, runs).collect()}
    assert board == {"p::a": 1, "p::b": 2}


def test_raw_corpus_switch(spark):
    rows = spark.createDataFrame([("r", "1", "I think a;b", "a;b")],
                                 "inference_id string, id string, output string, reference string")
    plan = ScoringPlan("mlc", ("macro_f1",), classes=("a", "b"))
    value = lambda p: evaluate(rows.select("id", "reference"),
                               rows.drop("reference"), p).aggregates.first().value
    assert value(plan) == 1.0
    assert value(plan._replace(raw_corpus=True)) == 0.5


def test_filters(spark):
    rows = spark.createDataFrame(
        [("1", {"m": 0.5}), ("2", {"m": float("nan")}), ("3", {}), ("4", {"m": 0.9})],
        "id string, metrics map<string,double>",
    )
    def kept(*conditions):
        return [r.id for r in V.filter_by_metrics(rows, conditions).orderBy("id").collect()]

    assert kept(Condition("m", "!=", 0.5)) == ["4"]
    assert kept(Condition("m", ">=", 0.5), Condition("m", "<", 0.9)) == ["1"]
    assert kept(Condition("m", ">", 0.0)) == ["1", "4"]
    assert V.search(rows.select("id"), "").count() == 4


def test_orders(spark):
    rows = spark.createDataFrame(
        [("human_evaluation", 0, None), ("llm_judge_x", 1, True), ("bleu", 2, False), ("acc", 3, True)],
        "metric_id string, seq int, is_favorite boolean",
    )
    assert [r.seq for r in V.order_metrics(rows).collect()] == [2, 3, 1, 0]
    assert [r.seq for r in V.favourites_first(rows).collect()] == [1, 3, 0, 2]
    assert [r.seq for r in V.page(V.sort_view(rows, "seq", False, "seq"), 1, 3).collect()] == [0]
    named = V.number_labels(rows.withColumn("label", F.lit("x")).limit(2), "label", "seq")
    assert {r.seq: r.shown_label for r in named.collect()} == {0: "x (1)", 1: "x (2)"}


def test_prompts(spark):
    rows = spark.createDataFrame([("1", "a $1 \\", "R {{output}}", " out ")],
                                 "id string, input string, reference string, output string")
    assert V.render_prompt(rows, "{{input}}|{{input}}").first().prompt == "a $1 \\|a $1 \\"
    text = V.render_judge_prompt(rows, "{{reference}}/{{criterion}}/{{scale}}", "x").first()
    assert text.judge_prompt == "R out/x/5"


def test_alignment_is_enforced(spark):
    dataset = spark.createDataFrame([("1",), ("2",), ("2",)], "id string")
    outputs = spark.createDataFrame([("r", "1"), ("r", "1"), ("r", "9")],
                                    "inference_id string, id string")
    row = V.check_alignment(dataset, outputs).first()
    assert (row.missing, row.unknown, row.duplicate_outputs, row.duplicate_ids, row.aligned) == (
        1, 1, 1, 1, False
    )
    with pytest.raises(ValueError):
        V.require_alignment(dataset, outputs)
    mixed = spark.createDataFrame([("a",), ("b",)], "dataset_id string")
    with pytest.raises(Exception, match="share one dataset"):
        V.assert_same_dataset(mixed).collect()


def test_nested_form_round_trip(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") < 900, "hot").otherwise("cold").alias("evaluation_id"),
        F.col("id").cast("string").alias("id"),
        F.create_map(F.lit("m"), F.col("id").cast("double")).alias("metrics"),
    )
    aggs = spark.createDataFrame([("hot", "m", 1.0), ("cold", "m", 2.0)],
                                 "evaluation_id string, metric string, value double")
    nested = V.nest_evaluation(rows, aggs, chunk_rows=100).cache()
    assert nested.agg(F.max(F.size("rows"))).first()[0] < 200
    assert nested.filter("evaluation_id = 'cold'").count() == 1
    back = V.unnest_evaluation(nested)
    assert back.count() == 1000 and back.select("id").distinct().count() == 1000
    path = scratch_path(spark, "nested")
    ST.export_evaluation(nested, path)
    kind = spark.read.parquet(path).schema["aggregate"].dataType
    assert kind.valueType == T.FloatType()


def test_changes(spark):
    log = spark.createDataFrame(
        [("e", "1", 1, 5), ("e", "1", 3, None), ("e", "1", 2, 4), ("e", "2", 1, 3)],
        "evaluation_id string, row_id string, version long, score int",
    )
    state = A.apply_changes(None, log, A.SCORE_KEYS, ["score"])
    assert [(r.row_id, r.score) for r in state.collect()] == [("2", 3)]
    late = spark.createDataFrame([("e", "1", 2, 2), ("e", "2", 0, 1)], log.schema)
    kept = A.apply_changes(None, log, A.SCORE_KEYS, ["score"], keep_deleted=True)
    again = A.apply_changes(kept, late, A.SCORE_KEYS, ["score"])
    assert [(r.row_id, r.score) for r in again.collect()] == [("2", 3)]
    marks = spark.createDataFrame([(0, 0), (3, 2), (-1, 4), (None, None), (2, None)], "start int, end int")
    assert [r[0] for r in marks.select(A.valid_highlight()).collect()] == [
        True, False, False, True, False
    ]


def test_generation_resumes_and_labels_errors(spark):
    dataset = spark.createDataFrame([(str(i), f"t{i}") for i in range(20)], "id string, input string")
    done = dataset.filter("id in ('3', '5')")

    def make():
        def client(prompt):
            if prompt.endswith("7"):
                raise RuntimeError("boom")
            return prompt.upper()

        return client

    got = {r.id: r.output for r in generate(dataset, make, ">{{input}}", done, parallel=3).collect()}
    assert len(got) == 18 and got["7"] == got["17"] == "[ERROR: RuntimeError]" and got["4"] == ">T4"


def test_long_lists_continue_in_parts(spark):
    rows = spark.range(25).select(
        F.when(F.col("id") < 20, "hot").otherwise("cold").alias("provider_id"),
        F.format_string("m%02d", F.col("id")).alias("model"),
    )
    got = {(r.provider_id, r.part): r.models
           for r in K.listed(rows, ["provider_id"], "model", size=8).collect()}
    assert {k: len(v) for k, v in got.items()} == {
        ("hot", 0): 8, ("hot", 1): 8, ("hot", 2): 4, ("cold", 0): 5
    }
    assert got["hot", 0] + got["hot", 1] + got["hot", 2] == [f"m{i:02d}" for i in range(20)]
    parents = spark.createDataFrame([("cold",), ("none",)], "provider_id string")
    full = {r.provider_id: len(r.models) for r in K.models_per_provider(parents, rows, 10_000).collect()}
    assert full == {"cold": 5, "none": 0}


def test_parameters(spark):
    spec = K.parameter_table(spark)
    rows = spark.createDataFrame(
        [("r", "azure", "gpt-5", "reasoning_effort", "minimal"),
         ("r", "azure", "o1", "reasoning_effort", "minimal"),
         ("r", "google", "g", "top_p", "1.5"), ("r", "google", "g", "top_k", "1"),
         ("r", "huggingface", "h", "do_sample", "maybe")],
        "run_id string, provider_id string, model string, parameter string, value string",
    )
    got = {(r.model, r.parameter): r.problem for r in K.check_params(rows, spec).collect()}
    assert got == {
        ("gpt-5", "reasoning_effort"): None, ("o1", "reasoning_effort"): "invalid value",
        ("g", "top_p"): "invalid value", ("g", "top_k"): "unknown parameter",
        ("h", "do_sample"): "invalid value",
    }
    built = K.build_registry(K.metric_table(spark), spark.createDataFrame(
        [("p", ["a", "b"])], "provider_id string, models array<string>"))
    assert built["metric"].count() == 36 and built["model"].count() == 2


def test_stream_restart_ignores_redelivery(spark):
    dataset = spark.createDataFrame([("1", "yes"), ("2", "no")], "id string, reference string")
    rows = spark.createDataFrame([("r", "1", "yes"), ("r", "2", "yes")], schemas.OUTPUTS)
    folder, out, log = (scratch_path(spark, n) for n in ("in", "out", "log"))
    plan = ScoringPlan("mcq", ("accuracy",), (ParserSpec("process_mcq_yes_no_maybe"),))

    def drain():
        stream = J.dedupe_outputs(J.read_outputs(spark, folder, schemas.OUTPUTS))
        J.write_stream(J.stream_scores(stream, dataset, plan), out, log).awaitTermination()
        return sorted((r.id, r.metrics["accuracy"]) for r in spark.read.parquet(out).collect())

    rows.filter("id = '1'").write.parquet(folder)
    assert drain() == [("1", 1.0)]
    rows.write.mode("append").parquet(folder)
    assert drain() == [("1", 1.0), ("2", 0.0)]


def test_dedupe_with_arrival_time_bounds_state(spark):
    schema = "inference_id string, id string, at timestamp"
    folder = scratch_path(spark, "none")
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    plan = J.dedupe_outputs(stream, arrived="at", delay="10 minutes")
    assert "Watermark" in plan._jdf.queryExecution().analyzed().toString()


def test_array_files_grow_with_the_rows(spark, tmp_path, monkeypatch):
    import querybook.ingest as Q

    # Ids that a fixed number of groups would gather in one file.
    long = F.repeat(F.concat(F.lit('wort "x"\n'), F.col("id").cast("string")), 50_000)
    frame = spark.range(0, 16 * 24, 16, 2).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 32 == 0, "kurz\té").otherwise(long).alias("text"),
        F.lit("de").alias("lang"))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(Q, "scratch_path", lambda spark, name: str(tmp_path / name))
    got = {r.id: (r.chars, r.digest, r.reference) for r in Q.ingest_json_array(spark, str(tmp_path)).collect()}
    want = frame.select("doc_id", F.length("text"), F.md5("text"), "lang").collect()
    assert got == {str(r[0]): tuple(r[1:]) for r in want}
    sizes = [f.stat().st_size for f in (tmp_path / "json-array").glob("part-*")]
    assert max(sizes) < 5_000_000 and sum(sizes) > 7_000_000


@pytest.mark.parametrize("ascending", [True, False])
def test_pages_of_a_stored_view(spark, tmp_path, ascending):
    rows = spark.createDataFrame(
        [(f"{i:04d}", None if i % 11 == 0 else float(i % 3)) for i in range(1000)],
        "id string, `a.score` double",
    ).repartition(5)
    path = str(tmp_path / "view")
    ST.store_view(rows, path, "a.score", ascending, ranges=20)
    want = [tuple(r) for r in V.sort_view(rows, "a.score", ascending).collect()]
    for number, size in ((0, 7), (13, 50), (19, 50), (20, 50), (3, 300), (0, 2000)):
        got = ST.stored_page(spark, path, rows.schema, "a.score", number, size, ascending)
        assert [tuple(r) for r in got.collect()] == want[number * size : (number + 1) * size]
    # A page reads the range that holds it (at its edge two), and no other.
    late = ST.stored_page(spark, path, rows.schema, "a.score", 400, 2, ascending)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*__range#\d+ (= \d+|IN \(\d+,\d+\))", plan)
    none = rows.limit(0)
    ST.store_view(none, str(tmp_path / "none"), "a.score", ranges=4)
    assert ST.stored_page(spark, str(tmp_path / "none"), rows.schema, "a.score").count() == 0


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    data = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("r").alias("reference"))
    outputs = spark.range(900).select(
        (F.col("id") % 600).cast("string").alias("id"), F.lit("run").alias("inference_id"),
        F.col("id").alias("output"),
    )
    a = ST.store_bucketed(data, "flow_data", str(tmp_path / "a"), buckets=6)
    b = ST.store_bucketed(outputs, "flow_outputs", str(tmp_path / "b"), buckets=6)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = V.join_outputs(a, b)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(joined.collect()) == sorted(V.join_outputs(data, outputs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
