"""Rules that keep faults visible and sizes bounded."""

import datetime
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F, types as T

from scoreframe import ParserSpec, ScoringPlan, evaluate
from scoreframe.functions import metricmaps as M, parsers as P
from scoreframe.functions.significance import exact_signed_rank
from scoreframe.operators import stats as S, views as V
from scoreframe.operators.corpus import facets
from scoreframe.operators.generation import generate_stored
from scoreframe.operators.ranking import best_primary
from scoreframe.operators.tokens import embedding_match
from scoreframe.plans.scale import running_totals, scratch_path, spread_join
from scoreframe.plans.scoring import stored_form
from scoreframe.sources import ingest as I
from scoreframe.sources.storage import delete_rows, rewrite, write_scores
from scoreframe.streaming import jobs as J

PLAN = ScoringPlan("mcq", ("accuracy",), (ParserSpec("process_mcq_yes_no_maybe"),))
OUTPUT = "inference_id string, id string, output string"


def test_misaligned_outputs_are_an_error_or_a_report(spark):
    dataset = spark.createDataFrame([(str(i), "yes") for i in range(1, 5)], "id string, reference string")
    outputs = spark.createDataFrame([("r", "1", "yes"), ("r", "1", "yes"), ("r", "9", "yes")], OUTPUT)
    with pytest.raises(ValueError, match="missing=3"):
        evaluate(dataset, outputs, PLAN)
    with pytest.raises(ValueError, match="unknown choice"):
        evaluate(dataset, outputs, PLAN, on_misaligned="hide")
    done = evaluate(dataset, outputs, PLAN, on_misaligned="report")
    assert done.aggregates.first().value == 0.25 and done.rows.count() == 4
    report = done.alignment.first()
    assert (report.missing, report.unknown, report.duplicate_outputs, report.aligned) == (3, 1, 1, False)


def test_scoring_goes_on_after_what_is_stored(spark):
    dataset = spark.createDataFrame([(str(i), "yes") for i in range(6)], "id string, reference string")
    outputs = spark.createDataFrame([("r", str(i), "yes" if i else "no") for i in range(6)], OUTPUT)
    path = scratch_path(spark, "scores")
    some = evaluate(dataset.filter("id < '3'"), outputs.filter("id < '3'"), PLAN, path, resume=True)
    assert some.rows.count() == 3
    changed = outputs.withColumn("output", F.lit("no"))
    done = evaluate(dataset, changed, PLAN, path, resume=True)
    rows = {r.id: r.metrics["accuracy"] for r in done.rows.collect()}
    assert rows == {"0": 0.0, "1": 1.0, "2": 1.0, "3": 0.0, "4": 0.0, "5": 0.0}
    for other in (PLAN._replace(metrics=("rouge1",)), PLAN._replace(parsers=()), PLAN._replace(on_error="zero")):
        with pytest.raises(ValueError, match="another plan"):
            evaluate(dataset, changed, other, path, resume=True)
    with pytest.raises(ValueError, match="exists already"):
        evaluate(dataset, changed, PLAN, path)
    bare = scratch_path(spark, "scores")
    done.rows.write.parquet(bare)
    with pytest.raises(ValueError, match="no plan"):
        evaluate(dataset, changed, PLAN, bare, resume=True)
    stored = stored_form(done, 100).first()
    assert stored.evaluation_id == "r" and len(stored.rows) == 6
    assert stored.aggregate == {"accuracy": pytest.approx(1 / 3)}


def test_deleted_rows_leave_the_store(spark):
    path = scratch_path(spark, "store")
    spark.range(10).write.parquet(path)
    gone = spark.createDataFrame([(3,), (4,)], "id long")
    rewrite(spark, path, lambda table: V.purge(table, gone, ["id"]))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 5, 6, 7, 8, 9]
    # A replacement that died between its two renames is taken up again.
    os.rename(path, f"{path}-old")
    spark.range(3).write.parquet(f"{path}-new")
    os.remove(f"{path}-new/_SUCCESS")
    rewrite(spark, path, lambda table: table)
    assert spark.read.parquet(path).count() == 8


def test_deleting_rows_leaves_other_folders_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(r, str(i), "x") for r in ("a", "b", "c", "d/e") for i in range(4)]
    write_scores(spark.createDataFrame(rows, OUTPUT), path)

    def files(run):
        return {f.name for f in (tmp_path / "store" / f"inference_id={run}").glob("*.parquet")}

    before = {r: files(r) for r in "abc"}
    gone = spark.createDataFrame(
        [("a", "1"), ("a", "3"), ("a", "9"), ("b", None), ("b", "1"), ("d/e", "0"), ("none", None),
         *[("c", "9")] * 2], "inference_id string, id string")
    assert delete_rows(spark, path, gone) == 4
    left = {(r.inference_id, r.id) for r in spark.read.parquet(path).collect()}
    assert left == {(r, i) for r, i, _ in rows} - {("a", "1"), ("a", "3"), ("d/e", "0"), *[("b", str(i)) for i in range(4)]}
    assert files("a") != before["a"] and not files("b")
    every = spark.createDataFrame([("a", "0"), ("a", "2")], "inference_id string, id string")
    same = files("c")
    assert delete_rows(spark, path, every) == 1 and not (tmp_path / "store" / "inference_id=a").exists()
    assert files("c") == same and delete_rows(spark, path, every.limit(0)) == 0


def test_facets_count_under_the_other_choices(spark):
    rows = [(a, b) for a in ("x", "y", None) for b in (1, 2) for _ in range(3 if a == "x" else 1)]
    frame = spark.createDataFrame(rows, "a string, `b.c` int")

    def counts(chosen):
        return {(r.facet, r.value): r.n for r in facets(frame, ["a", "b.c"], chosen).collect()}

    assert counts({}) == {("a", "x"): 6, ("a", "y"): 2, ("a", None): 2, ("b.c", "1"): 5, ("b.c", "2"): 5}
    assert counts({"a": ["x"]}) == {("a", "x"): 6, ("a", "y"): 2, ("a", None): 2, ("b.c", "1"): 3, ("b.c", "2"): 3}
    assert counts({"a": ["y"], "b.c": [1]}) == {
        ("a", "x"): 3, ("a", "y"): 1, ("a", None): 1, ("b.c", "1"): 1, ("b.c", "2"): 1}
    plan = facets(frame, ["a", "b.c"], {"a": ["x"]})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    with pytest.raises(ValueError, match="no facets"):
        facets(frame, ["a"], {"b.c": [1]})



def test_rankings_read_the_effective_status(spark):
    evals = spark.createDataFrame(
        [("r", "Multiple Choice Questions", "processing", "done", "k", {"accuracy": 0.9}),
         ("r", "Multiple Choice Questions", "done", "done", "k", {"accuracy": 0.4})],
        "inference_id string, task string, effective_status string, status string, object_key string, "
        "aggregate map<string,double>")
    assert best_primary(evals).first().value == 0.4


def test_csv_is_text_and_splits(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "w") as out:
        out.write("id,text,label\n")
        for i in range(60_000):
            out.write(f"{i:07d},{'word ' * 8}{i},1.10\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500k")
    try:
        rows = I.read_dataset(spark, path, "csv")
        assert rows.rdd.getNumPartitions() > 3
        assert tuple(rows.orderBy("id").first()) == ("0000000", "word " * 8 + "0", "1.10")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_judge_numbers(spark):
    replies = {"5d": None, "4f": None, "0x1p3": None, "inf": None, "nan": None, "1e999": None,
               " 4.5 ": 4.5, "-1": -1.0, ".5": 0.5, "5.": 5.0, "1e1": 10.0, "4/5": None, "": None}
    rows = spark.createDataFrame([(k,) for k in replies], "r string")
    got = {r.r: r.v for r in rows.select("r", P.parse_judge_score("r").alias("v")).collect()}
    assert got == replies


def test_summary_format_at_the_ends(spark):
    want = {1e21: "1000000000000000000000", 1.5e-20: "0.000000000000000000015", -2.5e-15: "-0.0000000000000025",
            1.23456: "1.235", 0.0: "0", 1234567.0: "1235000", float("inf"): "\u2014", 2e15: "2000000000000000"}
    rows = spark.createDataFrame([(k,) for k in want], "v double")
    got = {r.v: r.t for r in rows.select("v", M.format_metric("v", "summary").alias("t")).collect()}
    assert got == want


def test_nested_evaluations_keep_the_empty_ones(spark):
    rows = spark.createDataFrame([("a", "1", {"m": 1.0}), ("a", "2", {"m": 2.0})],
                                 "evaluation_id string, id string, metrics map<string,double>")
    maps = spark.createDataFrame([("b", "m", 3.0), ("a", "m", 1.5)],
                                 "evaluation_id string, metric string, value double")
    for size in (1, 100):
        got = V.nest_evaluation(rows, maps, size).collect()
        assert {r.evaluation_id for r in got} == {"a", "b"}
        assert sum(len(r.aggregate) for r in got if r.evaluation_id == "a") == 1
        assert [len(r.rows) for r in got if r.evaluation_id == "b"] == [0]
        assert sum(len(r.rows) for r in got) == 2


def test_reports_have_a_row_for_every_shared_metric(spark):
    rows = [("a", str(i), "m", 0.1 * i) for i in range(5)] + [("b", str(i + 9), "m", 0.2 * i) for i in range(5)]
    scores = spark.createDataFrame(rows, "inference_id string, id string, metric string, value double")
    table = S.compare_runs(scores, ["a", "b"], n_boot=5).bootstrap.collect()
    assert sorted((r.inference_id, r.mean, r.ci_high) for r in table) == [("a", 0.0, 0.0), ("b", 0.0, 0.0)]


def test_exact_p_is_bounded():
    assert exact_signed_rank(0, 5) == 2 / 2**5
    with pytest.raises(ValueError, match="at most"):
        exact_signed_rank(10, 5000)


def test_poisson_sums_are_sent_on(spark, monkeypatch):
    rows = spark.range(3000).select(
        F.concat(F.lit("r"), (F.col("id") % 40).cast("string")).alias("inference_id"),
        F.col("id").cast("string").alias("id"), F.lit("m").alias("metric"),
        (F.col("id") % 7).cast("double").alias("value"))
    key = ["inference_id", "metric", "turn"]
    want = {tuple(r[k] for k in key): r["mean"] for r in S.poisson_means(rows, n_boot=3).collect()}
    monkeypatch.setattr(S, "HELD_GROUPS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {tuple(r[k] for k in key): r["mean"] for r in S.poisson_means(rows, n_boot=3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx(want)


def test_running_totals_shuffle_twice(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 4).alias("g"), "id")
    out = running_totals(rows, ["g"], ["id"], {"one": F.lit(1)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(__range") <= 2  # the rows and their offsets
    counts = out.groupBy("g").agg(F.max("one_before").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.m == r.n - 1 for r in counts)


def test_hot_keys_get_as_many_salts_as_they_need(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1900, 1).otherwise(F.col("id")).alias("k"), "id")
    lookup = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    for how in ("inner", "left_semi"):
        joined = spread_join(rows, lookup, ["k"], ["id"], rows_per_salt=100, how=how)
        assert joined.count() == 2000
        assert set(joined.columns) == ({"k", "id", "v"} if how == "inner" else {"k", "id"})


def test_pages_by_key_are_those_by_number(spark):
    rows = spark.range(200).select(
        F.format_string("%03d", F.col("id")).alias("id"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 13).alias("v"))
    for ascending in (True, False):
        last, ordered = None, V.sort_view(rows, "v", ascending)
        for number in range(5):
            want = [tuple(r) for r in V.page(ordered, number, 45).collect()]
            got = [tuple(r) for r in V.page_after(rows, "v", last, 45, ascending).collect()]
            assert got == want
            last = want[-1][::-1] if want else None


def test_each_row_is_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def make():
        def client(prompt):
            with open(os.path.join(folder, prompt), "a") as out:
                out.write("x")
            return prompt.upper()

        return client

    dataset = spark.createDataFrame([(str(i), f"t{i}") for i in range(30)], "id string, input string")
    path = scratch_path(spark, "generated")
    first = generate_stored(dataset.limit(12), make, "{{input}}", path, batch_rows=5)
    assert first.count() == 12
    done = generate_stored(dataset, make, "{{input}}", path, batch_rows=7)
    assert done.count() == 30 and done.select("id").distinct().count() == 30
    assert sorted(len(p.read_text()) for p in calls.iterdir()) == [1] * 30


def test_folding_bounds_the_batches(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch in range(6):
        spark.createDataFrame([("a", batch), (f"k{batch}", batch)], "k string, v int").write.parquet(
            f"{path}/batch={batch}")
    want = sorted((r.k, r.v) for r in J.latest_updates(spark, path, ["k"]).collect())

    def now():
        return sorted((r.k, r.v) for r in J.latest_updates(spark, path, ["k"]).collect())

    def folders():
        return sorted(p.name for p in (tmp_path / "log").iterdir() if not p.name.startswith("."))

    assert J.fold_updates(spark, path, ["k"]) == 5 and now() == want
    assert J.fold_updates(spark, path, ["k"]) == 0 and now() == want
    assert folders() == ["_folded-4", "batch=5"]
    # The stream repeats its newest batch, which changed fewer keys.
    spark.createDataFrame([("k5", 7)], "k string, v int").write.mode("overwrite").parquet(f"{path}/batch=5")
    assert now() == [("a", 4), *[(f"k{i}", i) for i in range(5)], ("k5", 7)]
    spark.createDataFrame([("a", 99)], "k string, v int").write.parquet(f"{path}/batch=6")
    assert dict(now())["a"] == 99
    # A fold that was cut short leaves a table without its mark: it does not count.
    spark.createDataFrame([("a", -1, 5)], "k string, v int, batch long").write.parquet(f"{path}/_folded-5")
    os.remove(f"{path}/_folded-5/_SUCCESS")
    assert dict(now())["a"] == 99
    assert J.fold_updates(spark, path, ["k"]) == 1 and dict(now())["a"] == 99 and len(now()) == 7


def test_folded_changes_keep_their_deletions(spark, tmp_path):
    path, keys = str(tmp_path / "log"), ["e", "r"]
    rows = "e string, r string, version long, score int"
    for batch, changes in enumerate([[("e", "1", 5, None), ("e", "2", 1, 3)], [("e", "3", 1, 1)], [("e", "2", 2, 4)]]):
        spark.createDataFrame(changes, rows).write.parquet(f"{path}/batch={batch}")
    assert J.fold_changes(spark, path, keys, ["score"]) == 2
    spark.createDataFrame([("e", "1", 4, 2)], rows).write.parquet(f"{path}/batch=3")  # older than the deletion
    state = J.annotation_state(spark, path, keys, ["score"])
    assert sorted((r.r, r.score) for r in state.collect()) == [("2", 4), ("3", 1)]
    assert J.fold_changes(spark, path, keys, ["score"]) == 1
    assert sorted((r.r, r.score) for r in J.annotation_state(spark, path, keys, ["score"]).collect()) == [("2", 4), ("3", 1)]


def test_keyed_state_holds_live_keys(spark, tmp_path):
    rows = "e string, version long, score int, at timestamp"
    arrivals, path, log = (str(tmp_path / n) for n in ("in", "out", "log"))

    def drain(*changes):
        frame = spark.createDataFrame(
            [(k, v, s, datetime.datetime.fromtimestamp(1_700_000_000 + 60 * v)) for k, v, s in changes], rows)
        frame.coalesce(1).write.mode("append").parquet(arrivals)
        stream = J.read_outputs(spark, arrivals, frame.schema)
        J.keyed_state(stream, path, log, ["e"], ["score"], "at", "10 minutes").awaitTermination()
        held = spark.read.format("statestore").option("path", log).option("stateVarName", "last").load()
        return (sorted((r.e, r.score) for r in J.keyed_rows(spark, path, ["e"]).collect()),
                sorted(r[0] for r in held.select("key.e").collect()))

    assert drain(("a", 1, 5), ("b", 2, 3), ("c", 3, 4)) == ([("a", 5), ("b", 3), ("c", 4)], ["a", "b", "c"])
    # A deletion leaves a mark, an older change that comes later changes nothing.
    assert drain(("a", 6, None)) == ([("b", 3), ("c", 4)], ["a", "b", "c"])
    assert drain(("a", 4, 2), ("b", 7, 1)) == ([("b", 1), ("c", 4)], ["a", "b", "c"])
    # Long after, the mark goes; the key can come back.
    drain(("d", 60, 2))
    assert drain(("d", 61, 3)) == ([("b", 1), ("c", 4), ("d", 3)], ["b", "c", "d"])
    assert drain(("a", 62, 1)) == ([("a", 1), ("b", 1), ("c", 4), ("d", 3)], ["a", "b", "c", "d"])


def test_keyed_state_asks_twice_per_key():
    """Every call of the handle is a round trip to the executor."""
    asked, held = [], {}

    class Value:
        def get(self):
            asked.append("get")
            return held.get("v")

        def update(self, value):
            asked.append("update")
            held["v"] = value

        def clear(self):
            held.clear()

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def __getattr__(self, name):
            return lambda *a: asked.append((name, *a)) or iter(())

    out = T.StructType.fromDDL("e string, score int, version long, deleted boolean")
    state = J._Last(["score"], "version", "at", T.StructType(), out)
    state.init(Handle())

    def change(version, score):
        asked.clear()
        row = {"version": version, "score": score, "at": datetime.datetime.fromtimestamp(60 * version)}
        return [tuple(r) for r in state.handleInputRows(("a",), iter([row]), None)], list(asked)

    assert change(1, 5) == ([("a", 5, 1, False)], ["get", "update"])
    assert change(3, None) == ([("a", None, 3, True)], ["get", ("registerTimer", 180_000), "update"])
    assert change(2, 4) == ([], ["get"])
    assert change(4, 2) == ([("a", 2, 4, False)], ["get", ("deleteTimer", 180_000), "update"])
    state.handleExpiredTimer(("a",), None, None)
    assert held  # a live value stays


def test_embedding_blocks_are_crossed(spark):
    tokens = spark.range(40).select(
        (F.col("id") % 2).alias("id"), F.col("id").alias("pos"),
        F.array(*[F.sin(F.col("id") * (k + 1)).cast("float") for k in range(4)]).alias("vector"))
    one = sorted(map(tuple, embedding_match(tokens, tokens.filter("pos % 3 = 0"), 512).collect()))
    many = sorted(map(tuple, embedding_match(tokens, tokens.filter("pos % 3 = 0"), 3).collect()))
    assert [r[0] for r in one] == [r[0] for r in many]
    assert all(a == pytest.approx(b) for a, b in zip(one, many))


def test_scratch_goes_with_the_program(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from scoreframe.plans.scale import scratch_path
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
spark.range(3).write.parquet(scratch_path(spark, "kept"))
assert spark.read.parquet(scratch_path(spark, "x").rsplit("/", 1)[0] + "/kept-*").count() == 3
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    assert not list(tmp_path.glob("scratch-*"))


def test_fused_words_and_quotes_are_taken_apart():
    from scoreframe.functions.overlap import meteor_tokens

    assert meteor_tokens('I cannot say "gonna" ("wanna"), can\'t I?') == [
        "i", "can", "not", "say", "``", "gon", "na", "\'\'", "(", "``", "wan", "na", "\'\'", ")", ",",
        "ca", "n\'t", "i", "?"]
    assert meteor_tokens("\'Tis more\'n d\'ye gotta, gimme cannot-do") == [
        "\'t", "is", "more", "\'n", "d", "\'ye", "got", "ta", ",", "gim", "me", "can", "not-do"]
