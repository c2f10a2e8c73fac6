import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import models
from scoreframe.functions import metricmaps as M
from scoreframe.functions.overlap import (
    align, lcs_length, meteor_row, meteor_tokens, porter_stem, rouge,
)
from scoreframe.operators import corpus as C
from scoreframe.operators.textscores import meteor
from scoreframe.operators.tokens import embedding_match, mean_loglik, mean_loglik_multi
from scoreframe.plans.scoring import ScoringPlan, corpus_scores, score_rows

GUIDE = (
    "It is a guide to action which ensures that the military always obeys the commands of the party",
    "It is a guide to action that ensures that the military will forever heed Party commands",
)


def test_lcs_equals_table_method():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 60))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 60))]
        assert lcs_length(a, b) == models.lcs(a, b)


def test_rouge_rows(spark):
    rng = random.Random(2)
    words = ["the", "cat", "sat", "É", "on-line", "3.5", "THE", "mat"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    rows = list(zip(texts, reversed(texts))) + [("", "x"), (None, "x"), ("same text", "Same TEXT!")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, r string")
    got = [x[0] for x in frame.orderBy("i").select(rouge("p", "r")).collect()]
    import re
    for (p, r), s in zip(rows, got):
        if p is None:
            assert s.rouge1 is None
            continue
        a, b = (re.findall("[a-z0-9]+", t.lower()) for t in (p, r))
        n = models.lcs(a, b)
        want = 2 * n / (len(a) + len(b)) if n else 0.0
        assert s.rougeL == pytest.approx(want, abs=1e-12)
        left = list(b)
        shared = sum(1 for x in a if x in left and not left.remove(x))
        assert s.rouge1 == pytest.approx(2 * shared / (len(a) + len(b)) if shared else 0.0)
    assert got[-1].rouge1 == got[-1].rouge2 == got[-1].rougeL == 1.0
    zero = frame.filter("p is null").select(rouge("p", "r", ("rouge2",), "zero")["rouge2"]).first()
    assert zero[0] == 0.0


def test_meteor_golden_and_synonyms(spark):
    assert round(meteor_row(*GUIDE, {}), 4) == 0.6944
    lexicon = spark.createDataFrame([("always", "forever"), ("a", "b")], "word string, synonym string")
    frame = spark.createDataFrame([GUIDE, ("x", None)], "prediction string, reference string")
    plain = [r.meteor for r in meteor(frame).collect()]
    shipped = [r.meteor for r in meteor(frame, synonyms=lexicon).collect()]
    joined = {r.prediction: r.meteor
              for r in meteor(frame, synonyms=lexicon, broadcast_rows=0).collect()}
    assert round(plain[0], 4) == 0.6944 and plain[1] is None
    assert shipped[0] > plain[0]
    assert joined[GUIDE[0]] == shipped[0] and joined["x"] is None
    several = frame.limit(1).withColumn("reference", F.array("reference", "prediction"))
    assert meteor(several).first().meteor > 0.99


def test_alignment_equals_direct_search():
    rng = random.Random(3)
    words = ["run", "running", "runs", "cat", "cats", "dog", "hound", "big", "large"]
    related = {"dog": {"hound"}, "hound": {"dog"}, "big": {"large"}}
    for _ in range(300):
        p = [rng.choice(words) for _ in range(rng.randint(0, 12))]
        r = [rng.choice(words) for _ in range(rng.randint(0, 12))]
        assert align(p, r, porter_stem, related) == models.meteor_matches(
            p, r, porter_stem, related
        )


def test_stems_and_tokens():
    # Published examples of the algorithm and its extensions.
    pairs = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall",
        "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam",
        "electrical": "electr", "replacement": "replac", "adoption": "adopt", "roll": "roll",
        "dying": "die", "sky": "sky", "dies": "die", "spied": "spi", "enjoy": "enjoy",
        "geology": "geolog",
    }
    assert {w: porter_stem(w) for w in pairs} == pairs
    assert meteor_tokens("Don't stop, it's 3.5 well-known.") == [
        "do", "n't", "stop", ",", "it", "'s", "3.5", "well-known", "."
    ]


def test_f1_against_model(spark):
    rng = random.Random(4)
    labels = ["a", "B ", "c", None, " missing"]
    rows = [(rng.choice(labels), rng.choice(labels)) for _ in range(500)]
    frame = spark.createDataFrame(rows, "parsed string, reference string")
    norm = [tuple("missing" if x is None else x.lower().strip() for x in r) for r in rows]
    got = C.f1_labels(frame).first()
    assert (got.macro_f1, got.weighted_f1) == pytest.approx(models.f1(norm), abs=1e-12)
    single = C.f1_labels(frame, "macro").first().asDict()
    assert list(single) == ["macro_f1"]
    # On single labels accuracy equals micro F1.
    counts = C.label_counts(frame).agg(F.sum("hits"), F.sum("support")).first()
    assert counts[0] / counts[1] == sum(p == r for p, r in norm) / len(norm)


def test_exact_match_counts_distinct_spans(spark):
    schema = "p array<struct<s:int,e:int,label:string>>, r array<struct<s:int,e:int,label:string>>"
    rows = [([(0, 1, "a"), (0, 1, "a")], [(0, 1, "a")]), ([(2, 2, "b")], None), ([], [(5, 6, "c")])]
    got = C.exact_match(spark.createDataFrame(rows, schema), (), "p", "r").first()
    assert (got.shared, got.predicted, got.expected) == (1, 2, 2)
    assert got.exact_match_f1 == 0.5
    none = C.exact_match(spark.createDataFrame([([], [])], schema), (), "p", "r").first()
    assert none.exact_match_f1 == 0.0


def test_embedding_match_blocks_agree(spark):
    rng = np.random.default_rng(6)
    rows = [
        (i, s, k, [float(x) for x in rng.normal(size=5)])
        for i in range(4) for s in ("pred", "ref") for k in range(7 if s == "pred" else 11)
        if not (i == 3 and s == "ref")
    ]
    rows.append((0, "pred", 50, [0.0] * 5))
    frame = spark.createDataFrame(rows, "id int, side string, pos long, vector array<float>")
    sides = [frame.filter(F.col("side") == s).drop("side") for s in ("pred", "ref")]
    small = {r.id: r for r in embedding_match(*sides, block=2).collect()}
    large = {r.id: r for r in embedding_match(*sides, block=1000).collect()}
    assert set(small) == {0, 1, 2, 3} and small[3].f1 == 0.0
    for i in range(3):
        grid = {s: np.array([r[3] for r in rows if r[0] == i and r[1] == s], np.float32)
                .astype(float) for s in ("pred", "ref")}
        unit = {s: g / np.where((n := np.linalg.norm(g, axis=1, keepdims=True)) == 0, 1, n)
                for s, g in grid.items()}
        cos = unit["pred"] @ unit["ref"].T
        want = (cos.max(1).mean(), cos.max(0).mean())
        for got in (small[i], large[i]):
            assert (got.precision, got.recall) == pytest.approx(want, abs=1e-9)


def test_loglik(spark):
    rows = [("a", 1, -1.0), ("a", 1, -3.0), ("a", 2, -4.0), ("b", 1, -1.0), ("b", 2, -2.0)]
    frame = spark.createDataFrame(rows, "id string, ref_no int, logprob double")
    assert {r.id: r.score for r in mean_loglik(frame).collect()}["b"] == -1.5
    assert {r.id: r.score for r in mean_loglik_multi(frame, "max").collect()} == {"a": -2.0, "b": -1.0}
    assert {r.id: r.score for r in mean_loglik_multi(frame).collect()} == {"a": -3.0, "b": -1.5}
    with pytest.raises(Exception, match="different numbers"):
        mean_loglik_multi(frame.filter("not (id = 'b' and ref_no = 2)")).collect()


def test_metric_maps(spark):
    frame = spark.createDataFrame(
        [({"A": 1.0, "a": 2.0},), ({"x": float("nan")},), ({"ROUGEL": 0.5},)],
        "m map<string,double>",
    )
    def values(c):
        return [r[0] for r in frame.select(c).collect()]

    assert values(M.metric_value("m", "a")) == [2.0, None, None]
    assert values(M.metric_value("m", "rougel")) == [None, None, 0.5]
    assert values(M.clean_aggregate("m"))[1] == {}
    entries = spark.createDataFrame(
        [([("k", "1"), ("v", "x"), ("k", "2"), (None, "3")],), (None,)],
        "e array<struct<key:string,value:string>>",
    )
    assert [r[0] for r in entries.select(M.entries_to_aggregate("e")).collect()] == [{"k": 2.0}, {}]


def test_display(spark):
    frame = spark.createDataFrame(
        [(0.123456,), (12345.678,), (0.00012346,), (0.0,), (float("nan"),), (100.0,), (-2.5,)],
        "v double",
    )
    def shown(style):
        return [r[0] for r in frame.select(M.format_metric("v", style)).collect()]

    assert shown("summary") == ["0.1235", "12350", "0.0001235", "0", "—", "100", "-2.5"]
    assert shown("row")[:2] == ["0.1235", "12345.6780"]
    assert shown("rank")[0] == "0.12"
    times = spark.createDataFrame(
        [("2024-01-05 00:04:00",), ("2024-07-05T12:00:00.123456",), ("2024-07-05T12:00:00+02:00",),
         ("soon",), (None,)], "t string")
    assert [r[0] for r in times.select(M.format_created("t")).collect()] == [
        "Jan 04, 2024, 07:04 PM EST", "Jul 05, 2024, 08:00 AM EDT", "Jul 05, 2024, 06:00 AM EDT",
        "-", "-",
    ]
    marks = spark.createDataFrame(
        [("hello", 1, 3), ("hello", -2, 9), ("hello", 3, 3), ("hello", 9, 12)], "t string, s int, e int")
    got = [tuple(r[0]) for r in marks.select(M.apply_highlight("t", "s", "e")).collect()]
    assert got == [("h", "el", "lo"), ("", "hello", ""), ("hello", "", ""), ("hello", "", "")]


def test_scoring_plan_with_text_and_external_metrics(spark):
    frame = spark.createDataFrame(
        [("r", "1", "the cat", "the cat"), ("r", "2", "a dog", "the dog"), ("r", "3", None, "x")],
        "inference_id string, id string, output string, reference string",
    )
    external = spark.createDataFrame(
        [("r", "1", "bertscore", 0.5), ("r", "2", "bertscore", 0.7), ("r", "1", "other", 9.0)],
        "inference_id string, id string, metric string, value double",
    )
    plan = ScoringPlan("generation", ("rouge1", "rougeL", "meteor", "bertscore"))
    rows = score_rows(frame, plan)
    got = {r.metric: r.value for r in corpus_scores(rows, plan, external=external).collect()}
    assert set(got) == {"rouge1", "rougeL", "meteor", "bertscore"}
    assert got["bertscore"] == pytest.approx(0.6)
    assert got["rouge1"] == pytest.approx(0.75)  # the null output has no score
    zero = {r.metric: r.value for r in corpus_scores(
        score_rows(frame, plan._replace(on_error="zero")), plan._replace(on_error="zero")).collect()}
    assert zero["rouge1"] == pytest.approx(0.5) and not math.isnan(zero["meteor"])
