import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import models
from scoreframe.functions import significance
from scoreframe.functions.significance import exact_signed_rank, exact_tied_rank, two_sided_normal
from scoreframe.operators import stats as S
from scoreframe.operators.ranking import (
    average_rank, comparable_models, dataset_placements, latest_completed, overall_ranking,
)
from scoreframe.plans.scale import attach, balance, running_totals, spread_join

SCHEMA = "inference_id string, id string, metric string, value double"


def scores(spark, runs: dict[str, list]):
    rows = [(r, f"{i:05d}", "m", v) for r, vs in runs.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("partitions", [None, 16])
def test_running_totals_with_a_hot_group(spark, partitions):
    rng = random.Random(7)
    rows = [("hot", i, rng.randint(0, 9)) for i in rng.sample(range(10_000), 3000)]
    rows += [(f"g{i % 40}", i, rng.randint(0, 9)) for i in range(2000)]
    rows += [(None, i, 1) for i in range(50)]
    frame = spark.createDataFrame(rows, "g string, k int, x int")
    got = running_totals(frame, ["g"], ["k"], {"x": F.col("x"), "one": F.lit(1)}, partitions)
    seen = {(r.g, r.k): (r.x_before, r.one_before) for r in got.collect()}
    assert len(seen) == len(rows)
    totals: dict = {}
    for g, k, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        before = totals.get(g, (0, 0))
        assert seen[g, k] == before
        totals[g] = (before[0] + x, before[1] + 1)


def test_running_totals_without_groups(spark):
    frame = spark.range(1000).withColumn("w", F.col("id") % 7)
    got = running_totals(frame, [], ["id"], {"w": F.col("w")}, partitions=5).collect()
    assert {r.id: r.w_before for r in got} == {
        i: sum(j % 7 for j in range(i)) for i in range(1000)
    }


def test_signed_rank_against_model(spark):
    rng = random.Random(8)
    a = [rng.randint(0, 12) / 4 for _ in range(400)]
    b = [rng.randint(0, 12) / 4 for _ in range(400)]
    got = S.wilcoxon_signed_rank(scores(spark, {"x": a, "y": b}), ["x", "y"], "approx").first()
    n, plus, minus, ties = models.signed_rank(a, b)
    assert (got.n, got.r_plus, got.r_minus, got.tie_term) == (n, plus, minus, ties)
    assert got.r_plus + got.r_minus == n * (n + 1) / 2
    z = (min(plus, minus) - n * (n + 1) / 4) / math.sqrt(
        (n * (n + 1) * (2 * n + 1) - ties / 2) / 24
    )
    assert got.z == pytest.approx(z) and got.p_value == pytest.approx(math.erfc(abs(z) / 2**0.5))


def test_exact_p(spark):
    for n in (1, 3, 6, 9):
        for t in range(n * (n + 1) // 4 + 1):
            assert exact_signed_rank(t, n) == pytest.approx(models.exact_signed_rank_p(t, n))
    a, b = [1.0, 2.5, 3.0, 4.75, 9.0], [0.5, 3.0 + 0.75, 1.0, 1.75, 4.0]
    got = S.wilcoxon_signed_rank(scores(spark, {"x": a, "y": b}), ["x", "y"]).first()
    assert got.p_value == pytest.approx(models.exact_signed_rank_p(got.statistic, 5))


def test_exact_p_with_ties(spark):
    rng = random.Random(11)
    a = [rng.randint(0, 4) / 2 for _ in range(14)]
    b = [rng.randint(0, 4) / 2 for _ in range(14)]
    ranks = models.average_ranks([abs(x - y) for x, y in zip(a, b) if x != y])
    n, plus, minus, _ = models.signed_rank(a, b)
    low = sum(
        sum(r for i, r in enumerate(ranks) if mask >> i & 1) <= min(plus, minus)
        for mask in range(2**n)
    )
    got = S.wilcoxon_signed_rank(scores(spark, {"x": a, "y": b}), ["x", "y"], "exact").first()
    assert got.n == n < 14
    assert got.p_value == pytest.approx(min(1.0, 2 * low / 2**n))


def test_exact_p_of_many_differences(spark, monkeypatch):
    blocks = [(7, 3), (12, 2), *((2 * rank, 1) for rank in range(8, 151))]
    for reach in (200, 3000, 9000, 11_000):
        shifted = significance._shifted_tail(reach, blocks)
        assert significance._tilted_tail(reach, blocks) == pytest.approx(shifted, rel=1e-9)
    # As the normal law says, where it is good; the tail is not lost in rounding.
    n = 600
    mean, sd = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert exact_signed_rank(int(mean - 2 * sd), n) == pytest.approx(two_sided_normal(2), rel=0.01)
    assert 0 < exact_signed_rank(0, n) == pytest.approx(2.0 ** (1 - n), rel=1e-6)
    monkeypatch.setattr(S, "EXACT_MOST", 4)
    frame = scores(spark, {"x": [1.0, 2.0, 3.0, 4.0, 5.0], "y": [0.0] * 5})
    got = S.wilcoxon_signed_rank(frame, ["x", "y"], "exact").first()
    assert got.p_value == pytest.approx(two_sided_normal(got.z))


def test_all_equal_and_too_few(spark):
    frame = scores(spark, {"x": [1.0, 2.0, 3.0], "y": [1.0, 2.0, 3.0 + 1e-9], "z": [5.0]})
    got = S.wilcoxon_signed_rank(frame, ["x", "y"]).first()
    assert (got.statistic, got.p_value) == (0.0, 1.0)
    assert S.wilcoxon_signed_rank(frame, ["x", "z"]).count() == 0
    assert S.rank_sum(frame, ["x", "z"]).count() == 0


def test_rank_sum_is_antisymmetric(spark):
    rng = random.Random(9)
    a = [rng.randint(0, 9) * 1.0 for _ in range(80)] + [None, float("nan")]
    b = [rng.randint(2, 12) * 1.0 for _ in range(60)]
    frame = scores(spark, {"x": a, "y": b})
    ab, ba = S.rank_sum(frame, ["x", "y"]).first(), S.rank_sum(frame, ["y", "x"]).first()
    assert ab.z == pytest.approx(-ba.z) and (ab.n_a, ab.n_b) == (80, 60)
    ranks = models.average_ranks(a[:80] + b)
    assert ab.rank_sum_a == sum(ranks[:80])
    assert ab.p_value == pytest.approx(two_sided_normal(ab.z))


def test_bootstrap_forms_agree(spark):
    rng = random.Random(10)
    frame = scores(spark, {"x": [rng.random() for _ in range(500)], "empty": [None, None]})
    exact = {r.inference_id: r for r in S.bootstrap_ci(frame, 500, 300, seed=1, digits=None).collect()}
    again = {r.inference_id: r for r in
             S.bootstrap_ci(frame.repartition(7), 500, 300, seed=1, digits=None).collect()}
    near = {r.inference_id: r for r in
            S.bootstrap_ci(frame, None, 300, seed=1, method="poisson", digits=None).collect()}
    part = {r.inference_id: r for r in
            S.bootstrap_ci(frame, 50, 300, seed=1, method="poisson", digits=None).collect()}
    assert exact["empty"][2:] == (0.0, 0.0, 0.0, 0.0) == near["empty"][2:]
    assert exact["x"].mean == pytest.approx(again["x"].mean, abs=1e-12)
    for name in ("mean", "ci_low", "ci_high"):
        assert near["x"][name] == pytest.approx(exact["x"][name], abs=0.01)
    assert part["x"].std == pytest.approx(near["x"].std * 10**0.5, rel=0.2)


@pytest.mark.parametrize("draws", [30, S.INVERTED, S.INVERTED + 1])
def test_split_draws_fit_the_binomial(draws):
    turns, share = 40_000, 0.3
    keys = S._mix(np.arange(1, turns + 1, dtype=np.uint64) * S._STEP)
    got = S._binomial(np.full(turns, draws), share, keys)
    chance = [
        math.exp(math.lgamma(draws + 1) - math.lgamma(k + 1) - math.lgamma(draws - k + 1)
                 + k * math.log(share) + (draws - k) * math.log(1 - share))
        for k in range(draws + 1)
    ]
    # Chi-squared over the values that are expected at least twenty times.
    cells = [k for k in range(draws + 1) if chance[k] * turns >= 20]
    seen = np.bincount(got, minlength=draws + 1)
    chi = sum((seen[k] - chance[k] * turns) ** 2 / (chance[k] * turns) for k in cells)
    assert chi < len(cells) + 5 * math.sqrt(2 * len(cells))


@pytest.mark.parametrize("draws", [0, 1, 50, 5000])
def test_split_ranges_share_all_draws(draws):
    turns = S._mix(np.arange(1, 201, dtype=np.uint64) * S._STEP)
    sent = [S._sent_to(at, 1003, draws, turns, 64)[0] for at in range(16)]
    assert (sum(sent) == draws).all() and min(s.min() for s in sent) >= 0
    # The last range holds 43 of 1003 rows.
    assert sent[15].mean() == pytest.approx(draws * 43 / 1003, rel=0.15, abs=0.02)


def test_split_resamples(spark):
    rng = random.Random(12)
    values = [rng.random() ** 2 for _ in range(3000)]
    frame = scores(spark, {"x": values, "few": [1.0, None, 1.0], "empty": [None]})

    def intervals(method, size, **more):
        out = S.bootstrap_ci(frame, size, 400, seed=3, method=method, digits=None, **more)
        return {r.inference_id: r for r in out.collect()}

    drawn = intervals("draws", 3000)["x"]
    for size, width in ((None, 100), (3000, S.RANGE_ROWS), (3000, 7)):
        split = intervals("split", size, range_rows=width)
        assert split["few"][2:] == (1.0, 0.0, 1.0, 1.0) and split["empty"][2:] == (0.0,) * 4
        assert split["x"].mean == pytest.approx(drawn.mean, abs=0.002)
        assert split["x"].std == pytest.approx(drawn.std, rel=0.15)
        assert split["x"].ci_low == pytest.approx(drawn.ci_low, abs=0.004)
    # Each turn draws as many rows as were asked for, whatever the partitions.
    one = S.split_means(frame, 40, 50, seed=1, range_rows=64).collect()
    two = S.split_means(frame.repartition(5), 40, 50, seed=1, range_rows=64).collect()
    means = {(r.inference_id, r.turn): r["mean"] for r in one}
    assert len(means) == 100
    assert all(r["mean"] == pytest.approx(means[r.inference_id, r.turn], abs=1e-12) for r in two)


def test_compare_runs(spark):
    frame = scores(spark, {"x": [1.0, 2.0, None, 4.0], "y": [2.0, 1.0, 3.0, 9.0]}).union(
        spark.createDataFrame([("x", "00000", "only_x", 1.0)], SCHEMA)
    )
    report = S.compare_runs(frame, ["x", "y"], "unheard of", n_boot=20)
    pair = report.pairwise.collect()
    assert [(p.metric, p.test_method) for p in pair] == [("m", "signed-rank")]
    assert {r.metric for r in report.bootstrap.collect()} == {"m"}
    assert S.run_pairs(["a", "b", "c"]) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_average_rank_and_positions(spark):
    frame = spark.createDataFrame(
        [("d", "a", 0.5), ("d", "b", 0.5), ("d", "c", 0.1)],
        "dataset string, model_key string, value double",
    )
    ranks = {r.model_key: r.rank for r in average_rank(frame, ["dataset"], "value").collect()}
    assert ranks == {"a": 1.5, "b": 1.5, "c": 3.0}
    places = {r.model_key: r.position for r in overall_ranking(frame).collect()}
    large = {r.model_key: r.position for r in overall_ranking(frame, small_rows=0).collect()}
    assert large == places
    assert overall_ranking(frame).dtypes == overall_ranking(frame, small_rows=0).dtypes
    assert places == {"a": 1, "b": 1, "c": 3}
    partial = frame.union(spark.createDataFrame([("e", "a", 1.0)], frame.schema))
    assert {r.model_key for r in comparable_models(partial).collect()} == {"a"}
    assert overall_ranking(partial).count() == 0


def test_hot_groups_are_pruned_before_the_shuffle(spark):
    best = spark.range(1000).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("inference_id"),
        F.when(F.col("id") < 990, "hot").otherwise("cold").alias("dataset"), (F.col("id") % 17).cast("double").alias("value"),
    )
    plan = dataset_placements(best)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    hot = dataset_placements(best).filter("dataset = 'hot'").orderBy("place")
    assert [r.tier for r in hot.collect()] == ["gold", "silver", "bronze"]
    evals = best.select(
        F.col("dataset").alias("inference_id"), F.col("inference_id").alias("evaluation_id"),
        F.lit("done").alias("effective_status"), F.lit("k").alias("object_key"),
        F.when(F.col("value") < 16, F.col("value")).alias("created_at"),
    )
    newest = latest_completed(evals)
    assert "WindowGroupLimit" in newest._jdf.queryExecution().executedPlan().toString()
    assert {r.created_at for r in newest.collect()} == {15.0, 13.0}


def test_lookup_joins(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 300, "hot").otherwise("cold").alias("k"), "id")
    lookup = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    want = sorted((r.id, r.v) for r in rows.join(lookup, "k").collect())
    assert sorted((r.id, r.v) for r in attach(rows, lookup, ["k"], ["id"]).collect()) == want
    salted = spread_join(rows, lookup, ["k"], ["id"], rows_per_salt=50)
    assert sorted((r.id, r.v) for r in salted.collect()) == want
    assert balance(spark.range(10, numPartitions=2), 6).rdd.getNumPartitions() == 6
