"""Bootstrap intervals and Wilcoxon tests over long score tables.

``scores_long`` is ``inference_id, id, metric, value``. A metric of one run may
hold most of the rows, so nothing here sorts a group in one task: ranks come
from counts per distinct value and ``running_totals``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.significance import EXACT_MOST, normal_p, signed_rank_p
from ..plans.scale import BROADCAST_ROWS, attach, cut, running_totals

# Fixed value: differences up to this size count as equal scores.
ALL_EQUAL = 1e-8


class Report(NamedTuple):
    bootstrap: DataFrame
    pairwise: DataFrame


def run_pairs(runs: Sequence[str]) -> list[tuple[str, str]]:
    """All unordered pairs of runs, in the given order."""
    return list(combinations(runs, 2))


def _number(c: str = "value") -> Column:
    return F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c)), F.col(c))


def valid_scores(scores_long: DataFrame) -> DataFrame:
    """Rows whose value is a number (neither null nor NaN)."""
    return scores_long.filter(_number().isNotNull())


def common_metrics(scores_long: DataFrame, runs: Sequence[str] | None = None) -> DataFrame:
    """Metrics every run has, as a sorted one-column frame.

    Without ``runs`` the runs are those present in the table.
    """
    if runs is not None:
        scores_long = scores_long.filter(F.col("inference_id").isin(*runs))
    seen = scores_long.select("inference_id", "metric").distinct()
    wanted = (
        F.lit(len(set(runs)))
        if runs is not None
        else seen.agg(F.count_distinct("inference_id")).scalar()
    )
    return (
        seen.groupBy("metric")
        .agg(F.count(F.lit(1)).alias("__runs"))
        .filter(F.col("__runs") == wanted)
        .select("metric")
        .orderBy("metric")
    )


def _wide(scores_long: DataFrame, runs: Sequence[str]) -> DataFrame:
    """One row per (metric, id) with column ``v<i>`` for the i-th run.

    Only rows where every run has a number stay. One shuffle for any number of
    runs, and every later pair is a projection instead of a self-join.
    """
    per_run = [
        F.max(F.when(F.col("inference_id") == run, _number())).alias(f"v{i}")
        for i, run in enumerate(runs)
    ]
    wide = (
        scores_long.filter(F.col("inference_id").isin(*runs))
        .groupBy("metric", "id")
        .agg(*per_run)
    )
    return wide.dropna(subset=[f"v{i}" for i in range(len(runs))])


def align_scores(scores_long: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Long scores restricted to ids where every compared run has a number."""
    return _long(_wide(scores_long, runs), runs)


def _long(wide: DataFrame, runs: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[
            F.struct(F.lit(run).alias("inference_id"), F.col(f"v{i}").alias("value"))
            for i, run in enumerate(runs)
        ]
    )
    return wide.select("metric", "id", F.inline(cells)).select(
        "inference_id", "id", "metric", "value"
    )


PAIR = ["run_a", "run_b", "metric"]


def wilcoxon_signed_rank(
    scores_long: DataFrame, runs: Sequence[str], p_method: str = "auto"
) -> DataFrame:
    """Paired test for every pair of runs and metric.

    Columns: ``run_a, run_b, metric, n`` (non-zero differences), ``r_plus,
    r_minus, statistic, tie_term, z, p_value``. Differences that are all at
    most 1e-8 give statistic 0 and p 1. Fewer than two aligned values: no row.
    ``p_method="exact"`` counts all sign patterns of the ranks, tied ones
    included, for up to 2000 non-zero differences, and approximates beyond.
    """
    return _signed_rank(_wide(scores_long, runs), runs, p_method)


def _signed_rank(wide: DataFrame, runs: Sequence[str], p_method: str) -> DataFrame:
    place = {run: i for i, run in enumerate(runs)}
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("run_a"),
                F.lit(b).alias("run_b"),
                (F.col(f"v{place[a]}") - F.col(f"v{place[b]}")).alias("d"),
            )
            for a, b in run_pairs(runs)
        ]
    )
    sizes = (
        wide.select("metric", F.inline(cells))
        .groupBy(*PAIR, F.abs("d").alias("size"))
        .agg(F.count_if(F.col("d") > 0).alias("up"), F.count(F.lit(1)).alias("times"))
    )
    moved = F.when(F.col("size") > 0, F.col("times")).otherwise(F.lit(0))
    ranked = running_totals(sizes, PAIR, ["size"], {"moved": moved})
    if p_method == "exact":
        ranked = cut(ranked)
    # Average rank of a tied block: rows before it plus half of its own.
    rank = F.col("moved_before") + (F.col("times") + 1) / 2.0
    live = F.col("size") > 0
    t = F.col("times").cast("double")
    sums = ranked.groupBy(*PAIR).agg(
        F.sum("times").alias("values"),
        F.max("size").alias("largest"),
        F.coalesce(F.sum(F.when(live, F.col("times"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(live, F.col("up") * rank)), F.lit(0.0)).alias("r_plus"),
        F.coalesce(
            F.sum(F.when(live, (F.col("times") - F.col("up")) * rank)), F.lit(0.0)
        ).alias("r_minus"),
        F.coalesce(F.sum(F.when(live, t * t * t - t)), F.lit(0.0)).alias("tie_term"),
    )
    equal = F.col("largest") <= ALL_EQUAL
    n = F.col("n").cast("double")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("tie_term") / 2) / 24)
    least = F.least("r_plus", "r_minus")
    tested = (
        sums.filter(F.col("values") >= 2)
        .withColumn("statistic", F.when(equal, F.lit(0.0)).otherwise(least))
        .withColumn("z", F.when(~equal, F.try_divide(least - n * (n + 1) / 4, spread)))
    )
    clean = (F.col("tie_term") == 0) & (F.col("values") == F.col("n"))
    blocks = None
    if p_method == "exact":
        tested = cut(tested)
        tested = tested.join(_rank_blocks(ranked, tested.filter(~equal), rank), PAIR, "left")
        blocks = F.col("__blocks")
    p = signed_rank_p(F.col("z"), F.col("statistic"), F.col("n"), clean, p_method, blocks)
    return tested.withColumn("__p", p).select(
        *PAIR, "n", "r_plus", "r_minus", "statistic", "tie_term", "z",
        F.when(equal, F.lit(1.0)).otherwise(F.col("__p")).alias("p_value"),
    )


def _rank_blocks(ranked: DataFrame, tested: DataFrame, rank: Column) -> DataFrame:
    """The distinct ranks of each test of at most ``EXACT_MOST`` differences."""
    few = tested.filter(F.col("n").between(1, EXACT_MOST)).select(*PAIR)
    block = F.struct((2 * rank).cast("long").alias("rank"), F.col("times"))
    return (
        attach(ranked.filter(F.col("size") > 0), few, PAIR, ["size"], "left_semi")
        .groupBy(*PAIR)
        .agg(F.collect_list(block).alias("__blocks"))
    )


def rank_sum(scores_long: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Unpaired test for every pair of runs and metric (no tie correction).

    Columns: ``run_a, run_b, metric, n_a, n_b, rank_sum_a, z, p_value``.
    """
    order = list(runs)
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("run_a"), F.lit(b).alias("run_b"))
            for a, b in run_pairs(order)
        ]
    )
    counted = (
        valid_scores(scores_long.filter(F.col("inference_id").isin(*order)))
        .groupBy("metric", "inference_id", "value")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    # Each distinct value joins the pairs its run takes part in.
    mine = F.filter(
        pairs,
        lambda p: (p["run_a"] == F.col("inference_id")) | (p["run_b"] == F.col("inference_id")),
    )
    values = (
        counted.select("metric", "inference_id", "value", "times", F.inline(mine))
        .groupBy(*PAIR, "value")
        .agg(
            F.sum(F.when(F.col("inference_id") == F.col("run_a"), F.col("times"))
                  .otherwise(0)).alias("a"),
            F.sum(F.when(F.col("inference_id") == F.col("run_b"), F.col("times"))
                  .otherwise(0)).alias("b"),
        )
    )
    both = F.col("a") + F.col("b")
    ranked = running_totals(values, PAIR, ["value"], {"both": both})
    rank = F.col("both_before") + (both + 1) / 2.0
    sums = ranked.groupBy(*PAIR).agg(
        F.sum("a").alias("n_a"),
        F.sum("b").alias("n_b"),
        F.sum(F.col("a") * rank).alias("rank_sum_a"),
    )
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    z = (F.col("rank_sum_a") - n_a * (n_a + n_b + 1) / 2) / F.sqrt(
        n_a * n_b * (n_a + n_b + 1) / 12
    )
    return (
        sums.filter((F.col("n_a") >= 2) & (F.col("n_b") >= 2))
        .withColumn("z", z)
        .withColumn("p_value", normal_p(F.col("z")))
    )


# --- bootstrap --------------------------------------------------------------

_GROUP = ["inference_id", "metric"]


def _draw(seed: int, turn: Column, pick: Column) -> Column:
    """Sixty hash bits of (seed, run, metric, turn, pick) as a long.

    A hash instead of a generator: the draw depends on its labels only, so any
    retry or partitioning, and any engine with md5, repeats it.
    """
    label = F.concat_ws("|", F.lit(str(seed)), *_GROUP, turn, pick)
    return F.conv(F.substring(F.md5(label), 1, 15), 16, 10).cast("long")


def bootstrap_means(
    scores_long: DataFrame, sample_size: int = 40, n_boot: int = 1000, seed: int = 0
) -> DataFrame:
    """Mean of each resample: ``inference_id, metric, turn, mean``.

    Rows are numbered by id within their (run, metric) and drawn by number
    through an equi-join, so the cost is the number of draws plus one pass
    over the scores.
    """
    rows = valid_scores(scores_long).select(*_GROUP, "id", "value")
    numbered = running_totals(rows, _GROUP, ["id"], {"one": F.lit(1)})
    size = F.least(F.lit(sample_size).cast("long"), F.col("n"))
    sizes = cut(
        numbered.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n")).withColumn("size", size)
    )
    turns = sizes.select(
        *_GROUP, "n", "size", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("turn")
    ).repartition(*_GROUP, "turn")
    draws = turns.select(
        *_GROUP, "turn", "n",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("pick"),
    ).select(
        *_GROUP, "turn",
        F.pmod(_draw(seed, F.col("turn"), F.col("pick")), F.col("n")).alias("row"),
    )
    source = numbered.select(*_GROUP, F.col("one_before").cast("long").alias("row"), "value")
    # Both sizes are known: few draws from many rows go to the rows, instead of
    # shuffling every row to find the few that are drawn.
    held, size = sizes.agg(F.sum("n"), F.sum("size")).first()
    total = (size or 0) * n_boot
    few = total <= BROADCAST_ROWS and (held or 0) > 10 * total
    picked = source.join(F.broadcast(draws) if few else draws, [*_GROUP, "row"])
    return picked.groupBy(*_GROUP, "turn").agg(F.avg("value").alias("mean"))


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (SplitMix64, Steele et al. 2014)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_means(
    scores_long: DataFrame, sample_size: int | None = None, n_boot: int = 1000, seed: int = 0
) -> DataFrame:
    """Resample means with Poisson weights: approximate, no row is shuffled.

    Each row gets ``n_boot`` weights from a hash of its id, and a task sends
    on one weighted sum and one weight per (run, metric, turn). The weights
    have mean min(1, sample_size / n), so a resample holds about
    ``sample_size`` draws. Use it when n_boot * sample_size rows are too many.
    """
    rows = valid_scores(scores_long).select(*_GROUP, "id", "value")
    if sample_size is None:
        rated = rows.withColumn("rate", F.lit(1.0))
    else:
        n = F.count(F.lit(1))
        rate = F.least(F.lit(sample_size), n) / n
        rated = attach(rows, rows.groupBy(*_GROUP).agg(rate.alias("rate")), _GROUP, ["id"])
    keyed = rated.select(
        *_GROUP, "rate", "value",
        F.xxhash64(F.lit(seed), "inference_id", "metric", "id").alias("key"),
    )
    steps = np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    held = max(1, min(HELD_GROUPS, HELD_BYTES // (16 * n_boot)))

    def flush(totals: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        sums = np.concatenate([np.zeros((2, 0)), *totals.values()], axis=1)
        each = np.repeat(np.arange(len(totals)), n_boot)
        runs, metrics = (pa.array([key[i] for key in totals], pa.string()).take(pa.array(each)) for i in (0, 1))
        return pa.RecordBatch.from_arrays(
            [
                runs, metrics,
                pa.array(np.tile(np.arange(n_boot, dtype=np.int32), len(totals))),
                pa.array(sums[0]), pa.array(sums[1]),
            ],
            names=[*_GROUP, "turn", "total", "weight"],
        )

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}

        for batch in batches:
            frame = batch.to_pandas()
            for group, part in frame.groupby([*_GROUP, "rate"], dropna=False):
                run, metric, rate = group
                if len(totals) >= held and (run, metric) not in totals:
                    yield flush(totals)
                    totals = {}
                # Cumulative Poisson probabilities; a uniform draw indexes them.
                terms = [np.exp(-rate)]
                while len(terms) < 40:
                    terms.append(terms[-1] * rate / len(terms))
                edges = np.cumsum(terms)
                acc = totals.setdefault((run, metric), np.zeros((2, n_boot)))
                for at in range(0, len(part), 1024):
                    chunk = part.iloc[at : at + 1024]
                    keys = chunk["key"].to_numpy().astype(np.int64).view(np.uint64)
                    uniform = _mix(keys[:, None] + steps[None, :]) / 2.0**64
                    weights = np.searchsorted(edges, uniform, side="right").astype(float)
                    acc[0] += chunk["value"].to_numpy() @ weights
                    acc[1] += weights.sum(axis=0)
        yield flush(totals)

    return (
        keyed.mapInArrow(
            partials,
            "inference_id string, metric string, turn int, total double, weight double",
        )
        .groupBy(*_GROUP, "turn")
        .agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("mean"))
    )


# Rows of a range in a split resample: one group of ``applyInArrow``.
RANGE_ROWS = 4096
# Up to this many draws a binomial is read off its distribution by one hash, which
# any engine repeats; more draws come from numpy's generator, keyed by the hash.
INVERTED = 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, INVERTED + 1)))])


def _binomial(draws: np.ndarray, share: float, keys: np.ndarray) -> np.ndarray:
    """A Binomial(draws, share) for each turn, by the turn's hash."""
    out = np.zeros_like(draws)
    for count in np.unique(draws[(draws > 0) & (draws <= INVERTED)]):
        k = np.arange(count + 1)
        logs = _LOG_FACTORIAL[count] - _LOG_FACTORIAL[k] - _LOG_FACTORIAL[count - k]
        logs += k * np.log(share) + (count - k) * np.log(1.0 - share)
        at = draws == count
        found = np.searchsorted(np.cumsum(np.exp(logs)), keys[at] / 2.0**64, side="right")
        out[at] = np.minimum(found, count)
    large = draws > INVERTED
    if large.any():
        generator = np.random.Generator(np.random.Philox(key=int(keys[0])))
        out[large] = generator.binomial(draws[large], share)
    return out


def _sent_to(
    at: int, rows: int, draws: int, turns: np.ndarray, range_rows: int
) -> tuple[np.ndarray, np.ndarray]:
    """Draws of each turn that fall into range ``at``, and the range's hash per turn.

    The ranges are the leaves of a binary tree. A node's draws are split by a
    binomial from hashes of (turn, node), so every range finds its own number on
    its way down from the root, and all ranges agree.
    """
    sent = np.full(len(turns), draws, np.int64)
    low, high, node = 0, -(-rows // range_rows), 1

    def keys() -> np.ndarray:
        return _mix(turns + np.array([node], np.uint64) * _STEP)

    while high - low > 1 and sent.any():
        middle = (low + high) // 2
        share = (middle - low) * range_rows / (min(high * range_rows, rows) - low * range_rows)
        left = _binomial(sent, share, keys())
        if at < middle:
            sent, high, node = left, middle, 2 * node
        else:
            sent, low, node = sent - left, middle, 2 * node + 1
    return sent, keys()


def split_means(
    scores_long: DataFrame,
    sample_size: int | None = None,
    n_boot: int = 1000,
    seed: int = 0,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Exact resample means without a table of draws: ``inference_id, metric, turn, mean``.

    Multinomial splitting: the rows of a (run, metric), numbered by id, form
    ranges; how many draws of a turn fall into a range comes from a tree of
    binomials, and inside the range rows are picked by hash. Only the scores
    are shuffled, and one sum per (range, turn). ``sample_size=None`` draws as
    many as there are rows. Same distribution as ``bootstrap_means``, other draws.
    """
    rows = valid_scores(scores_long).select(*_GROUP, "id", "value")
    numbered = running_totals(rows, _GROUP, ["id"], {"one": F.lit(1)})
    n = F.count(F.lit(1))
    size = n if sample_size is None else F.least(F.lit(sample_size).cast("long"), n)
    label = F.md5(F.concat_ws("|", F.lit(str(seed)), *_GROUP))
    sizes = rows.groupBy(*_GROUP).agg(n.alias("n"), size.alias("size")).withColumn(
        "base", F.conv(F.substring(label, 1, 15), 16, 10).cast("long")
    )
    place = F.col("one_before").cast("long")
    ranged = attach(numbered, sizes, _GROUP, ["id"]).select(
        *_GROUP, "base", "n", "size", "value",
        F.floor(place / range_rows).alias("at"), F.pmod(place, F.lit(range_rows)).alias("place"),
    )

    def sums(part: pa.Table) -> pa.Table:
        run, metric, base, rows, draws, at = (
            part[c][0].as_py() for c in (*_GROUP, "base", "n", "size", "at")
        )
        values = np.empty(part.num_rows)
        values[part["place"].to_numpy()] = part["value"].to_numpy()
        turns = _mix(np.uint64(base) + np.arange(1, n_boot + 1, dtype=np.uint64) * _STEP)
        sent, keys = _sent_to(at, rows, draws, turns, range_rows)
        total = np.zeros(n_boot)
        hit = np.flatnonzero(sent)
        # Some turns at a time: about a million picks are held.
        for some in np.split(hit, np.flatnonzero(np.diff(np.cumsum(sent[hit]) >> 20)) + 1):
            turn = np.repeat(some, sent[some])
            first = np.repeat(np.cumsum(sent[some]) - sent[some], sent[some])
            pick = (np.arange(len(turn)) - first + 1).astype(np.uint64)
            row = _mix(keys[turn] + pick * _STEP) % np.uint64(len(values))
            total += np.bincount(turn, values[row.astype(np.int64)], n_boot)
        return pa.table(
            {
                "inference_id": pa.array([run] * len(hit), pa.string()),
                "metric": pa.array([metric] * len(hit), pa.string()),
                "turn": pa.array(hit, pa.int32()),
                "total": pa.array(total[hit]),
                "draws": pa.array(sent[hit]),
            }
        )

    return (
        ranged.groupBy(*_GROUP, "at")
        .applyInArrow(
            sums, "inference_id string, metric string, turn int, total double, draws bigint"
        )
        .groupBy(*_GROUP, "turn")
        .agg((F.sum("total") / F.sum("draws")).alias("mean"))
    )


def bootstrap_ci(
    scores_long: DataFrame,
    sample_size: int | None = 40,
    n_boot: int = 1000,
    seed: int = 0,
    method: str = "draws",
    digits: int | None = 4,
    groups: DataFrame | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Mean, deviation and 95 % percentile interval of resampled means.

    ``inference_id, metric, mean, std, ci_low, ci_high``, one row for each
    (run, metric) of the scores, or of ``groups`` if they are given; one
    without any number gives zeros. ``method="draws"`` resamples exactly by a
    table of draws, ``"split"`` exactly without one, ``"poisson"`` approximates.
    """
    if method == "draws":
        if sample_size is None:
            raise ValueError("exact draws need a sample_size")
        means = bootstrap_means(scores_long, sample_size, n_boot, seed)
    elif method == "split":
        means = split_means(scores_long, sample_size, n_boot, seed, range_rows)
    elif method == "poisson":
        means = poisson_means(scores_long, sample_size, n_boot, seed)
    else:
        raise ValueError(f"unknown bootstrap method {method!r}")
    stats = means.groupBy(*_GROUP).agg(
        F.avg("mean").alias("mean"),
        F.stddev_samp("mean").alias("std"),
        F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("__ci"),
    )

    def shown(c: Column) -> Column:
        filled = F.coalesce(c, F.lit(0.0))
        return filled if digits is None else F.round(filled, digits)

    return (
        (scores_long if groups is None else groups).select(*_GROUP).distinct()
        .join(stats, _GROUP, "left")
        .select(
            *_GROUP,
            shown(F.col("mean")).alias("mean"),
            shown(F.col("std")).alias("std"),
            shown(F.get("__ci", F.lit(0))).alias("ci_low"),
            shown(F.get("__ci", F.lit(1))).alias("ci_high"),
        )
    )


def significant(p_value: Column | str, alpha: float = 0.05) -> Column:
    return (F.col(p_value) if isinstance(p_value, str) else p_value) < alpha


# (run, metric) pairs of a task whose sums are held before they are sent on.
HELD_GROUPS = 256
HELD_BYTES = 32_000_000
# Metric names up to this number become a filter that the scan can use.
NAMED_METRICS = 1000


def _of_metrics(scores_long: DataFrame, metrics: DataFrame) -> DataFrame:
    """Scores of the given metrics."""
    names = [row.metric for row in metrics.limit(NAMED_METRICS + 1).collect()]
    if len(names) <= NAMED_METRICS:
        return scores_long.filter(F.col("metric").isin(names))
    return attach(scores_long, metrics, ["metric"], ["id"], "left_semi")


METHODS = ("signed-rank", "rank-sum")


def compare_runs(
    scores_long: DataFrame,
    runs: Sequence[str],
    method: str = "signed-rank",
    sample_size: int = 40,
    n_boot: int = 1000,
    seed: int = 0,
    bootstrap: str = "draws",
    p_method: str = "auto",
    digits: int | None = 4,
) -> Report:
    """Bootstrap table and pairwise tests over the metrics all runs share.

    An unknown method means signed-rank. Signed-rank uses ids every run has a
    number for, in both tables; rank-sum uses each run's own numbers. Means,
    intervals and statistics are rounded to ``digits``.
    """
    method = method if method in METHODS else METHODS[0]
    chosen = scores_long.filter(F.col("inference_id").isin(*runs))
    shared = _of_metrics(chosen, common_metrics(chosen, runs)).select(
        "inference_id", "id", "metric", "value"
    )
    if method == "signed-rank":
        # Tests and intervals read the aligned table: it is made once.
        wide = cut(_wide(shared, runs))
        tests = _signed_rank(wide, runs, p_method)
        base, statistic = _long(wide, runs), F.col("statistic")
    else:
        tests = rank_sum(shared, runs)
        base, statistic = shared, F.col("z")
    pairwise = tests.select(
        *PAIR,
        F.lit(method).alias("test_method"),
        (statistic if digits is None else F.round(statistic, digits)).alias("statistic"),
        "p_value",
        significant("p_value").alias("significant"),
    )
    # A shared metric without an aligned id has a row too.
    intervals = bootstrap_ci(base, sample_size, n_boot, seed, bootstrap, digits, shared)
    return Report(intervals, pairwise)
