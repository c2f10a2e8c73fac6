"""p-values: one row per test, so a small Arrow function is enough.

Spark has no error function; everything before this point (ranks, sums, tie
terms) is native.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# Fixed value: up to this many untied differences the exact distribution is used.
EXACT_LIMIT = 50
# Up to this many differences, tied or not, "exact" takes the exact distribution.
EXACT_MOST = 2000
# Up to this many the counts are shifted and added, beyond it multiplied by FFT.
SHIFTED = 200


def two_sided_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def exact_signed_rank(statistic: float, n: int) -> float:
    """Two-sided p of the smaller rank sum when ranks are 1..n without ties."""
    return exact_tied_rank(statistic, [(2 * rank, 1) for rank in range(1, n + 1)])


def exact_tied_rank(statistic: float, blocks: list[tuple[int, int]]) -> float:
    """Two-sided p of the smaller rank sum, given the ranks.

    ``blocks`` are (twice the average rank, differences that share it); every
    difference goes up or down with the same chance. Twice a rank is whole.
    """
    reach = round(2 * statistic)
    many = sum(times for _, times in blocks) > SHIFTED
    return min(1.0, 2.0 * (_tilted_tail if many else _shifted_tail)(reach, blocks))


def _shifted_tail(reach: int, blocks: list[tuple[int, int]]) -> float:
    """P(sum <= reach): one shift and addition per difference, no sum above reach."""
    chance = np.zeros(reach + 1)
    chance[0] = 1.0
    for rank, times in blocks:
        for _ in range(times):
            up = np.zeros_like(chance)
            up[rank:] = chance[: max(0, reach + 1 - rank)]
            chance = (chance + up) / 2
    return float(chance.sum())


def _tilted_tail(reach: int, blocks: list[tuple[int, int]]) -> float:
    """P(sum <= reach) as a product of polynomials, two by two, by FFT.

    An FFT is exact to about 1e-15 of its largest value, and a tail may be far
    smaller. So the signs are tilted until ``reach`` is their mean, and the
    tilt is taken out of the result.
    """
    rank = np.array([r for r, _ in blocks], float)
    times = np.array([t for _, t in blocks], float)
    low, high = 0.0, 1.0
    up = lambda tilt: 1.0 / (1.0 + np.exp(np.minimum(tilt * rank, 700.0)))
    for _ in range(100):
        middle = (low + high) / 2
        if (times * rank * up(middle)).sum() > reach:
            low = middle
        else:
            high = middle
    tilt = high
    parts = []
    for (r, t), q in zip(blocks, up(tilt)):
        part = np.zeros(r * t + 1)
        logs = [math.lgamma(t + 1) - math.lgamma(k + 1) - math.lgamma(t - k + 1)
                for k in range(t + 1)]
        k = np.arange(t + 1)
        part[::r] = np.exp(np.array(logs) + k * math.log(q) + (t - k) * math.log1p(-q))
        parts.append(part)
    while len(parts) > 1:
        parts.sort(key=len)
        pairs = [_multiplied(a, b) for a, b in zip(parts[::2], parts[1::2])]
        parts = pairs + parts[len(parts) & ~1 :]
    below = np.arange(min(reach + 1, len(parts[0])))
    untilted = (parts[0][below] * np.exp(tilt * (below - reach))).sum()
    scale = (times * np.log((1.0 + np.exp(-tilt * rank)) / 2)).sum() + tilt * reach
    return float(untilted * math.exp(scale))


def _multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = len(a) + len(b) - 1
    room = 1 << (size - 1).bit_length()
    product = np.fft.irfft(np.fft.rfft(a, room) * np.fft.rfft(b, room), room)[:size]
    return np.maximum(product, 0.0)


def normal_p(z: Column) -> Column:
    @F.arrow_udf("double")
    def p_value(zs: pa.Array) -> pa.Array:
        return pa.array(
            [None if z is None else two_sided_normal(z) for z in zs.to_pylist()], pa.float64()
        )

    return p_value(z)


def signed_rank_p(
    z: Column, statistic: Column, n: Column, clean: Column, method: str, blocks: Column | None = None
) -> Column:
    """``method`` is "approx", "exact" or "auto".

    "auto" takes the exact distribution for at most 50 differences without
    ties or zeros (``clean``), the normal approximation otherwise. "exact"
    takes that of the ranks as they are, ties included (``blocks``, see
    ``exact_tied_rank``), and the approximation where ``blocks`` is null.
    """
    if method not in {"approx", "exact", "auto"}:
        raise ValueError(f"unknown p-value method {method!r}")
    if method == "approx":
        return normal_p(z)
    if method == "exact":
        if blocks is None:
            raise ValueError("exact p-values need the blocks of equal ranks")

        @F.arrow_udf("double")
        def exact_p(zs: pa.Array, ts: pa.Array, ranks: pa.Array) -> pa.Array:
            rows = zip(zs.to_pylist(), ts.to_pylist(), ranks.to_pylist())
            return pa.array(
                [
                    exact_tied_rank(t, [(b["rank"], b["times"]) for b in held])
                    if held and t is not None
                    else None if z is None else two_sided_normal(z)
                    for z, t, held in rows
                ],
                pa.float64(),
            )

        return exact_p(z, statistic, blocks)

    @F.arrow_udf("double")
    def p_value(zs: pa.Array, ts: pa.Array, ns: pa.Array, ok: pa.Array) -> pa.Array:
        out = []
        rows = zip(zs.to_pylist(), ts.to_pylist(), ns.to_pylist(), ok.to_pylist())
        for z, t, size, untied in rows:
            if z is None or t is None:
                out.append(None)
            elif untied and size <= EXACT_LIMIT:
                out.append(exact_signed_rank(t, size))
            else:
                out.append(two_sided_normal(z))
        return pa.array(out, pa.float64())

    return p_value(z, statistic, n, clean)
