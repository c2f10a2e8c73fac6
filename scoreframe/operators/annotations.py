"""Notes, highlights and human scores: change logs folded to current state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SCORE_KEYS = ("evaluation_id", "row_id")
NOTE_KEYS = ("inference_id", "row_id")

# Lowest and highest human score.
SCORE_RANGE = (1, 5)


def valid_score(c: Column | str = "score") -> Column:
    """True for a whole score from 1 to 5, or null (a deletion)."""
    score = F.col(c) if isinstance(c, str) else c
    lo, hi = SCORE_RANGE
    return score.isNull() | (score.between(lo, hi) & (score == F.floor(score)))


def valid_highlight(start: str = "start", end: str = "end") -> Column:
    """True for 0 <= start <= end, or both null (a deletion)."""
    s, e = F.col(start), F.col(end)
    return (s.isNull() & e.isNull()) | F.coalesce((s >= 0) & (e >= s), F.lit(False))


def apply_changes(
    state: DataFrame | None,
    changes: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    version: str = "version",
    keep_deleted: bool = False,
) -> DataFrame:
    """Latest change per key wins; a change whose values are null deletes.

    ``max_by`` is combined map-side, so a key that changes a million times is
    one row per task by the time it is shuffled. Equal versions are settled by
    the values themselves, which makes the result independent of row order.
    ``keep_deleted`` keeps deletions, for a state that later changes may
    arrive late for.
    """
    columns = [*keys, *values, version]
    log = changes.select(*columns)
    if state is not None:
        log = state.select(*columns).unionByName(log)
    folded = log.groupBy(*keys).agg(
        F.max(F.struct(version, *values)).alias("__last")
    ).select(*keys, *[F.col(f"__last.{c}").alias(c) for c in [*values, version]])
    if keep_deleted:
        return folded
    return folded.dropna(how="all", subset=list(values))


def deletions(
    keys_frame: DataFrame, values: dict[str, str], version: Column, version_name: str = "version"
) -> DataFrame:
    """Delete changes for the given keys; ``values`` maps columns to types."""
    gone = {name: F.lit(None).cast(kind) for name, kind in values.items()}
    return keys_frame.withColumns({**gone, version_name: version})


def current_state(state: DataFrame, parent: str, value: str, key: str) -> DataFrame:
    """Entries of one run or evaluation."""
    return state.filter(F.col(key) == parent).select("row_id", value)
