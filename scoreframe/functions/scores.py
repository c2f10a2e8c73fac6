"""Row metrics that need nothing but the row: native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, fold


def accuracy(pred: Column | str, ref: Column | str) -> Column:
    """1.0 when both labels agree ignoring case and outer whitespace."""
    return fold(pred).eqNullSafe(fold(ref)).cast("double")


def accuracy_vector(pred: Column | str, ref: Column | str) -> Column:
    """1.0 when the two 0/1 vectors are equal in every position."""
    return F.coalesce((col(pred) == col(ref)).cast("double"), F.lit(0.0))


def accuracy_spans(pred: Column | str, ref: Column | str) -> Column:
    """1.0 when the two span lists are equal, position by position."""
    return F.coalesce((col(pred) == col(ref)).cast("double"), F.lit(0.0))


def span_counts(pred: Column | str, ref: Column | str) -> Column:
    """Distinct spans predicted, expected and shared, as one struct.

    Summing these three numbers is all that exact match needs, so spans are
    never exploded or shuffled.
    """
    empty = F.array().cast("array<struct<s:int,e:int,label:string>>")
    p, r = F.coalesce(col(pred), empty), F.coalesce(col(ref), empty)
    return F.struct(
        F.size(F.array_distinct(p)).cast("long").alias("predicted"),
        F.size(F.array_distinct(r)).cast("long").alias("expected"),
        F.size(F.array_intersect(p, r)).cast("long").alias("shared"),
    )
