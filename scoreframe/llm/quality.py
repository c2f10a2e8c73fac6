"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Rules are Column predicates over a text and a few counts. Before the run every
rule is timed and its rejections are counted on a bounded sample; the cascade
then asks them in order of rejections per second, and ``CASE WHEN`` stops at
the first that rejects. The verdict is the conjunction of all rules, so the
order changes the cost and never the result. One narrow pass, no shuffle.

Null and empty texts have no words and fail the base rules. Repeated rows are
judged one by one. Three-word windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .base import SPACE, let, words

#: Rows on which cost and selectivity of the rules are measured.
SAMPLE_ROWS = 1000

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Counts that the base rules give to every row.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects a text where ``fails`` is true; it may use text and counts."""

    name: str
    fails: Column


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-9).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(
            places,
            start,
            lambda acc, i: F.struct(
                i.alias("at"), (acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n")
            ),
            lambda acc: acc["n"],
        )

    def twice(hashes: Column) -> Column:
        pairs = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )
        return let(
            pairs,
            lambda s: covered(
                F.sort_array(
                    F.transform(
                        F.filter(
                            s,
                            lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)))
                            | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
                        ),
                        lambda x: x["i"],
                    )
                )
            ),
        )

    def count(hashes: Column) -> Column:
        plain = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(plain, F.lit(0)).otherwise(twice(hashes))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(
            starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )

    return let(
        tokens,
        lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows(w), count)),
    )


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of the base rules and ``base_failed``.

    Columns of ``docs`` with the names of counts are replaced.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    lines = let(_lines(plain), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    counted = docs.withColumn("__words", words(F.col(text))).withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.regexp_replace(plain, f"[{SPACE}]+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(plain, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": lines.cast("long"),
            "n_repeat_words": repeated_words(F.col("__words")).cast("long"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return counted.drop("__words").withColumn("base_failed", failed)


def standard_rules(text: str = "text") -> list[Rule]:
    """Published web-text heuristics that hold for any language.

    Thresholds: mean word length 3 to 10, at most one symbol per ten words, at
    most 40 % repeated lines, at least 80 % words with a letter, at most 90 %
    bulleted lines, at most 30 % lines ending in an ellipsis, at most 30 % of
    characters in upper case, no filler text.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    n, lines = F.col("n_words"), f"(?m)^.*[^{SPACE}].*$"

    def share(pattern: str) -> Column:
        found = F.regexp_count(plain, F.lit(pattern))
        return 100 * found / F.greatest(F.lit(1), F.regexp_count(plain, F.lit(lines)))

    letters = f"[^{SPACE}]*\\p{{L}}[^{SPACE}]*"
    upper = F.length(F.regexp_replace(plain, r"[^\p{Lu}]+", ""))
    return [
        Rule("word_length", (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 40 * (F.regexp_count(
            plain, F.lit(lines)))),
        Rule("letters", 100 * F.regexp_count(plain, F.lit(letters)) < 80 * n),
        Rule("bullets", share(f"(?m)^[{SPACE}]*[-*\\u2022\\u25cf\\u25aa].*$") > 90),
        Rule("ellipsis", share(f"(?m)^.*(\\.\\.\\.|\\u2026)[{SPACE}]*$") > 30),
        Rule("upper_case", 100 * upper > 30 * F.col("word_chars")),
        Rule("filler", F.contains(F.lower(plain), F.lit("lorem ipsum"))),
    ]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: int

    @property
    def gain(self) -> float:
        """Rejections per second."""
        return self.rejected / max(self.seconds, 1e-6)


def measure(counted: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Time each rule on at most ``rows`` rows and count what it rejects.

    Rows come from the first partitions that hold enough; only the order of
    the cascade depends on them.
    """
    spark = counted.sparkSession
    sample = spark.createDataFrame(counted.take(rows), counted.schema).cache()
    try:
        sample.count()
        found = []
        for rule in rules:
            hits = sample.agg(F.count_if(rule.fails))
            hits.collect()  # compiles the plan
            began = time.perf_counter()
            rejected = hits.collect()[0][0]
            found.append(Measured(rule, time.perf_counter() - began, rejected))
        return found
    finally:
        sample.unpersist()


def ordered(measured: Sequence[Measured]) -> list[Rule]:
    """Most rejections per second first; of equals the cheaper one."""
    return [m.rule for m in sorted(measured, key=lambda m: (-m.gain, m.seconds))]


def cascade(rules: Sequence[Rule]) -> Column:
    """True where no rule rejects; rules after the first rejection are not asked."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(rule.fails, F.lit(False)).otherwise(kept)
    return kept


def judge(
    docs: DataFrame,
    rules: Sequence[Rule] | None = None,
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Add the base counts, ``base_failed`` and ``kept`` to every row."""
    rules = standard_rules(text) if rules is None else rules
    counted = base_counts(docs, text)
    chosen = rules
    if sample_rows and len(rules) > 1:
        passed = counted.where(~F.col("base_failed")).select(text, *COUNTS)
        chosen = ordered(measure(passed, rules, sample_rows))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(chosen))
    return counted.withColumn("kept", kept)
