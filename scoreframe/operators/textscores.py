"""METEOR with a synonym table of any size."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.overlap import meteor_row, meteor_tokens, porter_stem
from ..plans.scale import BROADCAST_ROWS, cut, fits, spread_join


def _words(df: DataFrame, column: str) -> DataFrame:
    """Distinct METEOR tokens of a text column: ``__row, word``."""

    @F.arrow_udf("array<string>")
    def words(texts: pa.Array) -> pa.Array:
        return pa.array(
            [sorted(set(meteor_tokens(t))) if t is not None else [] for t in texts.to_pylist()],
            pa.list_(pa.string()),
        )

    # The outer form: a plain explode adds a filter that tokenizes again.
    return df.select("__row", F.explode_outer(words(F.col(column))).alias("word")).filter(
        F.col("word").isNotNull()
    )


def _row_synonyms(
    df: DataFrame, synonyms: DataFrame, pred: str, refs: str, small: bool
) -> DataFrame:
    """Lexicon entries each row can use, as ``__pairs`` next to the row.

    The lexicon meets the words by joins and never comes to the driver: an
    entry reaches a row only if the prediction has the word and the reference
    has the synonym. A ``small`` lexicon is broadcast, which leaves the words,
    some of them in most rows, where they are. A larger one meets them in a salted
    join, which spreads the words that most rows have.
    """
    lexicon = synonyms.select("word", "synonym").distinct()
    keyed = df.withColumn("__row", F.xxhash64(pred, refs))
    texts = keyed.select("__row", pred, refs).dropDuplicates(["__row", pred, refs])
    flat = texts.select("__row", F.array_join(refs, " ").alias("__ref"))
    words = _words(texts.select("__row", pred), pred)
    if small:
        left = words.join(F.broadcast(lexicon), "word")
    else:
        left = spread_join(cut(words), lexicon, ["word"], ["__row"])
    right = _words(flat, "__ref").withColumnRenamed("word", "synonym").distinct()
    pairs = (
        left.distinct()
        .join(right, ["__row", "synonym"])
        .groupBy("__row")
        .agg(F.collect_set(F.struct("word", "synonym")).alias("__pairs"))
    )
    return keyed.join(pairs, "__row", "left").drop("__row")


def meteor(
    df: DataFrame,
    pred: str = "prediction",
    ref: str = "reference",
    synonyms: DataFrame | None = None,
    alpha: float = 0.9,
    beta: float = 3.0,
    gamma: float = 0.5,
    stem: Callable[[str], str] = porter_stem,
    name: str = "meteor",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the METEOR score of each row.

    ``ref`` is a text or an array of texts (the best one counts). ``synonyms``
    is a table ``word, synonym``, joined in word by word; up to
    ``broadcast_rows`` entries are broadcast. A null text has no score.
    """
    refs = "__refs"
    multiple = df.schema[ref].dataType.typeName() == "array"
    rows = df.withColumn(refs, F.col(ref) if multiple else F.array(ref))

    def best(prediction, references, related):
        if prediction is None or not references or any(r is None for r in references):
            return None
        return max(
            meteor_row(prediction, r, related, alpha, beta, gamma, stem) for r in references
        )

    if synonyms is None:

        @F.arrow_udf("double")
        def score(p: pa.Array, r: pa.Array) -> pa.Array:
            return pa.array(
                [best(a, b, {}) for a, b in zip(p.to_pylist(), r.to_pylist())], pa.float64()
            )

        return rows.withColumn(name, score(F.col(pred), F.col(refs))).drop(refs)

    @F.arrow_udf("double")
    def score_with(p: pa.Array, r: pa.Array, s: pa.Array) -> pa.Array:
        out = []
        for a, b, pairs in zip(p.to_pylist(), r.to_pylist(), s.to_pylist()):
            related: dict[str, set[str]] = defaultdict(set)
            for pair in pairs or []:
                related[pair["word"]].add(pair["synonym"])
            out.append(best(a, b, related))
        return pa.array(out, pa.float64())

    small = fits(synonyms, broadcast_rows)
    joined = _row_synonyms(rows, synonyms, pred, refs, small)
    return joined.withColumn(
        name, score_with(F.col(pred), F.col(refs), F.col("__pairs"))
    ).drop(refs, "__pairs")
