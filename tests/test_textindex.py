"""The trigram index finds what the scan finds; the pruned token match equals the plain one; hot words and many groups."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreframe.operators import stats, textindex, textscores, tokens
from scoreframe.operators.views import search
from scoreframe.plans.scale import spread_join

ROWS = [
    (1, "The MIT License", "en"), (2, "mit", None), (3, None, "THE"), (4, "", ""),
    (5, "Straße nach \U0001f600\U0001f601 Süden", "de"), (6, "a\nbc the end", "x"), (7, "the" * 40, "the"),
    (8, "lice", "nse"), (9, "ab", "THEATRE"), (7, "the" * 40, "the"), (10, "100% $1 [x]", "ÀÉ"),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    table = spark.createDataFrame(ROWS, "n long, `a text` string, lang string")
    path = str(tmp_path_factory.mktemp("index") / "i")
    textindex.store_search_index(table, path, parts=3, buckets=5)
    return table, path


@pytest.mark.parametrize("text", ["the", "THE", "license", "nsens", "\U0001f600\U0001f601 S", "\U0001f601 süd",
                                  "A\nB", "% $1 [", "àé", "no such text", "thethethe", "mit", "a", "", "10"])
def test_index_finds_what_the_scan_finds(spark, index, text):
    table, path = index
    key = lambda df: sorted(map(repr, df.collect()))
    found = textindex.search_stored(spark, path, text)
    assert found.columns == table.columns
    assert key(found) == key(search(table, text))
    if text in ("the", "mit"):
        assert key(textindex.search_stored(spark, path, text, ["lang"])) == key(search(table, text, ["lang"]))


def test_index_reads_candidates_only(spark, index):
    held = textindex.candidates(spark, index[1], "license", ["a text", "lang"])
    assert held.count() == 1  # row 8 has the letters in two columns
    with pytest.raises(ValueError, match="without an index"):
        textindex.search_stored(spark, index[1], "the", ["other"])


def test_index_of_long_texts_and_of_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "SLICE", 10)
    long = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz" * 3), (2, "x" * 25)], "n long, t string")
    textindex.store_search_index(long, str(tmp_path / "l"), ["t"], buckets=3)
    for text, found in (("jkl", [1]), ("ijk", [1]), ("yzabc", [1]), ("xxxxx", [2]), ("lkj", [])):
        assert [r.n for r in textindex.search_stored(spark, str(tmp_path / "l"), text).collect()] == found
    textindex.store_search_index(long.limit(0), str(tmp_path / "e"), buckets=3)
    assert textindex.search_stored(spark, str(tmp_path / "e"), "abc").count() == 0


def test_index_shuffles_lists_of_rows(spark, tmp_path):
    table = spark.range(0, 500, 1, 2).select("id", F.concat(F.lit("the same words of row "), "id").alias("t"))
    textindex.store_search_index(table, str(tmp_path / "s"), ["t"], buckets=2)
    stored = spark.read.parquet(str(tmp_path / "s/postings"))
    entries = spark.read.parquet(str(tmp_path / "s/grams")).agg(F.sum("rows")).first()[0]
    assert entries > 10_000 and stored.count() < entries / 10
    assert textindex.search_stored(spark, str(tmp_path / "s"), "row 49").count() == 11


def _tokens(spark, texts):
    rows = [(key, at, [float(x) for x in v]) for key, vectors in texts.items() for at, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id string, pos long, vector array<float>")


def _close(a, b):
    a, b = ({r.id: tuple(r)[1:] for r in df.collect()} for df in (a, b))
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_pruned_match_equals_the_plain_one(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 8)) * 4

    def near(n):
        return centres[draw.integers(0, 12, n)] + draw.normal(size=(n, 8)) * 0.05

    pred = _tokens(spark, {"hot": near(900), "a": near(3), "zero": np.zeros((2, 8)), "only": near(2)})
    ref = _tokens(spark, {"hot": near(700), "a": near(40), "zero": near(2), "other": near(2)})
    _close(tokens.embedding_match_pruned(pred, ref, block=16), tokens.embedding_match(pred, ref))
    left, right = (tokens.direction_blocks(side, 16) for side in (pred, ref))
    kept = tokens.surviving_pairs(left, right).filter("id = 'hot'").count()
    assert kept < 0.6 * left.filter("id = 'hot'").count() * right.filter("id = 'hot'").count()


def test_pruned_match_of_nothing(spark):
    none = _tokens(spark, {"a": [[1, 0]]}).limit(0)
    assert tokens.embedding_match_pruned(none, none).count() == 0
    one = tokens.embedding_match_pruned(_tokens(spark, {"a": [[1, 0]]}), none).first()
    assert tuple(one) == ("a", 0.0, 0.0, 0.0)


def test_lexicon_meets_hot_words_in_parts(spark, monkeypatch):
    rows = [(i, f"the cat number{i} sat", f"a feline number{i} sat down the") for i in range(30)]
    frame = spark.createDataFrame([*rows, (30, None, "x"), (31, "", "")], "id long, prediction string, reference string")
    lexicon = spark.createDataFrame([("cat", "feline"), ("the", "a"), ("the", "this"), ("dog", "hound")],
                                    "word string, synonym string")
    key = lambda df: sorted((r.id, r.meteor) for r in df.collect())
    broadcast = key(textscores.meteor(frame, synonyms=lexicon))
    monkeypatch.setattr(textscores, "spread_join", partial(spread_join, rows_per_salt=4))
    assert key(textscores.meteor(frame, synonyms=lexicon, broadcast_rows=0)) == broadcast
    assert dict(broadcast)[0] > dict(key(textscores.meteor(frame)))[0]


def test_poisson_sums_leave_within_a_batch(spark, monkeypatch):
    rows = [(f"r{i % 40}", str(i), "m", float(i % 7)) for i in range(400)]
    scores = spark.createDataFrame(rows, "inference_id string, id string, metric string, value double")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(stats.poisson_means(scores, n_boot=5))
    monkeypatch.setattr(stats, "HELD_BYTES", 3 * 16 * 5)
    parts = key(stats.poisson_means(scores, n_boot=5))
    assert [r[:3] for r in whole] == [r[:3] for r in parts] and len(whole) == 200
    assert [r[3] for r in parts] == pytest.approx([r[3] for r in whole])
