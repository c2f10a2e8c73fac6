"""Jaccard join, substring dedup, top-k search: against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from scoreframe.llm import arrays, components, ngram_join, substrings, topk

DOC = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def prose(rng, n):
    return [rng.choice("ab cde fg hijk lm éß \U0001f600x no pqr st".split()) + str(rng.randrange(300))
            for _ in range(n)]


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_join(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            e, b = sets[j]
            both = len(a & b)
            if a and b and d is not None and e is not None and (
                    100 * both >= percent * (len(a) + len(b) - both)):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, a) in enumerate(sets):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(a), low[root(i)] if d is not None else None)
                   for i, (d, a) in enumerate(sets)), key=repr)


def near_copies(seed, families=12, copies=9):
    rng, rows, n = random.Random(seed), [], 0
    for _ in range(families):
        base = prose(rng, rng.choice([1, 3, 4, 5, 20, 60, 200]))
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 18) + 1)):
                text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
            sep = rng.choice([" ", "\n", "\t "])
            rows.append((n * 3 % 1009, sep.join(text).upper() if n % 5 == 0 else sep.join(text)))
            n += 1
    rng.shuffle(rows)
    return rows


EDGE = [(5000, None), (5001, ""), (5002, " \t"), (5003, "one"), (5004, "ONE"), (5005, "a b c d"),
        (5006, "A b  c\nd"), (5007, "a b c"), (None, "a b c d"), (5005, "a b c d"),
        (5008, "x " * 20_000), (5009, "x y " * 9000 + "z")]


@pytest.mark.parametrize("k, percent, seed", [(4, 85, 1), (5, 80, 2), (2, 50, 3)])
def test_join(spark, k, percent, seed):
    rows = near_copies(seed) + EDGE
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    got = sorted(map(tuple, ngram_join.join(docs, k, percent).collect()), key=repr)
    assert got == brute_join(rows, k, percent)


@pytest.mark.parametrize("seed", [4, 5])
def test_join_of_groups_in_many_blocks(spark, seed):
    """Chains through blocks: a family is far larger than a block."""
    rng, rows = random.Random(seed), []
    for f in range(3):
        text = prose(rng, 90)
        for i in range(40):  # each copy drifts from the one before
            for _ in range(2):
                text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
            rows.append((f * 100 + i, " ".join(text)))
    docs = spark.createDataFrame(rows, DOC)
    want = brute_join(rows, 4, 80)
    for size in (3, 7, 1000):
        got = ngram_join.join(docs, 4, 80, block_sets=size).collect()
        assert sorted(map(tuple, got), key=repr) == want


@pytest.mark.parametrize("size", [3, 2000])
def test_texts_under_one_id_link_on_their_own(spark, size):
    first, second = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows = [(5, " ".join(first)), (5, " ".join(second)), (7, " ".join(first + ["more"])),
            (9, " ".join(second + ["more"])), (11, "a text by itself, of some words")]
    rows += [(None if d is None else 100 + d // 4, t) for d, t in near_copies(6)]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    got = sorted(map(tuple, ngram_join.join(docs, 4, 85, block_sets=size).collect()), key=repr)
    assert got == brute_join(rows, 4, 85)
    kept = [r.doc_id for r in ngram_join.keep_one(docs.where("doc_id < 12")).collect()]
    assert sorted(kept) == [5, 5, 11]


def test_join_of_nothing_and_small_buffers(spark, monkeypatch):
    assert ngram_join.join(spark.createDataFrame([], DOC)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], DOC)
    assert sorted(map(tuple, ngram_join.join(blank).collect())) == [(1, 0, 1), (2, 0, 2)]
    monkeypatch.setattr(ngram_join, "FLUSH_TOKENS", 50)
    monkeypatch.setattr(ngram_join, "BUCKET_TOKENS", 40)
    monkeypatch.setattr(arrays, "SLICE_BYTES", 100)
    rows = near_copies(8, families=5)
    got = ngram_join.join(spark.createDataFrame(rows, DOC), 4, 85).collect()
    assert sorted(map(tuple, got), key=repr) == brute_join(rows, 4, 85)


@pytest.mark.parametrize("hot_sets", [2, 5])
@pytest.mark.parametrize("seed", range(4))
def test_a_mark_of_all_sets_takes_few_places_per_buffer(monkeypatch, seed, hot_sets):
    monkeypatch.setattr(ngram_join, "FLUSH_TOKENS", 200)
    monkeypatch.setattr(ngram_join, "HOT_SETS", hot_sets)
    rng, buckets, parts = random.Random(seed), 3, 4
    hot = 2**63 + 12345
    sets = {}
    for key in range(-60, 60):
        sets[key] = {hot, *(rng.randrange(200) * (2**55 + 7) for _ in range(rng.randint(0, 20)))}
    dealer, batches = ngram_join._Dealer(buckets, parts), []
    stream = [*sets, *rng.choices(list(sets), k=200), *[7] * 500]
    rng.shuffle(stream)
    for key in stream:
        if dealer.add(key, np.array(sorted(sets[key]), np.uint64)):
            batches.append(dealer.flush())
    batches += [last] if (last := dealer.flush()) is not None else []
    table = pa.Table.from_batches(batches)
    shared, places = {}, 0
    for bucket in set(table["bucket"].to_pylist()):
        part = table.filter(pa.compute.equal(table["bucket"], bucket))
        if bucket >= 0:
            marks = np.concatenate([np.frombuffer(x, np.uint32) for x in part["tokens"].to_pylist()])
            places += (marks == hot >> 32).sum() if bucket == hot % buckets else 0
        for _, keys, hits in ngram_join._marks_shared(part, parts):
            for key, n in zip(np.frombuffer(keys, np.int64), np.frombuffer(hits, np.int32)):
                shared[int(key)] = shared.get(int(key), 0) + int(n)
    assert 1 <= places < hot_sets * len(batches) and len(batches) < len(stream) / 5
    for key, tokens in sets.items():
        others = set().union(*(s for k, s in sets.items() if k != key))
        assert shared.get(key, 0) >= len(tokens & others) > 0


def test_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(7, base, 1), (3, base + " more", 2), (9, base, 3), (11, "quite another text", 4),
            (11, "quite another text", 4), (None, base, 5), (12, None, 6), (13, "", 7)]
    docs = spark.createDataFrame(rows, DOC + ", digest int")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.digest) for r in kept.collect()), key=repr) == sorted(
        [(3, 2), (11, 4), (None, 5), (12, 6), (13, 7)], key=repr)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    links += [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 80)]
    got = {r.node: r.label for r in
           components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {}
    for a, b in links:
        if a != b:
            want.setdefault(a, {a}), want.setdefault(b, {b})
            if want[a] is not want[b]:
                want[a] |= want[b]
                for x in want[b]:
                    want[x] = want[a]
    assert got == {x: min(s) for x, s in want.items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_match_the_pattern():
    texts = ["", None, "  ", "a", " a\tb\x0bc\x0cd\r\ne ", "é ß  x", "x" * 50, "a  b"]
    column = pa.array(texts * 3, pa.string()).slice(1)
    want = [WORD.findall(t or "") for t in (texts * 3)[1:]]
    for limit in (1, 7, 10**6):
        got = []
        for _, data, offsets in arrays.slices(column, limit):
            starts, stops, at = arrays.find_words(data, offsets)
            raw = data.tobytes()
            got += [[raw[a:b].decode() for a, b in zip(starts[i:j], stops[i:j])]
                    for i, j in zip(at, at[1:])]
        assert got == want


# --- substrings -------------------------------------------------------------------


def dedupe(spark, rows, schema=DOC, **options):
    return substrings.dedupe(spark.createDataFrame(rows, schema), **options)


def test_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(11)
    passages = [" ".join(prose(rng, 60 + 10 * i)) for i in range(4)]
    rows, planted = [], {}
    for d in range(120):
        words = prose(rng, rng.randrange(30, 200))
        if d % 3 == 0:
            at = rng.randrange(len(words))
            p = d // 3 % 4
            text = " ".join(words[:at]) + "\n" + passages[p] + "\n" + " ".join(words[at:])
            planted[d] = (p, len(words))
        else:
            text = " ".join(words)
        rows.append((d, text))
    got = {r.doc_id: r for r in dedupe(spark, rows).collect()}
    text = dict(rows)
    first = {}
    for d, (p, own) in sorted(planted.items()):
        r = got[d]
        if first.setdefault(p, d) == d:
            assert r.text == text[d] and r.n_spans == 0
        else:
            size = len(passages[p].split())
            assert size - 28 <= r.removed_words <= size
            assert len(r.text.split()) == own + size - r.removed_words
            assert r.removed_chars == len(text[d]) - len(r.text)
    for d in set(text) - set(planted):
        assert got[d].text == text[d] and got[d].removed_words == 0


def test_copies_keep_the_smallest_id(spark):
    rng = random.Random(12)
    body = " ".join(prose(rng, 100))
    got = {r.doc_id: r for r in dedupe(spark, [(5, body), (2, body), (9, body), (4, "short one")]).collect()}
    assert got[2].text == body and got[4].text == "short one"
    assert got[5].text == got[9].text == "" and got[5].removed_words == 100


def test_shift_by_an_insertion(spark):
    rng = random.Random(13)
    words = prose(rng, 300)
    other = words[:150] + ["inserted"] + words[150:]
    got = {r.doc_id: r for r in dedupe(spark, [(1, " ".join(words)), (2, " ".join(other))]).collect()}
    assert got[2].removed_words > 260 and "inserted" in got[2].text


def test_substring_edges(spark, monkeypatch):
    rng = random.Random(14)
    body = " ".join(prose(rng, 90))
    rows = [(1, None, 1), (2, "", 2), (3, " \n", 3), (None, body, 4), (None, body, 5), (6, body, 6),
            (6, body, 6), (7, "tick " * 5000, 7), (8, body + " " + body, 8), (6, "other " + body[::-1], 9)]
    schema = DOC + ", n_spans int"
    for size in (10**6, 50):
        monkeypatch.setattr(substrings, "FLUSH_CHUNKS", size)
        monkeypatch.setattr(arrays, "SLICE_BYTES", size)
        out = dedupe(spark, rows, schema)
        got = [tuple(r) for r in out.select("doc_id", "text").collect()]
        assert len(got) == len(rows)
        assert got.count((None, body)) == 2 and got.count((6, body)) == 2
        assert (1, None) in got and (2, "") in got and (3, " \n") in got
        assert (6, "other " + body[::-1]) in got
        left = dict(g for g in got if g[0] in (7, 8))
        assert len(left[7].split()) <= 64
        assert len(left[8].split()) < 60
    assert dedupe(spark, [], DOC).count() == 0


def test_spans_too_large_to_broadcast(spark, monkeypatch):
    rng = random.Random(15)
    body = " ".join(prose(rng, 100))
    rows = [(i, body + " " + " ".join(prose(rng, 20))) for i in range(30)]
    want = sorted(map(tuple, dedupe(spark, rows).collect()))
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, dedupe(spark, rows).collect())) == want


# --- top-k -------------------------------------------------------------------------


def brute_topk(rows, k, every):
    whole = [(i, [int(np.floor(1024.0 * np.float64(np.float32(x)))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in whole if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole
                        if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("width, n, k", [(1, 30, 10), (7, 300, 3), (64, 900, 10)])
def test_topk(spark, width, n, k):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[n // 2 :: 3] = x[0]  # a very common vector: ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(20, None), (40, []), (60, []), (61, [float("nan")] * width), (62, [float("inf")] * width),
             (63, [None] * width), (80, [1.0, 2.0]), (81, [3.0, -1.0]), (None, rows[0][1]), rows[3]]
    df = spark.createDataFrame(rows, VECTORS)
    for options in ({}, {"slot_rows": 13, "chunk_queries": 2}):
        got = topk.search(df, F.col("vec_id") % 20 == 0, k=k, **options).collect()
        assert sorted(map(tuple, got)) == brute_topk(rows, k, 20)


def test_topk_few_and_none(spark):
    one = spark.createDataFrame([(100, [1.0, 2.0])], VECTORS)
    assert topk.search(one, F.col("vec_id") % 100 == 0).count() == 0
    two = spark.createDataFrame([(100, [1.0, 2.0]), (1, [0.5, -1.0])], VECTORS + "")
    assert [tuple(r) for r in topk.search(two, F.col("vec_id") % 100 == 0).collect()] == [
        (100, 1, 1, 1024 * 512 - 2048 * 1024)]
    assert topk.search(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x = np.floor(1024 * rng.normal(size=(200, 48)))
    exact = x @ x.T
    last = None
    for segments in topk._levels(48):
        stats = topk._stats(x, segments)
        bound = stats @ stats.T
        assert (bound + 1e-3 >= exact).all()
        if last is not None:
            assert bound.mean() <= last.mean() + 1e-6  # finer is tighter
        last = bound


def test_copied_passages_are_found_however_they_are_wrapped(spark):
    rng, rows = random.Random(7), []
    for i in range(30):
        passage = [f"w{rng.randrange(10**7)}" for _ in range(80)]
        around = [[f"x{rng.randrange(10**7)}" for _ in range(60)] for _ in range(2)]
        wrapped = "".join(w + ("\n" if k % 8 == 7 else "  " if k % 3 == 0 else " ") for k, w in enumerate(passage))
        rows += [(i, " ".join([*around[0], *passage])), (100 + i, wrapped + " ".join(around[1]))]
    got = {r.doc_id: r.removed_words for r in substrings.dedupe(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[i] == 0 for i in range(30))
    assert min(got[100 + i] for i in range(30)) >= 50 and sum(got[100 + i] for i in range(30)) >= 30 * 60
