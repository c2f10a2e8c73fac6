"""Byte-level BPE, ranked search and hard negatives: against libraries and brute force."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from pyspark.sql import functions as F

from scoreframe.llm import base, bpe, lexical, negatives

RANKS = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def hostile_texts(ranks, n, seed=3):
    rng, tokens = random.Random(seed), [t.decode(errors="ignore") for t in ranks]
    for _ in range(n):
        yield rng.choice([
            lambda: "".join(rng.choice(tokens) for _ in range(rng.randrange(1, 8))),
            lambda: "".join(rng.choice("abeinrst'") for _ in range(rng.randrange(1, 60))),
            lambda: (rng.choice(tokens).strip() or "x") * rng.randrange(1, 40),
            lambda: "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x3000),
                                            rng.randrange(0x4E00, 0xA000), rng.randrange(0x1F300, 0x1F700)]))
                            for _ in range(rng.randrange(1, 30))),
            lambda: rng.choice("a =-_0\n.eé　") * rng.randrange(1, 400),
            lambda: "".join(rng.choice(["'s", "'re", "'ll", "'v", "\n", " ", "  ", "\t", " ", "ab", "7", "!?", "É"])
                            for _ in range(rng.randrange(1, 20))),
        ])()


def test_transducer_gives_what_the_library_gives(ranks, library):
    split = bpe.splitter(PATTERN)
    coders = [bpe.Transducer(ranks), bpe.Transducer(ranks, most_states=50, most_pieces=5)]
    for text in ["", *hostile_texts(ranks, 3000)]:
        want = library.encode_ordinary(text)
        assert [list(c.encode(text, split)) for c in coders] == [want, want], repr(text)
    assert coders[0].longest_wait < 40  # bytes that wait for their token
    assert len(coders[1].states) <= 51 and len(coders[1].recent) <= 5


def test_one_piece_of_any_length(ranks, library):
    coder = bpe.Transducer(ranks, most_states=1000)
    for piece in ["ab" * 5000, "é" * 3001, "".join(random.Random(1).choices("etaoin", k=20_000))]:
        assert coder.run(piece.encode()) == library._encode_single_piece(piece)


def test_a_token_that_merging_does_not_reach(ranks):
    odd = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 300, b"bcd": 301, b"bc": 310}
    library = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=odd, special_tokens={})
    coder, split = bpe.Transducer(odd), bpe.splitter(PATTERN)
    for text in ("bcd", "abcd", "xbcd bcd", "abc", "bcdbcd", "aabcd", "bc abcbc"):
        assert list(coder.encode(text, split)) == library.encode_ordinary(text), text


@pytest.mark.parametrize("pattern", [PATTERN, r"\p{L}+|[^\p{L}]"])
def test_pieces_are_the_matches_of_the_pattern(ranks, pattern):
    split, compiled = bpe.splitter(pattern), regex.compile(pattern)
    for text in ["", "don't 'S's  's\n\n x", *hostile_texts(ranks, 500, seed=8)]:
        assert [p for some in split(text) for p in some] == compiled.findall(text)
    long = "\n".join(hostile_texts(ranks, 30_000, seed=9))
    assert len(long) > 2 * bpe.SLICE_CHARS
    assert [p for some in split(long) for p in some] == compiled.findall(long)


def test_decoding_goes_on_inside_characters(ranks):
    tokens = {rank: token for token, rank in ranks.items()}
    rng = random.Random(5)
    decoder = bpe.Decoder(tokens)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(256), rng.randrange(len(ranks))]) for _ in range(rng.randrange(30))]
        parts = [decoder.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)] + [decoder.finish()]
        assert "".join(parts) == b"".join(tokens[i] for i in ids).decode(errors="replace")


def test_a_worker_keeps_little(ranks):
    """Every task slot has such a worker, beside the decoder and the executor itself."""
    tracemalloc.start()
    try:
        coder, rng = bpe.Transducer(ranks, 40_000, 50_000), random.Random(4)
        before = tracemalloc.get_traced_memory()[0]
        for _ in range(100_000):
            coder.piece(" " + "".join(rng.choices("etaoinshrdlu", k=9)))
        held = tracemalloc.get_traced_memory()[0] - before
        assert len(coder.older) == 50_000 and len(coder.states) == 40_000
        assert held < 72_000_000
    finally:
        tracemalloc.stop()


def test_batches_of_whole_texts_end_by_bytes(spark):
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))
    bpe.encode(docs, RANKS, PATTERN)  # from here on the session has small batches

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert len(got) > 1 and max(got) <= 2 * base.BATCH_BYTES


def test_encode_and_decode_rows(spark, library):
    long = "Überlänge, don't ask.\n" * 30_000
    rows = [(1, "plain text"), (2, None), (3, ""), (3, "plain text"), (3, "plain text"), (None, "x"), (4, long)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS).collect()
    want = [(d, library.encode_ordinary(t or ""), t or "") for d, t in rows]
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(docs.limit(0), RANKS, PATTERN), RANKS).count() == 0


def test_op11_on_the_given_documents(spark, sf_dir, library):
    from scoreframe.llm import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op11_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


TERM = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_rank(docs, items, k):
    lists = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    lists = [(d, c) for d, c in lists if c]
    n_docs, n_terms = len(lists), sum(sum(c.values()) for _, c in lists)
    df = Counter(t for _, c in lists for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in lists:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of a".split()) if rng.random() < 0.4 else f"wörd{int(rng.expovariate(0.02))}"
    docs = [(i, rng.choice([" ", "-", "\n"]).join(word().upper() if rng.random() < 0.1 else word()
                                                 for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(n)]
    docs += [(n, None), (None, "the wörd1 wörd2"), (3, "wörd3 wörd4"), (3, "wörd3 wörd4 the"), *docs[:20]]
    docs += [(n + 1 + i, "wörd7 wörd8 copied text") for i in range(100)]  # ties beyond k
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 12, 30])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "nowhere"), (93, "wörd7 WÖRD8 wörd7 copied"), (None, "wörd1"), (4, "wörd1 wörd2")]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"owners": 5, "block_postings": 150, "bundle_terms": 40}, {"owners": 1}])
def test_ranked_search_is_brute_force(spark, sizes):
    docs, items = corpus(1, 120)
    got = lexical.rank(
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"),
        spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, row int"), k=10, **sizes)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_rank(docs, items, 10)


def test_ranked_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.rank(docs.limit(0), items).count() == 0
    assert lexical.rank(docs.where("text is null"), items).count() == 0
    assert lexical.rank(docs, items.limit(0)).count() == 0


def test_terms_of_a_long_text_are_counted_across_slices(spark):
    text = "ab Cd-é " * 200_000
    rows = spark.createDataFrame([(1, "x"), (2, text), (3, "ab")], "doc_id long, text string")
    got = {r.id: (r.n, sorted(r.tfs)) for r in lexical.count_terms(rows, "doc_id", "text").collect()}
    assert got == {1: (1, [1]), 2: (600_000, [200_000] * 3), 3: (1, [1])}


def brute_negatives(rows, positives, k):
    def whole(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]

    rows = [(i, l, whole(v)) for i, l, v in rows]
    rows = [r for r in rows if None not in r]
    out = []
    for i, label, v in {(i, l, tuple(v)) for i, l, v in rows if i % 10 == 0}:
        near = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows if j != i and len(w) == len(v)]
        for s, p in sorted((s, j) for s, j, m in near if m == label)[:positives]:
            hard = sorted((t, j) for t, j, m in near if m != label and 30 * -s <= 100 * -t <= 90 * -s)[:k]
            out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"slot_values": 300, "chunk_values": 40, "centres": 4}])
def test_hard_negatives_are_brute_force(spark, sizes):
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, rng.randrange(4), [x + rng.gauss(0, 0.4) for x in rng.choice(base)]) for i in range(300)]
    rows += [(300 + i, i % 4, [0.5] * 6) for i in range(60)]  # one vector that many share
    rows += [(400, None, [1.0] * 6), (None, 1, [1.0] * 6), (410, 1, None), (420, 1, [1.0, None] + [0.0] * 4),
             (430, 1, [float("nan")] * 6), (440, 1, [float("inf")] * 6), (450, 2, []), (451, 2, []), (460, 1, [0.0] * 6),
             (470, 1, [1.0, 2.0]), (471, 1, [1.0, 1.0]), (472, 2, [1.0, 0.5]), rows[0], rows[0], (10, 3, [0.1] * 6)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, slot int")
    got = negatives.mine(frame, F.col("vec_id") % 10 == 0, **sizes)
    want = brute_negatives(rows, 5, 10)
    assert len(want) > 500
    assert sorted(map(tuple, got.collect())) == want


def test_hard_negatives_of_nothing(spark):
    rows = spark.createDataFrame([(1, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    for some in (rows, rows.limit(0)):
        assert negatives.mine(some, F.col("vec_id") % 10 == 0).count() == 0


def test_a_walk_stops_early():
    rng = np.random.default_rng(4)
    import pyarrow as pa

    x = np.floor(256 * np.concatenate([rng.normal([3] * 8, 0.1, (300, 8)), rng.normal([-3] * 8, 0.1, (20_000, 8))]))
    block = negatives._Candidates(pa.table({"id": np.arange(len(x)), "label": np.zeros(len(x), np.int64),
                                            "v": pa.array(list(x))}))
    order, bound = block.shared_list(x[:5], negatives._directions(x[:5].sum(axis=0, keepdims=True))[0])
    scored = []
    real = block.scores
    block.scores = lambda rows, a: scored.append(len(rows)) or real(rows, a)
    negatives._walk(block, order, bound, x[0], 0, lambda r: np.ones(len(r), bool), 0, np.array([2**60]), 10)
    assert sum(scored) < 1000
