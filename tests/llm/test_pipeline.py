"""The pipeline against a plain version of every stage."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import oracle
from scoreframe.llm import arrays, ngram_join, packing, queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def judged(con):
    rows = con.execute(queries.ORACLE["op2_quality_cascade"]).fetchall()
    return {r[0] for r in rows if r[-1]}


def heads(docs, k=5, percent=80):
    sets = {}
    for d, t in docs.items():
        w = WORD.findall(t.translate(LOWER))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, s in sets.items():
        for e, both in Counter(e for x in s for e in where[x]).items():
            if e != d and 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d for d in sets if root(d) == d}


def chunks(text):
    """(words, begin, end) of each chunk, by plain loops."""
    data = text.encode()
    words = [m for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    out, held, read = [], [], b""
    for i, m in enumerate(words):
        held.append(m)
        value, read = 0, read + m[0]  # the words with one blank between them
        for b in read[-arrays.GEAR_BYTES :]:
            value = ((value << 1) + int(arrays._GEAR[b])) % 2**32
        cut = len(read) >= arrays.GEAR_BYTES and (value >> 15) % substrings.AVERAGE_WORDS == 0
        if cut or len(held) == 32 or i == len(words) - 1:
            end = words[i + 1].start() if i + 1 < len(words) else len(data)
            out.append((tuple(x[0] for x in held), held[0].start(), end))
            held = []
        read = read[-arrays.GEAR_BYTES :] + b" "
    return out


def without_repeats(docs):
    seen, out = set(), {}
    for d in sorted(docs):
        data, late, found = docs[d].encode(), [], chunks(docs[d])
        for words, *_ in found:
            late.append(words in seen)
            seen.add(words)
        drop, i = [], 0
        while i < len(found):
            j = i
            while j < len(found) and late[j]:
                j += 1
            sizes = [len(found[x][0]) for x in range(i, j)]
            strong = sum(n for n in sizes if n >= substrings.STRONG_WORDS)
            if sum(sizes) >= substrings.MIN_WORDS and (
                4 * strong >= 3 * substrings.MIN_WORDS or sum(sizes) >= 2 * substrings.MIN_WORDS
            ):
                drop.append((found[i][1], found[j - 1][2]))
            i = max(j, i + 1)
        kept, at = b"", 0
        for a, b in drop:
            kept += data[at:a]
            at = b
        out[d] = (kept + data[at:]).decode()
    return {d: t for d, t in out.items() if WORD.search(t)}


def mixed(docs, sources):
    size = {d: len(WORD.findall(t)) for d, t in docs.items()}
    total = Counter()
    for d, n in size.items():
        total[sources[d]] += n
    names = sorted(total, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, aim = set(), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        aim = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if aim[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in names:
        left = int(math.floor(aim.get(s, 2 * total[s]) + 1e-9))
        mine = sorted((hashlib.md5(f"mix:{d}".encode()).hexdigest(), d) for d in docs if sources[d] == s)
        while left > 0:
            for _, d in mine:
                take = min(left, size[d])
                left -= take
                if take == size[d] > 0:
                    out.append((d, docs[d]))
                elif take > 0:
                    out.append((d, " ".join(WORD.findall(docs[d])[:take])))
    return out


def test_run_equals_the_plain_version(spark, sf_dir):
    import numpy as np
    from tokenizers import Tokenizer

    con = oracle.connect(sf_dir)
    rows = con.execute("SELECT doc_id, text, source FROM documents").fetchall()
    sources = {d: s for d, _, s in rows}
    good = judged(con)
    docs = {d: t for d, t, _ in rows if d in good}
    first = heads(docs)
    docs = without_repeats({d: t for d, t in docs.items() if d in first})
    want = []
    final = mixed(docs, sources)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    for (d, _), x in zip(final, tokenizer.encode_batch([t for _, t in final], add_special_tokens=False)):
        ids = np.array([*x.ids, 1], "<u4")
        want += [(d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
                 for k in range(0, len(ids), 4096)]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    ends = Counter()
    for r in got:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096
    assert len(ends) <= math.ceil(sum(ends.values()) / 4096) + 1


def test_every_stage_keeps_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(0).unionByName(docs.limit(30)).unionByName(docs.limit(2))
    odd = odd.unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (10**9, None, "en", None, None), (10**9 + 1, "", None, "x", 0)],
        docs.schema))
    for frame in (odd, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.saved(stage(spark, frame, sf_dir), "test-stage")
            if name != "best-fit packing":
                assert out.columns == list(corpus_pipeline.COLUMNS)
                assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert (out.count() > 0) == (frame is odd)


def test_stages_bound_the_bytes_of_a_batch(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.createDataFrame([(1, "one two three four five")], "doc_id long, text string")
    wanted = spark.createDataFrame([(1, 1)], "doc_id long, key long")
    for stage in (
        lambda: substrings.repeats(rows, 4, 2, 2), lambda: ngram_join.describe(rows, 4),
        lambda: ngram_join.load_sets(rows, wanted, 4), lambda: packing.tokenise(rows, "unread"),
    ):
        spark.conf.unset(key)
        stage()
        assert int(spark.conf.get(key)) <= 4_000_000
    spark.conf.set(key, "9000000")  # what a session sets itself stays
    packing.tokenise(rows, "unread")
    assert spark.conf.get(key) == "9000000"
    spark.conf.unset(key)
