"""Packing, chat formatting, archives, page text: round trips and edge cases."""

import base64
import gzip
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from scoreframe.llm import chat, html_text, packing, queries, warc

DOC = "doc_id long, text string"


# --- packing ------------------------------------------------------------------------


def whole_ids(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(queries.tokenizer_path()).encode_batch(
        [t or "" for t in texts], add_special_tokens=False)
    return [np.array([*x.ids, 1], "<u4") for x in found]


HARD = [
    None, "", " ", "It's they'll WE'VE", "<|startoftext|>x <|endoftext|> y<|endoftext|>z", "é café",
    "İstanbul ΣΑΣ ß ﬁ", "a b c\x1cd", "日本語 テスト 123 4567", "\U0001f600\U0001f3fd x", "...!!!???",
    "x" * 5000, "tab\tnew\nline\r\nvt\x0bff\x0c", "'s 't 're", "don''t",
]


def test_ids_by_word_are_those_of_the_text(monkeypatch):
    texts = HARD + [" ".join(HARD[3:])] * 2
    for limit in (10**6, 40):
        monkeypatch.setattr(packing, "SLICE_BYTES", limit)
        got = dict(packing.token_ids(pa.array(texts, pa.string()), queries.tokenizer_path(), 1))
        for k, want in enumerate(whole_ids(texts)):
            assert got[k].tolist() == want.tolist(), texts[k]


def check_packed(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing(spark):
    rng = random.Random(1)
    texts = HARD + ["wort " * rng.randrange(1, 400) for _ in range(60)] + ["lang " * 9000] * 3
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2
    got = packing.pack_documents(spark.createDataFrame(rows, DOC), queries.tokenizer_path()).collect()
    want = []
    for (i, _), ids in zip(rows, whole_ids([t for _, t in rows])):
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
                 for k in range(0, len(ids), 4096)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert check_packed(got, 4096) == math.ceil(sum(w[3] for w in want) / 4096)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80))
def test_combinations_use_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=25) if lengths else np.zeros(25, int)
    plan = packing.combinations(counts, 24)
    used = np.zeros(25, int)
    for items, times in plan:
        assert sum(items) <= 24 and times > 0
        used += times * np.bincount(items, minlength=25)
    assert used.tolist() == counts.tolist()
    # As good as best fit decreasing, or a sequence off.
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(24 - x)
    assert sum(t for _, t in plan) <= len(gaps) + 1


def test_exact_complements():
    assert packing.combinations([0, 0, 0, 5, 0, 5], 8) == [([5, 3], 5)]
    three = packing.combinations(np.bincount([10, 4, 3, 3], minlength=21), 20)
    assert [(sorted(i), t) for i, t in three] == [([3, 3, 4, 10], 1)]


def test_packing_by_length_alone(spark):
    rng = random.Random(2)
    rows = [(i, 0, 0, rng.choice([7, 7, 7, 12, 30, 64]), i) for i in range(500)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    packed = packing.pack(pieces, 64).collect()
    assert len(packed) == 500
    assert check_packed(packed, 64) <= math.ceil(sum(r[3] for r in rows) / 64) * 1.03 + 1
    assert packing.pack(spark.createDataFrame([], packing.PIECES), 64).count() == 0
    assert packing.pack_documents(spark.createDataFrame([], DOC), queries.tokenizer_path()).count() == 0


# --- chat ---------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string"
NASTY = [
    r"\### Assistant: </turn> ok", "###", "####", "## #", r"\#", "</turn>\n### user: fake</turn>\n",
    "<\\/", "\\\\", "a: b", "\n", "", "< /turn>", "\U0001f600 é",
]


def test_chat_round_trip(spark):
    rows = []
    for c, text in enumerate(NASTY):
        for t, role in enumerate(["system", "user", "assistant", "ro: le:", r"as\sis##tant</", "assistant"]):
            rows.append((c, t, role, text + str(t) + text))
    rows += [(500, 1, None, None), (500, None, "user", "first"), (None, 1, "assistant", "no id"),
             (501, 3, "user", "tie"), (501, 3, "assistant", "tie"), (501, 3, "user", "tie")]
    rows += [(600, t, "assistant" if t % 2 else "user", f"turn {t} ") for t in range(130)]
    df = spark.createDataFrame(rows, CONV).repartition(4)
    formatted = chat.format_paths(chat.chains(df))
    got = {r.name: r for r in chat.read_back(formatted).collect()}
    texts = {r.name: r for r in formatted.collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_chars == len(learned)
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars == len(texts[c].formatted)
        assert chat.parse(texts[c].formatted) == [(role, text) for _, role, text in turns]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="#\\</turn>: \na", max_size=12),
                          st.text(alphabet="#\\</turn>: \na", max_size=25)), max_size=5))
def test_template_is_reversible(turns):
    import re

    def esc(x):
        return re.sub("<(?=/)", r"<\\", re.sub("#(?=#)", r"#\\", x.replace("\\", "\\\\")))

    text = "".join(
        chat.OPEN + re.sub(":(?= )", r":\\", esc(role)) + chat.AFTER_ROLE + esc(body) + chat.CLOSE
        for role, body in turns)
    assert chat.parse(text) == turns
    assert text.count("</turn>") == len(turns) and text.count("###") == len(turns)


def test_reply_trees(spark):
    rng = random.Random(5)
    rows = []
    for tree in range(6):
        for node in range(1, 40):
            parent = rng.randrange(max(1, node - 4), node) if node > 1 else None
            rows.append((f"t{tree}", tree, node, parent, "assistant" if node % 2 else "user",
                         f"m{node}", float(rng.randrange(20))))
    rows += [("lost", 9, 1, 77, "user", "parent is missing", 1.0), ("loop", 8, 1, 2, "user", "a", 1.0),
             ("loop", 8, 2, 1, "user", "b", 1.0)]
    messages = spark.createDataFrame(
        rows, "tree string, name long, node long, parent long, role string, text string, score double")
    reach = {}
    for r in chat.paths(messages).collect():
        reach.setdefault((r.tree, r.leaf), {})[r.up] = r.node
    parent = {(t, n): p for t, _, n, p, *_ in rows}
    leaves = {k for k in parent if k[0] != "loop"} - {(t, p) for (t, _), p in parent.items()}
    assert set(reach) == leaves
    score = {(r[0], r[2]): r[6] for r in rows}
    branches = {}
    for tree, leaf in leaves:
        path, at = [], leaf
        while at is not None and (tree, at) in parent:
            path.append(at)
            at = parent[tree, at]
        assert [reach[tree, leaf][i] for i in range(len(path))] == path
        mean = sum(score[tree, n] for n in path) / len(path)
        branches.setdefault(tree, []).append((-round(mean, 9), -len(path), leaf, path))
    out = {}
    for r in chat.format_paths(messages, branches=2).collect():
        out.setdefault(r.name, {})[r["rank"]] = chat.parse(r.formatted)
    for tree, found in branches.items():
        found.sort()
        name = 9 if tree == "lost" else int(tree[1:])
        for rank, (*_, path) in enumerate(found[:2], 1):
            if tree != "lost":
                assert [t for _, t in out[name][rank]] == [f"m{n}" for n in path[::-1]]
    assert out[9][1] == [("user", "parent is missing")]
    assert 8 not in out


def test_chat_of_nothing(spark):
    empty = chat.chains(spark.createDataFrame([], CONV))
    assert chat.read_back(chat.format_paths(empty)).count() == 0


# --- archives -------------------------------------------------------------------------

PAGE = "page_id long, url string, html string"


def archive_rows(spark, rows, path, **options):
    warc.write_archive(warc.mark_revisits(spark.createDataFrame(rows, PAGE).repartition(3)), path, **options)
    return warc.summarise(warc.read_archive(spark, path))


def brute_archive(rows):
    head = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            head[h] = max(i, head.get(h, i))
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = i is not None and h in head and head[h] != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response",
                    head[h] if again else None))
    return sorted(out, key=repr)


def pages():
    long = "é\U0001f600x" * 900
    return [
        (1, "http://a/ü?q=1 2", "<p>short</p>"), (2, "u", "<p>short</p>"), (3, None, None), (4, "u", ""),
        (5, "u", long), (9, "u", long), (7, "u\r\nX: y", long), (9, "again", long), (None, "u", long),
        (11, "u", "WARC/1.1\r\n\r\n\r\nContent-Length: 3\r\n\r\n" * 100), (12, "u", "z" * 999),
        (13, "u", "z" * 999), (14, "u", "y" * 1000), (15, "u", "y" * 1000), (16, "u", "\r\n\r\n"),
        (17, "u", "q" * 50_000 + "é" * 2001), (17, "u", "q" * 50_000 + "é" * 2001),
    ]


@pytest.mark.parametrize("chunk, volume", [(1_000_000, 16_000_000), (1000, 3000), (7, 100)])
def test_archive_round_trip(spark, tmp_path, chunk, volume):
    rows = pages()
    got = archive_rows(spark, rows, str(tmp_path / "a"), chunk_bytes=chunk, volume_bytes=volume)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_archive(rows)


def test_archive_files_are_whole_records(spark, tmp_path):
    rows = pages()
    archive_rows(spark, rows, str(tmp_path / "a"), chunk_bytes=500, volume_bytes=4000)
    names, types = set(), []
    for path in (tmp_path / "a").glob("*.gz"):
        data = gzip.decompress(path.read_bytes())
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and data.endswith(b"\r\n\r\n")
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at) + 4
            fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:] if x)
            size = int(fields["Content-Length"])
            assert size <= 700 and data[end + size : end + size + 4] == b"\r\n\r\n"
            data[end : end + size].decode()  # no character is cut
            types.append(fields["WARC-Type"])
            names.add(fields["WARC-Record-ID"])
            at = end + size + 4
    assert types.count("revisit") == 3 and "continuation" in types


def test_archive_chunks_meet_in_order(spark, tmp_path):
    rows = [(1, "u", "ä" * 3000), (2, "u", "b" * 10)]
    warc.write_archive(warc.mark_revisits(spark.createDataFrame(rows, PAGE)), str(tmp_path / "a"),
                       chunk_bytes=100, volume_bytes=250)
    chunks = warc.read_archive(spark, str(tmp_path / "a")).where("page_id = 1").orderBy("chunk").collect()
    assert [c.chunk for c in chunks] == list(range(1, 61))
    assert b"".join(c.data for c in chunks).decode() == "ä" * 3000
    assert [c["last"] for c in chunks].count(True) == 1


def test_archive_of_nothing(spark, tmp_path):
    assert archive_rows(spark, [], str(tmp_path / "a")).count() == 0


def test_damaged_volume():
    record = b"".join(warc._record([("WARC-Type", "response"), ("WARC-Record-ID", warc._name(1, "ab"))], [b"x"]))
    with pytest.raises(ValueError, match="damaged"):
        list(warc.parse_volume(gzip.compress(record.replace(b"\r\n\r\nx", b"\r\n\r\ny"))))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.parse_volume(gzip.compress(record[:-6])))


def foreign():
    """Records as other tools write them."""
    body = b"<p>" + "caf\u00e9 ".encode() * 400
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n"

    def record(kind, name, block, *fields):
        lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", *fields,
                 f"Content-Length:{len(block)}"]
        return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    block = base64.b32encode(hashlib.sha1(http + body).digest()).decode()
    return body, [
        record("warcinfo", "0", b"software: other\r\n"),
        record("request", "1", b"GET / HTTP/1.0\r\n\r\n"),
        record("response", "2", http + body, "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: sha1:{sha}",
               f"warc-block-digest: sha1:{block}", "X-Long: folded\r\n  over lines"),
        record("resource", "3", b"plain bytes", "Content-Type: text/plain", "WARC-Block-Digest: crc32:00"),
        record("revisit", "4", b"", "WARC-Refers-To: <urn:uuid:2>", f"WARC-Payload-Digest: sha1:{sha}"),
        record("response", "5", http + body[:1000], "WARC-Segment-Number: 1"),
        record("continuation", "6", body[1000:], "WARC-Segment-Origin-ID: <urn:uuid:5>",
               "WARC-Segment-Number: 2", f"WARC-Segment-Total-Length: {len(http + body)}"),
        record("response", "7", b""), record("response", "8", http),
    ]


@pytest.mark.parametrize("packing", ["plain", "whole", "members"])
def test_archives_of_others(spark, tmp_path, packing):
    body, parts = foreign()
    data = {"plain": b"".join(parts), "whole": gzip.compress(b"".join(parts)),
            "members": b"".join(map(gzip.compress, parts)) + b"\0\0"}[packing]
    (tmp_path / "crawl.warc.gz").write_bytes(data)
    chunks = warc.read_archive(spark, str(tmp_path), part_bytes=300)
    by = {}
    for r in chunks.orderBy("record_id", "chunk", "part").collect():
        by.setdefault(r.record_id[10:-1], []).append(r)
    payload = {k: b"".join(r.data or b"" for r in rows) for k, rows in by.items()}
    assert payload == {"2": body, "3": b"plain bytes", "4": b"", "5": body, "7": b"", "8": b""}
    assert all(len(r.data or b"") <= 300 and r.page_id is None for rows in by.values() for r in rows)
    assert by["2"][0].target_uri == "http://a/" and by["4"][0].refers_to_id == "<urn:uuid:2>"
    digest = hashlib.sha1(body).hexdigest()
    found = sorted((r.record_type, r.payload_bytes, r.payload_digest) for r in warc.summarise(chunks).collect()
                   if r.payload_bytes != 0)
    assert found == [("resource", 11, hashlib.sha1(b"plain bytes").hexdigest()),
                     ("response", len(body), digest), ("response", len(body), digest), ("revisit", None, digest)]


def test_archive_member_per_record(spark, tmp_path):
    rows = pages()
    got = archive_rows(spark, rows, str(tmp_path / "a"), chunk_bytes=700, volume_bytes=4000, seekable=True)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_archive(rows)
    for path in (tmp_path / "a").glob("part-*"):
        data = path.read_bytes()
        gzip.decompress(data)
        while data:  # each member is one whole record
            member = zlib.decompressobj(31)
            record = member.decompress(data)
            head, _, rest = record.partition(b"\r\n\r\n")
            size = int(head.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
            assert head.startswith(b"WARC/1.1") and len(rest) == size + 4 and rest.endswith(b"\r\n\r\n")
            data = member.unused_data


def test_huge_record_is_read_in_parts():
    size = 200_000_000
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: {size}\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = [pack.compress(head.encode())]
    data += [pack.compress(b"x" * 1_000_000) for _ in range(size // 1_000_000)]
    volume = b"".join([*data, pack.compress(b"\r\n\r\n"), pack.flush()])
    tracemalloc.start()
    total = sum(len(row[-1]) for row in warc.parse_volume(volume))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == size and peak < 50_000_000


def test_no_archive():
    for data in (b"hello\r\n\r\n", b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", b"x" * 1_100_000):
        with pytest.raises(ValueError, match="not a record"):
            list(warc.parse_volume(data))


# --- pages --------------------------------------------------------------------------

HTML = {
    "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav>"
    "<header>Top</header><article><h1>Head</h1><p>One, two.<p>Three <b>bold</b>\n more.<br>After"
    "</article><aside>Side</aside><footer>Foot</footer></body></html>":
        "Head\nOne, two.\nThree bold more. After",
    "<article><p>A &amp; B &lt;c&gt; &eacute;&#233;&#xe9; &nbsp; x &unknown; &am</p></article>":
        "A & B <c> ééé x &unknown; &am",
    "<article><p>Text 1 < 2 and 3 > 2.</p><script>if (a<b) document.write('<p>no</p>')</script>"
    "<p>End.</p></article>": "Text 1 < 2 and 3 > 2.\nEnd.",
    "<article><p>Keep.</p><div class='ad box'>Buy</div><div id=comments><p>Nice post, really!</p></div>"
    "<form><p>Mail</p><input></form><p>Last.</p></article>": "Keep.\nLast.",
    "<div class='cookie-notice'>We use cookies.</div><main><h2 class='section-header'>H</h2><ul><li>a<li>b</ul>"
    "<table><tr><td>c<td>d</table></main>": "H\na\nb\nc\nd",
    "<article>Bare text<p>and more<div>in div</div>tail</article>": "Bare text\nand more\nin div\ntail",
    "<article><p hidden>x</p><p style='display: none'>y</p><p aria-hidden=true>z</p><p>ok</p></article>": "ok",
    "<article><p>Trunc": "Trunc",
    "<article><p>a<!-- c <p>no</p> --> b</p><!-- open": "a b",
    "<ARTICLE><P>UP</P><SCRIPT>x</SCRIPT></ARTICLE>": "UP",
    "<article><p>in<a href='a>b'>link</a>out</p></div></article>": "inlinkout",
    "<article class='comment-enabled post'><p>x</p><article class=comment>y</article></article>": "x",
    "<div class='page no-sidebar'><article><p>x</p></article><section id=comments><article>y</article></section></div>":
        "x",
    "<div><p>No article here, but this text is long enough, with commas, to be the content.</p>"
    "<p>Second paragraph, also with a lot of text in it, so it is kept.</p></div>"
    "<div><ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul></div>":
        "No article here, but this text is long enough, with commas, to be the content.\n"
        "Second paragraph, also with a lot of text in it, so it is kept.",
    "<body><div class=top>Site</div><div class=content><h1>Title</h1><p>A long paragraph, with commas, and"
    " enough words to be the text of the page, surely.</p><p>Short.</p><ul><li>one</li></ul></div>"
    "<div class=bottom>Company, 2020</div></body>":
        "Title\nA long paragraph, with commas, and enough words to be the text of the page, surely.\nShort.\none",
    "<body><h1>Head</h1><p>A long paragraph, with commas, and enough words to be the text.</p><p>No.</p>"
    "<div>Fine print</div></body>": "Head\nA long paragraph, with commas, and enough words to be the text.\nNo.",
    "plain text, no markup": "plain text, no markup",
    "": "", "   ": "", "<nav>only menu</nav>": "",
    "<nav><ul><li>unclosed menu<article><p>Story.</p></article>": "Story.",
}


@pytest.mark.parametrize("page", HTML)
def test_page_text(page):
    assert html_text.main_text(page) == HTML[page]


PROSE = "This sentence is prose, it has commas, and it goes on for a while. "


@pytest.mark.parametrize("page, want", [
    (f"<body><h1>Title</h1><div class=content><p>{PROSE * 5}</p><p>{PROSE * 4}</p></div></body>",
     ["Title", PROSE * 5, PROSE * 4]),
    # A lead, a second column with its heading, and a wrapped title.
    (f"<body><div class=lead><p>{PROSE * 2}</p></div><div class=content><p>{PROSE * 9}</p><p>{PROSE * 9}</p></div>"
     f"<h2>More</h2><div class=column><p>{PROSE * 2}</p></div><div><a href=1>one</a></div></body>",
     [PROSE * 2, PROSE * 9, PROSE * 9, "More", PROSE * 2]),
    (f"<body><div class=lead><p>{PROSE * 2}</p></div><div class=content><p>{PROSE * 9}</p><p>{PROSE * 9}</p></div>"
     "<div><a href=1>one</a></div></body>", [PROSE * 2, PROSE * 9, PROSE * 9]),
    (f"<body><div class=top><h2>Title</h2><p>By Ann</p></div><div><h3>Topics</h3><ul><li><a href=1>one</a></ul></div>"
     f"<div class=page><div>Small</div><h2>Part</h2><div><p>{PROSE * 5}</p><p>{PROSE * 5}</p></div></div></body>",
     ["Title", "Part", PROSE * 5, PROSE * 5]),
])
def test_what_stands_beside_the_densest_element(page, want):
    assert html_text.main_text(page) == "\n".join(x.strip() for x in want)


ORDINARY = ["discussion", "related-work", "social-history", "notice", "search", "shareAlike", "disclaimer", "reply"]


@pytest.mark.parametrize("word", ORDINARY)
@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_prose_stays_whatever_ordinary_word_names_it(word, outer):
    head = f"<body><{outer}><h1>Title</h1><p>{PROSE * 4}</p>"
    tail = f"<p>{PROSE}</p></{outer}></body>"
    for name in (f"class='{word}'", f"id='{word}'"):
        page = f"{head}<section {name}><h2>Part</h2><p>{PROSE * 3}</p><div><p>{PROSE * 2}</p></div></section>{tail}"
        want = ["Title", PROSE * 4, "Part", PROSE * 3, PROSE * 2, PROSE]
        assert html_text.main_text(page) == "\n".join(x.strip() for x in want)
    inline = f"{head}<p>Before <span class={word}>{PROSE}</span> after.</p>{tail}"
    assert f"Before {PROSE.strip()} after." in html_text.main_text(inline)


@pytest.mark.parametrize("part", [
    "<div class=share>Share this</div>",
    "<p>x <span class=share>Share</span></p>",
    "<p>x <a class=share href=1>Share this story with all of your friends and with everybody else you know</a></p>",
    f"<div class=related><h2>Related</h2><ul><li><a href=1>{PROSE}</a><li><a href=2>{PROSE}</a></ul></div>",
    f"<div class=related><article><h3><a href=1>One</a></h3><p>{PROSE}</p></article>"
    f"<article><h3><a href=2>Two</a></h3><p>{PROSE}</p></article></div>",
    f"<section id=discussion><div class=item><b>Ann, May 2</b><p>{PROSE * 2}</p></div>"
    f"<div class=item><b>Bob, May 3</b><p>{PROSE}</p></div></section>",
    f"<div class=reply><p>{PROSE}</p></div><div class=reply><p>{PROSE}</p></div>",
    f"<div class='ad related'><p>{PROSE * 3}</p></div><div class=cookie><p>{PROSE * 3}</p></div>"
    f"<div id=comments><p>{PROSE * 3}</p></div><div class=navbar><p>{PROSE * 3}</p></div>",
])
def test_labels_links_and_replies_go(part):
    page = f"<article><h1>Title</h1><p>{PROSE * 4}</p>{part}<p>End.</p></article><div class=related><p>{PROSE * 9}</p></div>"
    want = f"Title\n{(PROSE * 4).strip()}\n{'x\n' if part.startswith('<p>') else ''}End."
    assert html_text.main_text(page) == want


def test_long_article_beside_long_adverts():
    advert = "<div class=ad><p>" + "Buy this, now! " * 500 + "</p></div>"
    page = advert + "<article><h1>Short</h1><p>Tiny.</p></article>" + "<div><p>" + "Stray, text. " * 20 + "</p></div>"
    assert html_text.main_text(page) == "Short\nTiny."


def test_extract(spark):
    rows = [(1, "u", "<article><p>x</p></article>", "old"), (2, None, None, "old"), (2, None, None, "old"),
            (3, "u", "<article>" + "<p>wort, wort.</p>" * 20_000, "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r.page_id, r.url, len(r.text), r.n_chars) for r in out.fillna("").collect())
    assert got == [(1, "u", 1, 1), (2, "", 0, 0), (2, "", 0, 0), (3, "u", 239_999, 239_999)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_smoothing_and_fusion():
    assert html_text._smooth(np.array([4.0, 0.0, 0.0])).tolist() == [3.0, 1.0, 0.0]
    blocks = html_text.read_blocks("<div><p>Long, text, with, marks.</p></div><ul><li>x<li>y</ul>")
    scores = html_text.path_scores(blocks)
    assert scores[(), ("div", "p")] > scores[(), ("ul", "li")]


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


LONG = "".join(f"<p>{'A long paragraph of several words, with marks; it goes on and on. ' * 5}{i}</p>" for i in range(3))
WRAPPED = [
    ('<div id="page" class="no-sidebar">%s</div>', ""),
    ('<div class="layout-with-sidebar">%s</div>', ""),
    ('<div class="wrap has-header sticky-footer">%s</div>', ""),
    ('<form id="aspnetForm">%s</form>', ""),
    ('<form id="aspnetForm"><article>%s</article></form>', ""),
    ('<form><div class="sidebar"><p>Beside it, in words.</p></div><article>%s</article></form>', ""),
    ('<article><div class="has-comments">%s</div></article>', ""),
    ('<article><h1>T</h1><div class="no-ads">%s</div></article>', "T\n"),
    ('<article><h1>Baking</h1><section id="cookies">%s</section></article>', "Baking\n"),
    ('<article><section id="http-header">%s</section></article>', ""),
    ('<article><header><h1>Title</h1><p>3 May</p></header>%s</article>', "Title\n"),
    ('<div class="cookie-notice"><p>We use cookies, accept them.</p></div><div>%s</div>', ""),
    ('<div class="has-sidebar"><div>%s</div><aside class="sidebar"><p>Beside it, in words.</p></aside></div>', ""),
    ('<div>%s</div><div class="comments">' + LONG.replace("A long", "My") + "</div>", ""),
    ('<article>%s<div class="newsletter"><p>Subscribe, it is free.</p></div></article>', ""),
]


@pytest.mark.parametrize("page, head", WRAPPED)
def test_a_name_alone_takes_no_page_away(page, head):
    want = "\n".join(p.strip() for p in LONG.replace("<p>", "").split("</p>") if p)
    assert html_text.main_text(page % LONG) == head + want


def test_what_only_looks_like_a_page_is_none():
    assert html_text.main_text("<footer><p>All rights reserved, 2020.</p></footer>") == ""
    assert html_text.main_text('<div class="cookie"><p>We use cookies, accept them.</p></div>') == ""
    assert html_text.main_text('<div class="comments">' + LONG + "</div>") == ""


@pytest.mark.parametrize("open_", [
    "<div>x ", "<div class=related>x ", "<aside><article>x ", "<ul><li>y ", "<article><p>x ",
    "<div class=sidebar><p>some words, with marks. ", "<form><section id=notice>x "])
def test_deep_pages_take_time_in_proportion(open_):
    import time

    def seconds(n):
        start = time.process_time()
        html_text.main_text(open_ * n + "</section>" * n)
        return time.process_time() - start

    assert seconds(20_000) < 10
