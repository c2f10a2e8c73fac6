"""Licence scan, quality rules and source mix: small fixtures and edge cases."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scoreframe.llm import licenses, mixing, quality
from scoreframe.llm.base import let

DOC = "doc_id long, text string, source string"
PYTHON_NODES = ("EvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups", "CartesianProduct")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- licences --------------------------------------------------------------------

TEXTS = {
    1: "Some prose. Licensed under the Apache License, Version 2.0. More.",
    2: "Foo bar.\nReleased under the MIT License.",
    3: "This work is licensed under the GNU General Public License, version 3.",
    4: "x\nLicensed under CC BY-NC 4.0.",
    5: None,
    6: "",
    7: "We talked about a licence for fishing. No permission was needed.",
    8: (
        'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file'
        " except in compliance with the License.\nYou may obtain a copy of the License at\n\n"
        "    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or"
        " agreed to in writing, software\ndistributed under the License is distributed on an \"AS"
        ' IS" BASIS,\nWITHOUT WARRANTIES'
    ),
    9: "Released under the MIT License. Licensed under the MIT licence. All rights reserved.",
    10: "words " * 40_000 + "end. Released under the MIT License.",
}


def test_licences(spark):
    rows = spark.createDataFrame([(i, t, None) for i, t in TEXTS.items()], DOC)
    got = {r.doc_id: r for r in licenses.recognise(rows).collect()}
    assert got[1].licences == ["Apache-2.0"]
    assert got[2].licences == ["MIT"] and got[2].sentence_ids == ["MitUnder"]
    assert got[3].licences == ["GPL-3.0"]
    assert got[4].licences == ["CC-BY-NC-4.0"]
    assert [got[i].n_known for i in (5, 6, 7)] == [0, 0, 0]
    assert got[7].licences == []
    assert "ApacheUnder" in got[8].sentence_ids and got[8].licences == ["Apache-2.0"]
    assert got[9].licences == ["MIT", "All-Rights-Reserved"] and got[9].n_known == 3
    assert got[10].licences == ["MIT"]


EVERYDAY = {
    "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
    "Licensed under the Apache License 2.0.": "Apache-2.0",
    "Licensed under Apache 2.0.": "Apache-2.0",
    "Licensed under the MIT license and the Apache License, Version 2.0.": "MIT AND Apache-2.0",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU\n"
    "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the\n"
    "License, or (at your option) any later version.": "LGPL-2.1-or-later",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version.": "AGPL-3.0-or-later",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all "
    "copies.": "ISC",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0-only",
    "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
    "SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "MIT OR Apache-2.0",
    "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later",
}


def test_everyday_notices(spark):
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(EVERYDAY)], DOC)
    got = {r.doc_id: r.licences for r in licenses.recognise(rows).collect()}
    assert got == {i: [name] for i, name in enumerate(EVERYDAY.values())}


def test_every_sentence_has_a_trigger_and_is_normal(spark):
    forms = [f for known in licenses.SENTENCES.values() for f in known]
    assert all(any(t in f for t in licenses.TRIGGERS) for f in forms)
    rows = spark.createDataFrame([(f,) for f in forms], "form string")
    assert rows.where(licenses.normalise(F.col("form")) != F.col("form")).count() == 0


NOTICES = {
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
               " If a copy of the MPL was not distributed with this\nfile, You can obtain one at"
               " http://mozilla.org/MPL/2.0/.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify\nit under"
                        " the terms of the GNU General Public License as published by\nthe Free Software"
                        " Foundation; either version 2 of the License, or\n(at your option) any later"
                        " version.\n\nThis program is distributed in the hope that it will be useful,\nbut"
                        " WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or"
                        " FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more"
                        " details.\n\nYou should have received a copy of the GNU General Public License"
                        " along\nwith this program; if not, write to the Free Software Foundation.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software"
           ' and associated documentation files (the "Software"), to deal\nin the Software without'
           " restriction, including without limitation the rights\nto use, copy, modify, merge, publish,"
           " distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom"
           " the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above"
           " copyright notice and this permission notice shall be included in all\ncopies or substantial"
           ' portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,'
           " EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS"
           " FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT"
           " HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF"
           " CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE"
           " USE OR OTHER DEALINGS IN THE\nSOFTWARE.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file'
                  " except in compliance with the License.\nYou may obtain a copy of the License at\n\n   "
                  " http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed"
                  " to in writing, software\ndistributed under the License is distributed on an \"AS IS\""
                  " BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the"
                  " License for the specific language governing permissions and\nlimitations under the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are"
                    " permitted provided that the following conditions are met:\n\n1. Redistributions of"
                    " source code must retain the above copyright notice, this\n   list of conditions and the"
                    " following disclaimer.\n\n2. Redistributions in binary form must reproduce the above"
                    " copyright notice,\n   this list of conditions and the following disclaimer in the"
                    " documentation\n   and/or other materials provided with the distribution.\n\n3. Neither"
                    " the name of the copyright holder nor the names of its\n   contributors may be used to"
                    " endorse or promote products derived from\n   this software without specific prior"
                    " written permission.",
}
NOTICE_IDS = {
    "MPL-2.0": "MplUnder",
    "GPL-2.0-or-later": "GplVersion2Later GplNoWarranty GplSeeCopy GplSeeCopy",
    "MIT": "MitGrant MitNotice MitAsIs MitLiability",
    "Apache-2.0": "ApacheUnder ApacheObtain ApacheAsIs ApacheLimits",
    "BSD-3-Clause": "BsdRedistribution BsdSource BsdBinary BsdEndorse",
}


@pytest.mark.parametrize("shape", ["published", "unwrapped", "narrow", "commented"])
def test_published_notices(spark, shape):
    import textwrap

    def shaped(text):
        parts = [" ".join(p.split()) for p in text.split("\n\n")]
        if shape == "unwrapped":
            return "\n\n".join(parts)
        if shape == "narrow":
            return "\n\n".join(textwrap.fill(p, 34) for p in parts)
        if shape == "commented":
            return "".join(f"\n * {line}" for line in text.split("\n"))
        return text

    rows = [(i, f"Some prose.\n\n{shaped(t)}\n", None) for i, t in enumerate(NOTICES.values())]
    got = {r.doc_id: r for r in licenses.recognise(spark.createDataFrame(rows, DOC)).collect()}
    for i, name in enumerate(NOTICES):
        assert (got[i].licences, got[i].sentence_ids) == ([name], NOTICE_IDS[name].split()), name
        assert got[i].n_known == len(got[i].sentence_ids)


def test_known_words_inside_a_longer_sentence_do_not_count(spark):
    texts = ["It is not licensed under the MIT\nLicense.", "Licensed under the MIT\nLicense of old.",
             "The GPL;\nlicensed under the\nMIT License? Yes"]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r.sentence_ids for r in licenses.recognise(rows).collect()}
    assert got == {0: [], 1: [], 2: ["MitUnder"]}


def test_rules_are_ordered_and_consume(spark):
    rows = spark.createDataFrame([(1, "alpha licence. beta licence. alpha licence.", None)], DOC)
    known = {"A": ["alpha license"], "B": ["beta license"]}
    ruled = licenses.recognise(rows, known=known, rules=[("AB", "A B"), ("A", "A"), ("B", "B")])
    assert ruled.first().licences == ["AB", "A"]
    assert PYTHON_NODES[0] not in plan_of(ruled) and "Exchange" not in plan_of(ruled)


def test_licences_of_nothing_and_of_clashing_columns(spark):
    empty = spark.createDataFrame([], DOC)
    assert licenses.recognise(empty).count() == 0
    clash = spark.createDataFrame([(1, TEXTS[2], 5, "x")], "doc_id long, text string, n_known int, licences string")
    got = licenses.recognise(clash).first()
    assert got.n_known == 1 and got.licences == ["MIT"]


# --- quality ----------------------------------------------------------------------


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


CLEAN = " ".join(f"wort{i} und{i * 7} haus{i * 3}." for i in range(40))
CASES = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b", "a b c", "a b c a b c", "x x x x x", "x x x x",
    "a b c d a b c d e a b", "line\nline\n\nline \nother\n", "# * $ % & | < >", CLEAN,
    CLEAN + "\n" + CLEAN, "\U0001f600 ärger ß   x", "p q r " * 200,
]


def test_base_counts(spark):
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(CASES)], DOC)
    for r in quality.base_counts(rows).collect():
        want = brute_counts(CASES[r.doc_id])
        assert tuple(r[c] for c in quality.COUNTS) == want, (r.doc_id, want)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_verdicts_and_order(spark):
    bad = {
        20: " ".join(f"w{i}***" for i in range(120)),
        21: CLEAN.upper(),
        22: "\n".join(f"* punkt eintrag nummer text wort{i} mehr" for i in range(20)),
        23: " ".join(str(i * 7919) for i in range(90)),
        24: "\n".join(f"satz{i} geht so weiter und weiter..." for i in range(30)),
        25: CLEAN + " Lorem ipsum dolor.",
    }
    rows = spark.createDataFrame(
        [(1, CLEAN, "a"), (1, CLEAN, "a"), (2, None, None)] + [(i, t, "b") for i, t in bad.items()], DOC
    )
    judged = quality.judge(rows)
    got = sorted((r.doc_id, r.kept) for r in judged.collect())
    assert got == sorted([(1, True), (1, True), (2, False)] + [(i, False) for i in bad])
    # The order of the rules never changes the verdict.
    for rules in (quality.standard_rules(), quality.standard_rules()[::-1]):
        other = quality.base_counts(rows).select(
            "doc_id", (~F.col("base_failed") & quality.cascade(rules)).alias("kept"))
        assert sorted(map(tuple, other.collect())) == got
    assert not any(n in plan_of(judged) for n in (*PYTHON_NODES, "Exchange hash"))


def test_cheap_and_selective_rules_come_first():
    measured = [
        quality.Measured("slow", 1.0, 10), quality.Measured("fast", 0.1, 10),
        quality.Measured("idle", 0.01, 0), quality.Measured("strict", 0.1, 50),
    ]
    assert quality.ordered(measured) == ["strict", "fast", "slow", "idle"]


def test_quality_of_nothing_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOC)
    assert quality.judge(empty).count() == 0
    clash = spark.createDataFrame([(1, CLEAN, 9, "k")], "doc_id long, text string, n_words int, kept string")
    got = quality.judge(clash).first()
    assert got.n_words == 120 and got.kept is True


# --- mix ------------------------------------------------------------------------


def water(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by literal resharing: cap, share the excess by weight, repeat."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, left = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = left - sum(cap * sizes[s] for s in capped)
        total = sum(weight[s] for s in free)
        aim = {s: rest * weight[s] / total for s in free}
        over = {s for s in free if aim[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) for s in capped} | aim
        capped |= over


def mixed_docs(n=300):
    out = []
    for i in range(n):
        source = ["a", "B", "é", "\U0001f600", None, "big", "big", "big"][i % 8]
        out.append((i, " ".join(f"w{i}x{k}" for k in range((i * 37) % 90)), source))
    return out + [(899, "twice the same row", "a")] * 2 + [(900, None, "a"), (901, " \n", "empty")]


@pytest.mark.parametrize("block", [7, 64, 5000])
def test_mix(spark, block):
    rows = mixed_docs()
    docs = spark.createDataFrame(rows, DOC)
    plan = mixing.mix(docs, block_words=block)
    got = mixing.taken(plan).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = water(sizes)
    names = {r.doc_id: r for r in got}
    by_source = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
    for doc, _, source in rows:
        r = names[doc]
        assert r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6
    source_of = {d: s for d, _, s in rows}
    for r in got:
        by_source[source_of[r.doc_id]] = by_source.get(source_of[r.doc_id], 0) + r.taken
    for s, total in by_source.items():
        assert total == int(want[s])
    again = mixing.taken(mixing.mix(docs.repartition(5), block_words=block)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_schedule_is_even_and_complete(spark):
    need = [(0, 500), (1, 300), (2, 199), (3, 1), (4, 0)]
    plan = spark.createDataFrame(need, "sid int, need long")
    got = mixing.schedule(spark, plan, 1000, 5).orderBy("slot").collect()
    for sid, n in need:
        ranks = [r["rank"] for r in got if r.sid == sid]
        assert sorted(ranks) == list(range(n))
    half = [r.sid for r in got[:500]]
    assert abs(half.count(0) - 250) < 8 and abs(half.count(1) - 150) < 8


def test_mix_texts(spark):
    rows = mixed_docs(80)
    docs = spark.createDataFrame([(*r, 5) for r in rows], DOC + ", n_chars int")
    got = mixing.texts(docs)
    assert got.columns == docs.columns
    words = {}
    for r in got.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    total = {}
    for r in mixing.taken(mixing.mix(docs)).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.taken
    assert words == {d: t for d, t in total.items() if t}


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOC)
    assert mixing.taken(mixing.mix(empty)).count() == 0
    assert mixing.texts(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], DOC)
    assert [tuple(r)[-1] for r in mixing.taken(mixing.mix(blank)).collect()] == [0, 0]


def test_let_evaluates_once(spark):
    got = spark.range(3).select(let(F.sequence(F.lit(0), "id"), lambda a: F.size(a)).alias("n"))
    assert [r.n for r in got.collect()] == [1, 2, 3]


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "substring dedup", "source mix", "best-fit packing"]
