"""Licence recognition by sentence identifiers and ordered rules.

A text is normalised and cut into pieces at sentence ends, marks and line
starts. Known licence sentences are looked for among runs of whole pieces, the
longest first, so that it does not matter how a notice is wrapped and which
marks it has inside ("v. 2.0", "Foundation; either version 2"). The sequence of
identifiers found in a text is matched against ordered licence rules: a rule that finds its identifiers in sequence
names its licence and consumes them, so a later and weaker rule cannot name
the same sentences again. All of it is one narrow pass of Column expressions;
the sentences of one text meet in one row only, and texts without any of the
trigger words, one of which every known sentence holds, are not cut at all.

Null and empty texts, and texts without a known sentence, have zero known
sentences, an empty identifier sequence and no licence. Repeated rows are
judged one by one. A known sentence has to begin and end where a piece does;
inside a longer sentence it does not count.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .base import let

# Normalised sentences of public licence texts, by identifier.
SENTENCES = {
    "ApacheUnder": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "licensed under the apache license version 2 0 the license you may not use this file"
        " except in compliance with the license",
        "released under the apache license version 2 0",
    ),
    "ApacheObtain": (
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "you may obtain a copy of the license at",
    ),
    "ApacheAsIs": (
        "unless required by applicable law or agreed to in writing software distributed under the"
        " license is distributed on an as is basis without warranties or conditions of any kind"
        " either express or implied",
    ),
    "ApacheLimits": (
        "see the license for the specific language governing permissions and limitations under"
        " the license",
    ),
    "MitUnder": (
        "released under the mit license",
        "licensed under the mit license",
        "distributed under the mit license",
    ),
    "MitGrant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this"
        " software and associated documentation files the software to deal in the software"
        " without restriction including without limitation the rights to use copy modify merge"
        " publish distribute sublicense and or sell copies of the software and to permit persons"
        " to whom the software is furnished to do so subject to the following conditions",
    ),
    "MitNotice": (
        "the above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the software",
    ),
    "MitAsIs": (
        "provided as is without warranty of any kind express or implied including"
        " but not limited to the warranties of merchantability fitness for a particular purpose"
        " and noninfringement",
    ),
    "MitLiability": (
        "in no event shall the authors or copyright holders be liable for any claim damages or"
        " other liability whether in an action of contract tort or otherwise arising from out of"
        " or in connection with the software or the use or other dealings in the software",
    ),
    "Gpl3Under": (
        "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
    ),
    "Gpl2Under": (
        "licensed under the gnu general public license version 2",
        "released under the gnu general public license version 2",
    ),
    "GplVersion2Later": (
        "you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation either version 2 of the license or"
        " at your option any later version",
    ),
    "GplVersion3Later": (
        "you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation either version 3 of the license or"
        " at your option any later version",
    ),
    "GplNoWarranty": (
        "distributed in the hope that it will be useful but without any warranty without even the"
        " implied warranty of merchantability or fitness for a particular purpose",
    ),
    "GplSeeCopy": (
        "see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program",
    ),
    "BsdRedistribution": (
        "redistribution and use in source and binary forms with or without modification are"
        " permitted provided that the following conditions are met",
    ),
    "BsdSource": (
        "redistributions of source code must retain the above copyright notice this list of"
        " conditions and the following disclaimer",
    ),
    "BsdBinary": (
        "redistributions in binary form must reproduce the above copyright notice this list of"
        " conditions and the following disclaimer in the documentation and or other materials"
        " provided with the distribution",
    ),
    "BsdEndorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to"
        " endorse or promote products derived from this software without specific prior written"
        " permission",
    ),
    "BsdUnder": ("licensed under the bsd license", "released under the bsd license"),
    "MplUnder": (
        "subject to the terms of the mozilla public license v 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "licensed under the mozilla public license version 2 0",
    ),
    "CcBy": ("licensed under cc by 4 0", "licensed under a creative commons attribution 4 0"
             " international license"),
    "CcBySa": ("licensed under cc by sa 4 0",),
    "CcByNc": ("licensed under cc by nc 4 0",),
    "CcByNcSa": ("licensed under cc by nc sa 4 0",),
    "CcByNd": ("licensed under cc by nd 4 0",),
    "CcByNcNd": ("licensed under cc by nc nd 4 0",),
    "CcZero": ("licensed under cc0 1 0", "released under cc0 1 0"),
    "AllRights": ("all rights reserved",),
    "PublicDomain": ("released into the public domain", "dedicated to the public domain"),
    "SpdxApache": ("spdx license identifier apache 2 0",),
    "SpdxMit": ("spdx license identifier mit",),
    "SpdxBsd3": ("spdx license identifier bsd 3 clause",),
    "Lgpl21Later": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public"
        " license as published by the free software foundation either version 2 1 of the license or"
        " at your option any later version",
    ),
    "Lgpl3Later": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public"
        " license as published by the free software foundation either version 3 of the license or"
        " at your option any later version",
    ),
    "AgplLater": (
        "you can redistribute it and or modify it under the terms of the gnu affero general public"
        " license as published by the free software foundation either version 3 of the license or"
        " at your option any later version",
    ),
    "IscGrant": (
        "permission to use copy modify and or distribute this software for any purpose with or"
        " without fee is hereby granted provided that the above copyright notice and this"
        " permission notice appear in all copies",
    ),
    "ZeroGrant": (
        "permission to use copy modify and or distribute this software for any purpose with or"
        " without fee is hereby granted",
    ),
    "UnlicenseFree": (
        "free and unencumbered software released into the public domain",
        "this is free and unencumbered software released into the public domain",
    ),
    "BoostGrant": (
        "distributed under the boost software license version 1 0",
    ),
}

# Names by which notices speak of a licence, and its SPDX identifier.
SHORT_NAMES = {
    "Apache-2.0": ("apache license 2 0", "apache license version 2 0", "apache 2 0 license", "apache 2 0"),
    "MIT": ("mit license", "mit"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1",),
    "LGPL-3.0": ("gnu lesser general public license version 3",),
    "AGPL-3.0": ("gnu affero general public license version 3",),
    "ISC": ("isc license",),
    "Unlicense": ("unlicense",),
    "BSL-1.0": ("boost software license version 1 0",),
    "Zlib": ("zlib license",),
    "EPL-2.0": ("eclipse public license 2 0", "eclipse public license version 2 0"),
    "MPL-2.0": ("mozilla public license 2 0",),
    "MIT AND Apache-2.0": ("mit license and the apache license version 2 0",),
    "MIT OR Apache-2.0": ("mit license or the apache license version 2 0",),
}
# Identifiers of SPDX lines that stand for themselves.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0 OR MIT", "BSD-2-Clause", "BSL-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT OR Apache-2.0", "MPL-2.0", "Unlicense", "Zlib",
)


def _identifier(kind: str, name: str) -> str:
    return kind + re.sub("[^A-Za-z0-9]", "", name)


def _add_notices() -> None:
    """Sentences made of a verb, a name and an ending, unless they are known already."""
    have = {form for forms in SENTENCES.values() for form in forms}
    for licence, names in SHORT_NAMES.items():
        made = (
            f"{verb} under {the}{name}{end}" for name in names for verb in ("licensed", "released")
            for the in ("the ", "") for end in ("", " see the license file for details")
        )
        SENTENCES[_identifier("Under", licence)] = tuple(
            f for f in made if f not in have and "licen" in f)
    for licence in SPDX:
        plain = re.sub("[^a-z0-9]+", " ", licence.lower())
        SENTENCES[_identifier("Spdx", licence)] = (f"spdx license identifier {plain}",)


_add_notices()

# Ordered rules, licence name and its identifiers in sequence.
# ``?`` after an identifier: it may be missing.
RULES = (
    ("Apache-2.0", "ApacheUnder ApacheObtain? ApacheAsIs ApacheLimits?"),
    ("Apache-2.0", "ApacheUnder ApacheObtain?"),
    ("Apache-2.0", "SpdxApache"),
    ("MIT", "MitGrant MitNotice MitAsIs MitLiability"),
    ("MIT", "MitGrant MitNotice?"),
    ("MIT", "MitUnder"),
    ("MIT", "SpdxMit"),
    ("BSD-3-Clause", "BsdRedistribution BsdSource BsdBinary BsdEndorse"),
    ("BSD-2-Clause", "BsdRedistribution BsdSource BsdBinary"),
    ("BSD-3-Clause", "SpdxBsd3"),
    ("BSD", "BsdUnder"),
    ("GPL-3.0-or-later", "GplVersion3Later GplNoWarranty? GplSeeCopy?"),
    ("GPL-2.0-or-later", "GplVersion2Later GplNoWarranty? GplSeeCopy?"),
    ("GPL-3.0", "Gpl3Under"),
    ("GPL-2.0", "Gpl2Under"),
    ("LGPL-2.1-or-later", "Lgpl21Later"),
    ("LGPL-3.0-or-later", "Lgpl3Later"),
    ("AGPL-3.0-or-later", "AgplLater"),
    ("ISC", "IscGrant"),
    ("0BSD", "ZeroGrant"),
    ("Unlicense", "UnlicenseFree"),
    ("BSL-1.0", "BoostGrant"),
    ("MPL-2.0", "MplUnder"),
    ("CC-BY-NC-ND-4.0", "CcByNcNd"),
    ("CC-BY-NC-SA-4.0", "CcByNcSa"),
    ("CC-BY-NC-4.0", "CcByNc"),
    ("CC-BY-SA-4.0", "CcBySa"),
    ("CC-BY-ND-4.0", "CcByNd"),
    ("CC-BY-4.0", "CcBy"),
    ("CC0-1.0", "CcZero"),
    ("Public-Domain", "PublicDomain"),
    ("All-Rights-Reserved", "AllRights"),
    *((licence, _identifier("Under", licence)) for licence in SHORT_NAMES),
    *((licence, _identifier("Spdx", licence)) for licence in SPDX),
)

# Every known sentence holds one of these, none of them over a line end.
TRIGGERS = (
    "licen", "permission", "redistribut", "warrant", "copyright", "liab", "domain", "rights", "cc0",
)

#: Subjects before a verb that say nothing about the licence.
SUBJECT = (
    "^(this|the) (work|program|software|file|project|code|document|text|page|library|package|"
    "content|material)s? (is|are)( free software)?( hereby)? "
)
BREAK = "\x01"


def marked(text: Column) -> Column:
    """The normalised text, a mark before and after each of its pieces.

    A piece ends at ``.!?;:`` before white space, at a blank line, and at a
    line end when the next line starts with an upper-case letter or a mark.
    """
    cut = F.regexp_replace(text, r"([.!?;:])[ \t\r\n]+", "$1" + BREAK)
    cut = F.regexp_replace(cut, r"\r?\n([ \t]*[^a-z0-9\"'( \t])", BREAK + "$1")
    low = F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = _spelling(F.regexp_replace(low, f"[^a-z0-9{BREAK}]+", " "))
    return F.regexp_replace(F.concat(F.lit(BREAK), plain, F.lit(BREAK)), f" ?{BREAK}[ {BREAK}]*", BREAK)


def normalise(sentence: Column) -> Column:
    """Lower case, spelling ``license``, single spaces, no empty subject."""
    low = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = _spelling(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")))
    return F.regexp_replace(plain, SUBJECT, "")


def _spelling(plain: Column) -> Column:
    return F.regexp_replace(plain, r"\blicen[cs]e(d|s)?\b", "license$1")


def known_pattern(known: dict[str, Sequence[str]]) -> str:
    """A pattern over a marked text: known sentences of whole pieces, the longest first."""
    forms = sorted({form for forms in known.values() for form in forms}, key=len, reverse=True)
    pattern = f"(?:{SUBJECT.lstrip('^')})?+(?:{'|'.join(forms)})".replace(" ", f"[ {BREAK}]")
    return f"{BREAK}{pattern}(?={BREAK})"


def identifiers(text: Column, known: dict[str, Sequence[str]] | None = None) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    known = SENTENCES if known is None else known
    table = F.create_map(
        *[F.lit(x) for name, forms in known.items() for form in forms for x in (form, name)]
    )
    hits = F.regexp_extract_all(marked(text), F.lit(known_pattern(known)), F.lit(0))
    found = let(table, lambda t: F.transform(hits, lambda s: F.try_element_at(t, normalise(s))))
    return F.filter(found, lambda name: name.isNotNull())


def rule_pattern(rule: str) -> str:
    """A pattern over ``<A><B>`` for a rule ``A B?``."""
    parts = []
    for word in rule.split():
        name = word.rstrip("?")
        parts.append(f"(<{name}>)?" if word.endswith("?") else f"(<{name}>)+")
    return "".join(parts)


def recognise(
    docs: DataFrame,
    text: str = "text",
    known: dict[str, Sequence[str]] | None = None,
    rules: Sequence[tuple[str, str]] = RULES,
    triggers: Sequence[str] = TRIGGERS,
) -> DataFrame:
    """Add ``sentence_ids`` (array), ``n_known`` and ``licences`` (array).

    Licences come in the order of the rules that found them, each once.
    ``triggers`` must cover ``known``: lower-case strings, one of which every
    known sentence holds.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(plain)
    hint = F.lit(False)
    for word in triggers:
        hint = hint | F.contains(low, F.lit(word))
    none = F.array().cast("array<string>")
    out = docs.withColumn(
        "sentence_ids", F.when(hint, identifiers(plain, known)).otherwise(none)
    ).withColumn("n_known", F.size("sentence_ids").cast("long"))
    tags = F.concat_ws("", F.transform("sentence_ids", lambda s: F.concat(F.lit("<"), s, F.lit(">"))))
    return out.withColumn("licences", let(tags, lambda t: _match(t, rules)))


def _match(tags: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Fold the rules over the identifier string; each consumes what it matches."""
    steps = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(rule)).alias("pattern"))
            for name, rule in rules
        ]
    )
    start = F.struct(tags.alias("left"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.regexp_like(acc["left"], rule["pattern"])
        return F.struct(
            F.when(hit, F.regexp_replace(acc["left"], rule["pattern"], F.lit("!")))
            .otherwise(acc["left"]).alias("left"),
            F.when(hit, F.array_union(acc["found"], F.array(rule["name"])))
            .otherwise(acc["found"]).alias("found"),
        )

    folded = F.aggregate(steps, start, step, lambda acc: acc["found"])
    return F.when(tags == "", F.array().cast("array<string>")).otherwise(folded)
