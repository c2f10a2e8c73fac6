"""Output parsers: raw model text to a label, a label list or entity spans.

Everything here is a native Column expression, so a parser chain stays one
projection over the scan and never starts a Python worker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import WS, col, first_char, first_token, is_blank, pystrip, token_count

MISSING = "missing"
SPAN_TYPE = "array<struct<s:int,e:int,label:string>>"

# Option families of the choice parser.
OPTION_TYPES = {
    "A, B, C, D, E": ("letters", "abcde"),
    "A, B, C, D": ("letters", "abcd"),
    "A, B, C": ("letters", "abc"),
    "Yes, No, Maybe": ("keywords", ("yes", "no", "maybe")),
    "True, False": ("keywords", ("true", "false")),
    "Positive, Negative": ("keywords", ("positive", "negative")),
}
DEFAULT_OPTION_TYPE = "A, B, C, D"

# Cancer hallmark labels.
HALLMARKS = (
    "sustaining proliferative signaling",
    "evading growth suppressors",
    "resisting cell death",
    "enabling replicative immortality",
    "inducing angiogenesis",
    "activating invasion and metastasis",
    "genomic instability and mutation",
    "tumor promoting inflammation",
    "cellular energetics",
    "avoiding immune destruction",
)

# COVID-19 literature topics.
COVID_TOPICS = (
    "mechanism",
    "transmission",
    "diagnosis",
    "treatment",
    "prevention",
    "case report",
    "epidemic forecasting",
)


# --- single labels ---------------------------------------------------------


def parse_first_char(c: Column | str) -> Column:
    """First character of the folded text, null when blank."""
    return F.nullif(first_char(c), F.lit(""))


def parse_first_word(c: Column | str) -> Column:
    """First whitespace token of the folded text, null when blank."""
    return F.nullif(F.lower(first_token(c)), F.lit(""))


def parse_choice(c: Column | str, letters: str = "abcd") -> Column:
    """The leading letter when it is one of ``letters``, else "missing"."""
    first = first_char(c)
    return F.when(first.isin(*letters), first).otherwise(F.lit(MISSING))


def parse_keyword(c: Column | str, labels: Sequence[str]) -> Column:
    """First label *in list order* that occurs anywhere in the text."""
    low = F.lower(col(c))
    hits = [F.when(low.contains(label), F.lit(label)) for label in labels]
    return F.coalesce(*hits, F.lit(MISSING))


def parse_option(c: Column | str, option_type: str = DEFAULT_OPTION_TYPE) -> Column:
    """Choice parser picked by option family; an unknown family is "missing"."""
    kind, labels = OPTION_TYPES.get(option_type, (None, ()))
    if kind == "letters":
        return parse_choice(c, labels)
    if kind == "keywords":
        return parse_keyword(c, labels)
    return F.lit(MISSING)


# --- label lists -----------------------------------------------------------


def label_list(labels: str | Sequence[str]) -> list[str]:
    """Plan-time label list: split on the first of ``; , |`` that occurs."""
    if isinstance(labels, str):
        sep = next((s for s in (";", ",", "|") if s in labels), None)
        labels = labels.split(sep) if sep else [labels]
    folded = (label.strip().lower() for label in labels)
    return [label for label in folded if label]


def parse_labels(c: Column | str, labels: str | Sequence[str]) -> Column:
    """Labels found in the text, in list order, joined with ";"."""
    wanted = label_list(labels)
    if not wanted:
        return F.lit("")
    low = F.lower(col(c))
    return F.concat_ws(";", *[F.when(low.contains(w), F.lit(w)) for w in wanted])


def split_labels(c: Column | str) -> Column:
    """Delimited label text to an array; blank text gives an empty array."""
    text = pystrip(c)
    parts = (
        F.when(text.contains(";"), F.split(text, ";"))
        .when(text.contains(","), F.split(text, ","))
        .when(text.contains("|"), F.split(text, r"\|"))
        .otherwise(F.array(text))
    )
    return F.filter(F.transform(parts, pystrip), lambda p: p != "")


def multi_hot(c: Column | str, classes: Sequence[str]) -> Column:
    """Delimited label text to a 0/1 vector in class order.

    Matching ignores case and unknown labels. When two classes differ only by
    case, the later position is the one that is set.
    """
    present = F.transform(split_labels(c), F.lower)
    position = {name.lower(): i for i, name in enumerate(classes)}
    bits = [
        F.coalesce(F.array_contains(present, name.lower()), F.lit(False)).cast("int")
        if position[name.lower()] == i
        else F.lit(0)
        for i, name in enumerate(classes)
    ]
    return F.array(*bits) if bits else F.array().cast("array<int>")


def parse_classes(text: Column | str, existing: Column | None = None) -> Column:
    """Typed class list merged into ``existing``; first occurrence keeps its place.

    The delimiter order is ``;`` then ``|`` then ``,`` and case is kept.
    """
    text = col(text)
    parts = (
        F.when(text.contains(";"), F.split(text, ";"))
        .when(text.contains("|"), F.split(text, r"\|"))
        .otherwise(F.split(text, ","))
    )
    named = F.filter(F.transform(parts, pystrip), lambda p: p != "")
    if existing is None:
        return F.array_distinct(named)
    return F.array_distinct(F.concat(existing, named))


# --- entity spans ----------------------------------------------------------

_MARK = "\u0001"
_TAG = r"(</?span[^>]*>)"
_OPEN = rf'^<span{WS}+class="([^"]+)">\z'


def strip_fence(c: Column | str) -> Column:
    """Drop a Markdown code fence around the whole text."""
    body = F.regexp_replace(pystrip(c), r"^(?:```html)?(?:```)?", "")
    opened = F.when(body.endswith("```"), F.substring(body, F.lit(1), F.length(body) - 3))
    return pystrip(opened.otherwise(body))


def extract_spans(c: Column | str) -> Column:
    """Entity spans of ``<span class="x">…</span>`` markup.

    Each span is ``(first token, last token, lower-cased class)`` with
    whitespace tokens counted outside the tags. A later open tag replaces an
    earlier one, a close tag without an open tag is ignored, and any other
    span tag counts as words.

    One left fold over the tag-separated pieces. The finished spans travel in
    a string, because appending to an array inside ``aggregate`` copies every
    element at each step; a class cannot contain a double quote, so the quote
    ends a record.
    """
    # The separator is not whitespace, so swapping a stray one for another
    # non-space control character leaves every token count unchanged.
    clean = F.replace(strip_fence(c), F.lit(_MARK), F.lit("\u001a"))
    pieces = F.split(F.regexp_replace(clean, _TAG, f"{_MARK}$1{_MARK}"), _MARK)

    def describe(piece: Column) -> Column:
        opened = F.nullif(F.regexp_extract(piece, _OPEN, 1), F.lit(""))
        closed = piece == "</span>"
        words = F.when(opened.isNotNull() | closed, 0).otherwise(token_count(piece))
        return F.struct(
            F.lower(opened).alias("opened"), closed.alias("closed"), words.alias("words")
        )

    start = F.struct(
        F.lit(0).alias("n"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("string").alias("label"),
        F.lit("").alias("out"),
    )

    def step(state: Column, piece: Column) -> Column:
        opens, closes = piece["opened"].isNotNull(), piece["closed"]
        record = F.concat_ws(
            ",", state["first"].cast("string"), (state["n"] - 1).cast("string"), state["label"]
        )
        emits = closes & state["first"].isNotNull()
        return F.struct(
            (state["n"] + piece["words"]).alias("n"),
            F.when(opens, state["n"]).when(~closes, state["first"]).alias("first"),
            F.when(opens, piece["opened"]).when(~closes, state["label"]).alias("label"),
            F.when(emits, F.concat(state["out"], record, F.lit('"')))
            .otherwise(state["out"])
            .alias("out"),
        )

    packed = F.aggregate(F.transform(pieces, describe), start, step, lambda s: s["out"])
    records = F.filter(F.split(packed, '"'), lambda r: r != "")

    def unpack(record: Column) -> Column:
        fields = F.split(record, ",", 3)
        return F.struct(
            F.get(fields, F.lit(0)).cast("int").alias("s"),
            F.get(fields, F.lit(1)).cast("int").alias("e"),
            F.get(fields, F.lit(2)).alias("label"),
        )

    return F.transform(records, unpack)


def sort_spans(c: Column | str) -> Column:
    """Order spans by (start, end); equal positions keep their order."""

    def compare(a: Column, b: Column) -> Column:
        return (
            F.when(a["s"] < b["s"], -1)
            .when(a["s"] > b["s"], 1)
            .when(a["e"] < b["e"], -1)
            .when(a["e"] > b["e"], 1)
            .otherwise(0)
        )

    return F.array_sort(col(c), compare)


def lower_spans(c: Column | str) -> Column:
    return F.transform(
        col(c),
        lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), F.lower(x["label"]).alias("label")
        ),
    )


def spans_from_json(c: Column | str) -> Column:
    """``[[start, end, label], …]`` text to spans; bad text gives null."""
    raw = F.from_json(col(c), "array<array<string>>")
    return F.transform(
        raw,
        lambda x: F.struct(
            F.get(x, F.lit(0)).try_cast("int").alias("s"),
            F.get(x, F.lit(1)).try_cast("int").alias("e"),
            F.get(x, F.lit(2)).alias("label"),
        ),
    )


def spans_to_json(c: Column | str) -> Column:
    """Spans to ``[[start, end, "label"], …]`` text, the stored form."""

    def one(x: Column) -> Column:
        # to_json of a one-element array escapes the label; the brackets go.
        quoted = F.to_json(F.array(x["label"]))
        return F.concat(
            F.lit("["), x["s"].cast("string"), F.lit(", "), x["e"].cast("string"),
            F.lit(", "), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("]"),
        )

    return F.concat(F.lit("["), F.array_join(F.transform(col(c), one), ", "), F.lit("]"))


# --- generation errors and judge replies -----------------------------------


def error_label(err_type: Column | str, err_msg: Column | str) -> Column:
    """Text stored in place of an output whose generation failed."""
    msg = F.lower(F.coalesce(col(err_msg), F.lit("")))
    return (
        F.when(msg.contains("content_filter"), "[ERROR: Content filter triggered]")
        .when(msg.contains("rate_limit"), "[ERROR: Rate limit exceeded]")
        .otherwise(F.concat(F.lit("[ERROR: "), col(err_type), F.lit("]")))
    )


def parse_judge_score(c: Column | str) -> Column:
    """A judge reply as a finite decimal number; null when the reply is not one.

    Only plain and scientific notation count: type suffixes, hexadecimal and the
    names of infinities, which a cast alone would read, do not.
    """
    reply = pystrip(c)
    plain = reply.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    value = F.when(plain, reply.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def judge_score(prediction: Column | str, reply: Column | str) -> Column:
    """1.0 for a blank prediction, else the number the judge replied."""
    return F.when(is_blank(prediction), F.lit(1.0)).otherwise(parse_judge_score(reply))
