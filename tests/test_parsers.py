import random

import pytest
from pyspark.sql import functions as F

import models
from scoreframe.functions import parsers as P
from scoreframe.functions.registry import (
    ParserSpec, apply_parsers, check_spec, default_parsers, metric_plan, register_parser,
)
from scoreframe.functions.text import PY_SPACES, fold, pystrip, token_count


def column(spark, values, build, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in frame.orderBy("i").select(build(F.col("t"))).collect()]


TRICKY = [
    None, "", "   ", "\t\n", "A) because", " b", "　C", "\x1cd", " e rest", "É x",
    "​zero width", "İstanbul", "ΣΑΣ", "a b", "  two\x85words  ", "﻿bom",
]


def test_space_set_is_python_whitespace():
    assert set(PY_SPACES) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_and_tokens_match_python(spark):
    texts = [t for t in TRICKY if t is not None] + [c + "x" + c for c in PY_SPACES]
    assert column(spark, texts, pystrip) == [t.strip() for t in texts]
    assert column(spark, texts, fold) == [t.lower().strip() for t in texts]
    assert column(spark, texts, token_count) == [len(t.split()) for t in texts]


def test_first_char_and_word(spark):
    def first_char(t):
        t = t.lower().strip() if t is not None else ""
        return t[0] if t else None

    def first_word(t):
        words = (t or "").lower().strip().split()
        return words[0] if words else None

    assert column(spark, TRICKY, P.parse_first_char) == [first_char(t) for t in TRICKY]
    assert column(spark, TRICKY, P.parse_first_word) == [first_word(t) for t in TRICKY]


@pytest.mark.parametrize("letters", ["abc", "abcd", "abcde"])
def test_choice(spark, letters):
    def model(t):
        t = (t or "").lower().strip()
        return t[0] if t and t[0] in letters else "missing"

    assert column(spark, TRICKY, lambda c: P.parse_choice(c, letters)) == [
        model(t) for t in TRICKY
    ]


def test_keyword_goes_by_list_order(spark):
    texts = ["maybe not, no", "I know", "", None, "YES or no", "  ", "perhaps"]
    got = column(spark, texts, lambda c: P.parse_keyword(c, ("yes", "no", "maybe")))
    assert got == ["no", "no", "missing", "missing", "yes", "missing", "missing"]


def test_option_families(spark):
    texts = ["E then", "false or true", "Positive"]
    assert column(spark, texts, lambda c: P.parse_option(c, "A, B, C, D, E")) == [
        "e", "missing", "missing"
    ]
    assert column(spark, texts, lambda c: P.parse_option(c, "True, False"))[1] == "true"
    assert column(spark, texts, lambda c: P.parse_option(c, "Positive, Negative"))[2] == "positive"
    assert column(spark, texts, lambda c: P.parse_option(c, "nothing")) == ["missing"] * 3


def test_label_goldens(spark):
    own = lambda c: P.parse_labels(c, "treatment,diagnosis,prevention")
    assert column(spark, ["This article is about treatment and diagnosis", "", None], own) == [
        "treatment;diagnosis", "", ""
    ]
    text = "This article discusses sustaining proliferative signaling and tumor promoting inflammation"
    assert column(spark, [text], lambda c: P.parse_labels(c, P.HALLMARKS)) == [
        "sustaining proliferative signaling;tumor promoting inflammation"
    ]
    text = "This article covers diagnosis and treatment of COVID-19"
    assert column(spark, [text], lambda c: P.parse_labels(c, P.COVID_TOPICS)) == [
        "diagnosis;treatment"
    ]


def test_split_labels_and_vectors(spark):
    texts = ["a; B ;;c,d", "x, y", "p|q", " one ", "", "  "]
    assert column(spark, texts, P.split_labels) == [
        ["a", "B", "c,d"], ["x", "y"], ["p", "q"], ["one"], [], []
    ]
    assert column(spark, ["b;A", "z"], lambda c: P.multi_hot(c, ["a", "B", "c"])) == [
        [1, 1, 0], [0, 0, 0]
    ]
    # Classes that differ only by case: the later position is set.
    assert column(spark, ["a"], lambda c: P.multi_hot(c, ["a", "A"])) == [[0, 1]]
    assert column(spark, ["b|a|b;c, d"], lambda c: P.parse_classes(c, F.array(F.lit("d")))) == [
        ["d", "b|a|b", "c, d"]
    ]


SPAN_CASES = [
    '<span class="chemical">aspirin</span> treats headaches',
    '<span class="a">x <span class="b">y z</span></span>',
    '```html\n<span class="A B">x</span>\n```',
    "``` plain ```", "</span> a </span>", '<span class="q"></span><span class="p"></span>',
    '<span id="x">word</span> <spanner>', '<span　class="é">à</span>', "", "   ",
    '<span class="x,1">a "quoted" b</span>', '\u0001 <span class="k">\u0001 z</span>',
]


def test_spans_match_the_model(spark):
    rng = random.Random(5)
    parts = [
        '<span class="a">', '<span class="B c">', "</span>", "<span>", " ", "w", "x y ", "\n",
        '<span  class="z">', " ", "```", "```html", '<span class="">', "</span >", '"', ",",
    ]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts = SPAN_CASES + made
    got = column(spark, texts, P.extract_spans)
    assert [[tuple(s) for s in row] for row in got] == [models.spans(t) for t in texts]


def test_many_spans_in_one_text(spark):
    text = ' <span class="c">one two</span> three' * 5000
    (got,) = column(spark, [text], P.extract_spans)
    assert len(got) == 5000 and tuple(got[-1]) == (3 * 4999, 3 * 4999 + 1, "c")


def test_span_json_round_trip(spark):
    texts = ['[[0,1,"A \\"b\\", ]["],[2,3,"é"]]', "[]", "broken"]
    assert column(spark, texts, lambda c: P.spans_to_json(P.lower_spans(P.spans_from_json(c)))) == [
        '[[0, 1, "a \\"b\\", ]["], [2, 3, "é"]]', "[]", None
    ]
    order = lambda c: P.spans_to_json(P.sort_spans(P.spans_from_json(c)))
    assert column(spark, ['[[2,3,"a"],[1,9,"b"],[1,2,"z"],[1,2,"c"]]'], order) == [
        '[[1, 2, "z"], [1, 2, "c"], [1, 9, "b"], [2, 3, "a"]]'
    ]


def test_errors_and_judge_scores(spark):
    frame = spark.createDataFrame(
        [("ValueError", "x"), ("E", "RATE_LIMIT hit"), ("E", "the Content_Filter"), ("E", None)],
        "k string, m string",
    )
    assert [r[0] for r in frame.select(P.error_label("k", "m")).collect()] == [
        "[ERROR: ValueError]", "[ERROR: Rate limit exceeded]",
        "[ERROR: Content filter triggered]", "[ERROR: E]",
    ]
    assert column(spark, [" 4.5\n", "5", "five", "", None], P.parse_judge_score) == [
        4.5, 5.0, None, None, None
    ]
    frame = spark.createDataFrame([("", "3"), ("x", "3"), (None, "2"), ("x", "?")], "p string, r string")
    assert [r[0] for r in frame.select(P.judge_score("p", "r")).collect()] == [1.0, 3.0, 1.0, None]


def test_chain_and_registry(spark):
    register_parser("shout", lambda text, args: text and text.upper() + args["end"], required=("end",))
    register_parser("twice", lambda c, args: F.concat(c, c), kind="column")
    chain = [ParserSpec("shout", {"end": "!"}), ParserSpec("twice"),
             ParserSpec("extract_first_word")]
    assert column(spark, ["ab c", None], lambda c: apply_parsers(c, chain)) == ["ab", None]
    with pytest.raises(KeyError):
        check_spec(ParserSpec("nowhere"))
    with pytest.raises(ValueError):
        check_spec(ParserSpec("process_mlc_option"))
    with pytest.raises(ValueError):
        check_spec(ParserSpec("extract_first_word", {"x": 1}))
    assert default_parsers("mlc", ["a"])[0].id == "process_mlc_option"
    assert default_parsers("mcq") == []
    with pytest.raises(KeyError):
        metric_plan(["nothing"])
