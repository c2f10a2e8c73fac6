"""Output parsers."""

from pyspark.sql import functions as F

from scoreframe.functions import parsers as P
from scoreframe.functions.registry import ParserSpec, apply_parsers, default_parsers, register_parser
from scoreframe.functions.text import PY_SPACES, pystrip, token_count, word_tokens
from scoreframe.operators.views import spans_table as explode_spans
from scoreframe.plans.scale import balance

from . import fixtures as fx
from .base import query, table
from .fixtures import CLASSES, sql

_CHARS = " || ".join(f"chr({ord(c)})" for c in PY_SPACES)
_STRIP = f"trim(lower(text), {_CHARS})"
_BLANKS = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"


@query(
    f"SELECT doc_id, nullif(substr({_STRIP}, 1, 1), '') AS first_char, "
    f"nullif(regexp_extract({_STRIP}, '^[^\\s\\v\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), '') "
    "AS first_word FROM documents"
)
def parse_first(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        P.parse_first_char("text").alias("first_char"),
        P.parse_first_word("text").alias("first_word"),
    )


def _choice_sql(letters: str) -> str:
    return (
        f"CASE WHEN contains('{letters}', substr(trim(lower(output)), 1, 1)) "
        "THEN substr(trim(lower(output)), 1, 1) ELSE 'missing' END"
    )


@query(
    sql(
        f"SELECT id, inference_id, {_choice_sql('abcde')} AS five, {_choice_sql('abcd')} AS four, "
        f"{_choice_sql('abc')} AS three FROM fx_choices",
        "fx_choices",
    )
)
def parse_choice(spark, sf_dir):
    return fx.choices(spark, sf_dir).select(
        "id", "inference_id",
        P.parse_choice("output", "abcde").alias("five"),
        P.parse_choice("output", "abcd").alias("four"),
        P.parse_choice("output", "abc").alias("three"),
    )


def _keyword_sql(labels, text="text") -> str:
    cases = " ".join(f"WHEN contains(lower({text}), '{w}') THEN '{w}'" for w in labels)
    return f"CASE {cases} ELSE 'missing' END"


@query(
    f"SELECT doc_id, {_keyword_sql(('yes', 'no', 'maybe'))} AS yes_no, "
    f"{_keyword_sql(('true', 'false'))} AS truth, "
    f"{_keyword_sql(('positive', 'negative'))} AS sign FROM documents"
)
def parse_keyword(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        P.parse_keyword("text", ("yes", "no", "maybe")).alias("yes_no"),
        P.parse_keyword("text", ("true", "false")).alias("truth"),
        P.parse_keyword("text", ("positive", "negative")).alias("sign"),
    )


@query(
    sql(
        f"SELECT id, inference_id, {_choice_sql('abcd')} AS by_default, "
        f"{_keyword_sql(('yes', 'no', 'maybe'), 'output')} AS by_words, 'missing' AS by_unknown "
        "FROM fx_choices",
        "fx_choices",
    )
)
def parse_option(spark, sf_dir):
    return fx.choices(spark, sf_dir).select(
        "id", "inference_id",
        P.parse_option("output").alias("by_default"),
        P.parse_option("output", "Yes, No, Maybe").alias("by_words"),
        P.parse_option("output", "1, 2, 3").alias("by_unknown"),
    )


def _labels_sql(labels, text="output") -> str:
    cases = ", ".join(f"CASE WHEN contains(lower({text}), '{w}') THEN '{w}' END" for w in labels)
    return f"concat_ws(';', {cases})"


@query(
    sql(
        f"SELECT id, {_labels_sql(CLASSES)} AS own, "
        f"{_labels_sql(P.COVID_TOPICS)} AS topics FROM fx_multilabel",
        "fx_multilabel",
    )
)
def parse_labels(spark, sf_dir):
    return fx.multilabel(spark, sf_dir).select(
        "id",
        P.parse_labels("output", ",".join(CLASSES)).alias("own"),
        P.parse_labels("output", P.COVID_TOPICS).alias("topics"),
    )


@query(
    f"""SELECT id, {_labels_sql(P.HALLMARKS)} AS hallmarks
FROM (SELECT doc_id AS id, concat(text, CASE WHEN doc_id % 3 = 0 THEN ' Inducing Angiogenesis'
  ELSE ' cellular energetics, evading growth suppressors' END) AS output FROM documents)"""
)
def parse_hallmarks(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 3 == 0, " Inducing Angiogenesis").otherwise(
        " cellular energetics, evading growth suppressors"
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        P.parse_labels(F.concat("text", tail), P.HALLMARKS).alias("hallmarks"),
    )


@query(
    sql(
        "SELECT id, string_agg(p, '' ORDER BY pos) AS parsed, string_agg(r, '' ORDER BY pos) "
        "AS reference FROM fx_bits GROUP BY id",
        "fx_bits",
    )
)
def multi_hot(spark, sf_dir):
    parsed = apply_parsers("output", default_parsers("mlc", CLASSES))

    def digits(c):
        return F.array_join(P.multi_hot(c, CLASSES).cast("array<string>"), "")

    return fx.multilabel(spark, sf_dir).select(
        "id", digits(parsed).alias("parsed"), digits("reference").alias("reference")
    )


@query(
    """SELECT doc_id, array_to_string([trim(x) for x in string_split(lang || sep || ' '
  || source || sep || sep || lang, sep) if trim(x) <> ''], '/') AS labels
FROM (SELECT doc_id, lang, source, CASE doc_id % 3 WHEN 0 THEN ';' WHEN 1 THEN ',' ELSE '|' END
  AS sep FROM documents)"""
)
def split_labels(spark, sf_dir):
    d = F.col("doc_id")
    sep = F.when(d % 3 == 0, ";").when(d % 3 == 1, ",").otherwise("|")
    text = F.concat("lang", sep, F.lit(" "), "source", sep, sep, "lang")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(P.split_labels(text), "/").alias("labels")
    )


@query(
    """SELECT doc_id, CASE WHEN source = lang THEN 'fr/' || lang
  WHEN lang = 'fr' THEN 'fr/' || source ELSE 'fr/' || lang || '/' || source END AS classes
FROM documents"""
)
def parse_classes(spark, sf_dir):
    typed = F.concat("lang", F.lit(" | "), "source", F.lit("|"), "lang")
    merged = P.parse_classes(typed, F.array(F.lit("fr")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(merged, "/").alias("classes")
    )


@query(sql("SELECT id, parsed FROM fx_spans", "fx_spans"))
def extract_spans(spark, sf_dir):
    return fx.spans(spark, sf_dir).select(
        "id", P.spans_to_json(P.sort_spans(P.extract_spans("output"))).alias("parsed")
    )


@query(sql("SELECT id, reference FROM fx_spans", "fx_spans"))
def reference_spans(spark, sf_dir):
    spans = P.lower_spans(P.spans_from_json("reference"))
    return fx.spans(spark, sf_dir).select("id", P.spans_to_json(spans).alias("reference"))


@query(
    sql(
        "SELECT id, CAST(split_part(span, '|', 1) AS INT) AS s, "
        "CAST(split_part(span, '|', 2) AS INT) AS e, split_part(span, '|', 3) AS label "
        "FROM fx_span_rows WHERE side = 'pred'",
        "fx_span_rows",
    )
)
def spans_table(spark, sf_dir):
    return explode_spans(fx.spans(spark, sf_dir))


@query(
    f"""SELECT doc_id, CAST(n AS INT) AS words, '[[0, ' || (k - 1) || ', "lead"], [' || k
  || ', ' || (n - 1) || ', "rest"]]' AS spans
FROM (SELECT doc_id, len([x for x in regexp_split_to_array(text, '{_BLANKS}+') if x <> '']) AS n,
  len([x for x in regexp_split_to_array(split_part(text, chr(10), 1), '{_BLANKS}+') if x <> ''])
  AS k FROM documents)"""
)
def extract_spans_long(spark, sf_dir):
    # Whole documents as markup: the first line is one span, the rest another.
    line = F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.length(line) + 1, F.length("text"))
    markup = F.concat(
        F.lit('<span class="Lead">'), line, F.lit('</span> <span  class="rest">'), rest,
        F.lit("</span>"),
    )
    return balance(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        token_count("text").alias("words"),
        P.spans_to_json(P.extract_spans(markup)).alias("spans"),
    )


@query(
    "SELECT page_id, md5(trim(replace(html, chr(9), ' '))) AS digest FROM "
    "(SELECT page_id, replace(replace(html, chr(10), ' '), chr(13), ' ') AS html FROM pages)"
)
def strip_fence(spark, sf_dir):
    fenced = F.concat(F.lit(" ```html\n"), F.col("html"), F.lit("\n```\n"))
    flat = F.translate(P.strip_fence(fenced), "\n\r\t", "   ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(pystrip(flat)).alias("digest"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN '[ERROR: Content filter triggered]'
  WHEN event_type = 'click' THEN '[ERROR: Rate limit exceeded]'
  ELSE '[ERROR: ' || event_type || ']' END AS output FROM events"""
)
def error_label(spark, sf_dir):
    message = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("CONTENT_FILTER "), "props"))
        .when(F.col("event_type") == "click", F.concat("props", F.lit(" rate_limit hit")))
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", P.error_label("event_type", message).alias("output")
    )


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 1.0
  WHEN event_type = 'error' THEN NULL ELSE value END AS score FROM events"""
)
def judge_score(spark, sf_dir):
    prediction = F.when(F.col("event_type") == "view", " \t").otherwise(F.col("event_type"))
    reply = F.when(F.col("event_type") == "error", "no rating").otherwise(
        F.concat(F.lit("\n "), F.col("value").cast("string"), F.lit(" "))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", P.judge_score(prediction, reply).alias("score")
    )


def _last_word(text, args):
    words = (text or "").split()
    return words[-1].strip(args["marks"]) if words else None


@query(
    sql(
        "SELECT id, inference_id, CASE WHEN output = 'unsure' THEN 'unsure' ELSE 'because' END "
        "AS word, CASE WHEN output = 'unsure' THEN 'u' ELSE 'b' END AS letter FROM fx_choices",
        "fx_choices",
    )
)
def custom_parser(spark, sf_dir):
    register_parser("last_word", _last_word, required=("marks",))
    step = ParserSpec("last_word", {"marks": ".,!)"})
    return fx.choices(spark, sf_dir).select(
        "id", "inference_id",
        apply_parsers("output", [step]).alias("word"),
        apply_parsers("output", [step, ParserSpec("extract_first_character")]).alias("letter"),
    )


@query(
    """SELECT doc_id, CAST(len([x for x in regexp_split_to_array(lower(text), '[^a-z0-9]+')
  if x <> '']) AS INT) AS words FROM documents"""
)
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(word_tokens("text")).alias("words")
    )
