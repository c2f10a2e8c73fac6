"""Text overlap and token-table metrics."""

from pyspark.sql import functions as F

from scoreframe.functions.overlap import rouge, rouge_l
from scoreframe.functions.text import word_tokens
from scoreframe.operators.textscores import meteor as add_meteor
from scoreframe.operators.tokens import embedding_match as match, embedding_match_pruned as match_pruned
from scoreframe.operators.tokens import mean_loglik as loglik
from scoreframe.operators.tokens import mean_loglik_multi as loglik_multi
from scoreframe.plans.scale import balance
from scoreframe.plans.scoring import ScoringPlan, evaluate

from . import fixtures as fx
from .base import query, table
from .fixtures import sql

_TOKENS = """SELECT id,
  [x for x in regexp_split_to_array(lower(prediction), '[^a-z0-9]+') if x <> ''] AS p,
  [x for x in regexp_split_to_array(lower(reference), '[^a-z0-9]+') if x <> ''] AS r
FROM fx_text"""
_GRAMS = """SELECT id, 1 AS n, 'p' AS side, unnest(p) AS gram FROM tok
UNION ALL SELECT id, 1, 'r', unnest(r) FROM tok
UNION ALL SELECT id, 2, 'p', unnest([p[i] || ' ' || p[i + 1] for i in range(1, len(p))])
  FROM tok
UNION ALL SELECT id, 2, 'r', unnest([r[i] || ' ' || r[i + 1] for i in range(1, len(r))])
  FROM tok"""
_OVERLAP = """SELECT id, n, sum(least(cp, cr)) AS shared, sum(cp) AS np, sum(cr) AS nr
FROM (SELECT id, n, gram, count(*) FILTER (side = 'p') AS cp, count(*) FILTER (side = 'r') AS cr
  FROM grams GROUP BY id, n, gram) GROUP BY id, n"""


@query(
    sql(
        """SELECT t.id,
  round(coalesce(max(2.0 * shared / (np + nr)) FILTER (n = 1), 0), 9) AS rouge1,
  round(coalesce(max(2.0 * shared / (np + nr)) FILTER (n = 2), 0), 9) AS rouge2
FROM tok t LEFT JOIN overlap o USING (id) GROUP BY t.id""",
        "fx_text", tok=_TOKENS, grams=_GRAMS, overlap=_OVERLAP,
    )
)
def rouge_n(spark, sf_dir):
    scored = fx.texts(spark, sf_dir).select(
        "id", rouge("prediction", "reference", ("rouge1", "rouge2")).alias("s")
    )
    return scored.select(
        "id", F.round("s.rouge1", 9).alias("rouge1"), F.round("s.rouge2", 9).alias("rouge2")
    )


@query(
    sql(
        """SELECT metric, round(value, 9) AS value FROM (
  SELECT unnest(['rouge1', 'rouge2']) AS metric, unnest([avg(f1), avg(f2)]) AS value
  FROM (SELECT t.id, coalesce(max(2.0 * shared / (np + nr)) FILTER (n = 1), 0) AS f1,
      coalesce(max(2.0 * shared / (np + nr)) FILTER (n = 2), 0) AS f2
    FROM tok t LEFT JOIN overlap o USING (id) GROUP BY t.id)
  UNION ALL SELECT 'llm_judge_relevance', avg(len(p) % 5 + 1.0) FROM tok)""",
        "fx_text", tok=_TOKENS, grams=_GRAMS, overlap=_OVERLAP,
    )
)
def evaluate_generation(spark, sf_dir):
    """A whole evaluation with judge scores made elsewhere."""
    rows = fx.texts(spark, sf_dir).select(
        F.lit("run1").alias("inference_id"), "id", F.col("prediction").alias("output"),
        "reference",
    )
    judged = rows.select(
        "inference_id", "id", F.lit("llm_judge_relevance").alias("metric"),
        (F.size(word_tokens("output")) % 5 + 1.0).alias("value"),
    )
    plan = ScoringPlan("generation", ("rouge1", "rouge2", "llm_judge_relevance"))
    done = evaluate(
        rows.select("id", "reference"), rows.drop("reference"), plan, external=judged
    )
    return done.aggregates.select("metric", F.round("value", 9).alias("value"))


@query(
    sql(
        """SELECT t.id, CASE WHEN t.id LIKE '%-1' THEN 0.0 ELSE
    round(coalesce(max(2.0 * shared / (np + nr)) FILTER (n = 1), 0), 9) END AS zero,
  CASE WHEN t.id NOT LIKE '%-1' THEN
    round(coalesce(max(2.0 * shared / (np + nr)) FILTER (n = 1), 0), 9) END AS missing
FROM tok t LEFT JOIN overlap o USING (id) GROUP BY t.id""",
        "fx_text", tok=_TOKENS, grams=_GRAMS, overlap=_OVERLAP,
    )
)
def failure_values(spark, sf_dir):
    """Scores of rows whose prediction is missing, with both choices."""
    lost = F.when(~F.col("id").endswith("-1"), F.col("prediction"))
    scored = fx.texts(spark, sf_dir).withColumn("prediction", lost).select(
        "id", rouge("prediction", "reference", ("rouge1",), on_error="zero").alias("z"),
        rouge("prediction", "reference", ("rouge1",)).alias("m"),
    )
    return scored.select(
        "id", F.round("z.rouge1", 9).alias("zero"), F.round("m.rouge1", 9).alias("missing")
    )


# The dynamic program a row at a time: row i has the longest subsequences of the
# first i predicted tokens and each prefix of the reference.
_LCS = """SELECT n, 0 AS i, j, 0 AS v FROM ref
UNION ALL
SELECT n, i + 1, j, max(v) OVER (PARTITION BY n ORDER BY j) FROM (
  SELECT l.n, l.i, l.j, greatest(l.v, coalesce(lag(l.v) OVER (PARTITION BY l.n ORDER BY l.j), 0)
    + CASE WHEN p.word = r.word THEN 1 ELSE 0 END) AS v
  FROM lcs l JOIN pred p ON p.n = l.n AND p.i = l.i + 1 JOIN ref r ON r.n = l.n AND r.j = l.j)"""


@query(
    sql(
        """SELECT t.id, CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0
  ELSE round(2.0 * v / (len(p) + len(r)), 9) END AS rougeL
FROM num t LEFT JOIN lcs l ON l.n = t.n AND l.i = len(t.p) AND l.j = len(t.r)""",
        "fx_text", tok=_TOKENS, num="SELECT *, row_number() OVER () AS n FROM tok",
        pred="SELECT n, generate_subscripts(p, 1) AS i, hash(unnest(p)) AS word FROM num",
        ref="SELECT n, generate_subscripts(r, 1) AS j, hash(unnest(r)) AS word FROM num",
        lcs=_LCS,
    ).replace("WITH ", "WITH RECURSIVE ", 1).replace("lcs AS (", "lcs(n, i, j, v) AS (", 1)
    .replace("num AS (", "num AS MATERIALIZED (", 1)
    .replace("pred AS (", "pred AS MATERIALIZED (", 1)
    .replace("ref AS (", "ref AS MATERIALIZED (", 1)
)
def rouge_lcs(spark, sf_dir):
    return fx.texts(spark, sf_dir).select(
        "id", F.round(rouge_l("prediction", "reference"), 9).alias("rougeL")
    )


@query()
def rouge_documents(spark, sf_dir):
    """Whole documents against their text without the first line."""
    rest = F.substring(
        F.col("text"), F.length(F.substring_index("text", "\n", 1)) + 1, F.length("text")
    )
    docs = balance(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scored = docs.select("doc_id", rouge(rest, "text").alias("s"))
    return scored.select("doc_id", "s.*")


def _lexicon(spark, sf_dir):
    """Synonym pairs that Spark derives from the texts: a word and its plural."""
    words = table(spark, sf_dir, "conversations").select(
        F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    ).filter("word <> ''").distinct()
    plural = words.select(F.concat("word", F.lit("s")).alias("word"))
    return words.join(plural, "word").select(
        "word", F.expr("substring(word, 1, length(word) - 1)").alias("synonym")
    )


@query()
def meteor(spark, sf_dir):
    """Alignment has no SQL form; goldens and brute force in the tests."""
    return add_meteor(
        fx.texts(spark, sf_dir), synonyms=_lexicon(spark, sf_dir)
    ).select("id", F.round("meteor", 9).alias("meteor"))


@query()
def meteor_joined_lexicon(spark, sf_dir):
    """The same scores with the lexicon joined in instead of broadcast."""
    return add_meteor(
        fx.texts(spark, sf_dir), synonyms=_lexicon(spark, sf_dir), broadcast_rows=0
    ).select("id", F.round("meteor", 9).alias("meteor"))


@query()
def meteor_references(spark, sf_dir):
    """Best of several references per text."""
    pairs = fx.texts(spark, sf_dir).withColumn(
        "reference", F.array("reference", "prediction")
    )
    return add_meteor(pairs).select("id", F.round("meteor", 9).alias("meteor"))


@query(
    sql(
        """SELECT coalesce(p.id, r.id) AS id, round(p, 6) AS precision, round(r, 6) AS recall,
  round(2 * p * r / (p + r), 6) AS f1
FROM (SELECT id, avg(best) AS p FROM (SELECT a.id, a.pos,
        max(list_cosine_similarity(a.vector, b.vector)) AS best
      FROM fx_tokens a JOIN fx_tokens b ON a.id = b.id AND a.side = 'pred' AND b.side = 'ref'
      GROUP BY a.id, a.pos) GROUP BY id) p
JOIN (SELECT id, avg(best) AS r FROM (SELECT a.id, a.pos,
        max(list_cosine_similarity(a.vector, b.vector)) AS best
      FROM fx_tokens a JOIN fx_tokens b ON a.id = b.id AND a.side = 'ref' AND b.side = 'pred'
      GROUP BY a.id, a.pos) GROUP BY id) r ON p.id = r.id""",
        "fx_tokens",
    )
)
def embedding_match(spark, sf_dir):
    tokens = fx.tokens(spark, sf_dir)
    sides = [
        tokens.filter(F.col("side") == s).select("id", "pos", "vector") for s in ("pred", "ref")
    ]
    return match(*sides).select(
        "id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    )


@query(
    """WITH t AS (SELECT vec_id AS pos, label AS id, vec_id % 2 AS side, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
b AS (SELECT p.id, p.pos AS p, r.pos AS r, list_cosine_similarity(p.v, r.v) AS c
  FROM t p JOIN t r ON p.id = r.id AND p.side = 0 AND r.side = 1),
x AS (SELECT id, avg(best) AS p FROM (SELECT id, max(c) AS best FROM b GROUP BY id, p) GROUP BY id),
y AS (SELECT id, avg(best) AS r FROM (SELECT id, max(c) AS best FROM b GROUP BY id, r) GROUP BY id)
SELECT id, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1
FROM x JOIN y USING (id)"""
)
def embedding_match_pruned(spark, sf_dir):
    """Few texts of many tokens: blocks by direction, bounds, products of what is left."""
    tokens = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"),
    )
    scored = match_pruned(tokens.filter("pos % 2 = 0"), tokens.filter("pos % 2 = 1"), block=64)
    return scored.select("id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT user_id AS id, round(avg(-value), 9) AS score FROM events GROUP BY user_id")
def mean_loglik(spark, sf_dir):
    tokens = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), (-F.col("value")).alias("logprob")
    )
    return loglik(tokens).withColumn("score", F.round("score", 9))


@query(
    """SELECT id, round(avg(s), 9) AS mean_score, round(max(s), 9) AS best_score
FROM (SELECT user_id AS id, event_type, avg(-value) AS s FROM events GROUP BY user_id, event_type)
GROUP BY id"""
)
def mean_loglik_references(spark, sf_dir):
    tokens = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("ref_no"),
        (-F.col("value")).alias("logprob"),
    )
    mean = loglik_multi(tokens, "mean", strict=False)
    best = loglik_multi(tokens, "max", strict=False)
    return mean.select("id", F.round("score", 9).alias("mean_score")).join(
        best.select("id", F.round("score", 9).alias("best_score")), "id"
    )
