"""Run metadata: registries, star joins, grouped options, parameters."""

from pyspark.sql import functions as F

from scoreframe.operators import catalog as K
from scoreframe.operators import views as V

from . import fixtures as fx
from .base import query, table
from .fixtures import sql

_MODELS = "SELECT DISTINCT p_brand AS provider_id, p_type AS model FROM part"


def _provider_models(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("provider_id"), F.col("p_type").alias("model")
    ).distinct()


@query(
    sql(
        """SELECT provider_id, 0::BIGINT AS part,
  coalesce(string_agg(model, ',' ORDER BY model), '') AS models
FROM (SELECT provider_id FROM m UNION SELECT 'none') LEFT JOIN m USING (provider_id)
GROUP BY provider_id""",
        m=_MODELS,
    )
)
def models_per_provider(spark, sf_dir):
    models = _provider_models(spark, sf_dir)
    providers = models.select("provider_id").distinct().union(
        spark.createDataFrame([("none",)], "provider_id string")
    )
    return K.models_per_provider(providers, models, 10_000).select(
        "provider_id", "part", F.array_join("models", ",").alias("models")
    )


@query(_MODELS)
def provider_models(spark, sf_dir):
    models = _provider_models(spark, sf_dir)
    nested = K.models_per_provider(models.select("provider_id").distinct(), models, 7)
    return K.provider_models(nested)


_TASK_SOURCES = """SELECT DISTINCT source AS metric_id, upper(source) AS name, lang AS task_id
FROM documents"""


@query(_TASK_SOURCES)
def metric_tasks(spark, sf_dir):
    nested = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("metric_id")).agg(
        F.collect_set("lang").alias("tasks")
    ).withColumn("name", F.upper("metric_id"))
    return K.metric_tasks(nested)


@query(
    """SELECT lang AS task_id, 0::BIGINT AS part,
  string_agg(DISTINCT source, ',' ORDER BY source) AS options FROM documents GROUP BY lang"""
)
def options_by_task(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("task_id"), "source")
    tasks = docs.select("task_id").distinct()
    return K.options_by_task(tasks, docs, "source", 10_000).select(
        "task_id", "part", F.array_join("sources", ",").alias("options")
    )


@query(
    """SELECT c_custkey AS project_id, 0::BIGINT AS part, coalesce(string_agg(o_orderpriority, ','
  ORDER BY o_orderpriority) FILTER (o_orderstatus <> 'O'), '') AS providers
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
)
def providers_per_project(spark, sf_dir):
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project_id"),
        F.col("o_orderkey").alias("inference_id"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("provider_id"),
    )
    return K.providers_per_project(projects, runs, 10_000).select(
        "project_id", "part", F.array_join("provider_ids", ",").alias("providers")
    )


def _star(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("inference_id"), F.col("l_linenumber").alias("evaluation_id")
    )
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("inference_id"), F.col("o_custkey").alias("dataset_id")
    )
    datasets = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("dataset_id"), F.col("c_nationkey").alias("provider_id"),
        F.col("c_name").alias("dataset"),
    )
    providers = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("provider_id"), F.col("n_regionkey").alias("task_id"),
        F.col("n_name").alias("provider"),
    )
    tasks = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("task_id"), F.col("r_name").alias("task")
    )
    return lines, runs, datasets, providers, tasks


@query(
    """SELECT r_name AS task, n_name AS provider, c_name AS dataset, count(*) AS evaluations
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def run_details(spark, sf_dir):
    return K.run_details(*_star(spark, sf_dir)).groupBy("task", "provider", "dataset").agg(
        F.count(F.lit(1)).alias("evaluations")
    )


@query(
    """SELECT coalesce(c_name, 'gone') AS dataset, count(*) AS evaluations
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'HOUSEHOLD') ON o_custkey = c_custkey
GROUP BY ALL"""
)
def job_details(spark, sf_dir):
    lines, runs, *_ = _star(spark, sf_dir)
    datasets = table(spark, sf_dir, "customer").filter(
        F.col("c_mktsegment") != "HOUSEHOLD"
    ).select(F.col("c_custkey").alias("dataset_id"), F.col("c_name").alias("dataset"))
    return K.job_details(lines, runs, datasets).groupBy(
        F.coalesce("dataset", F.lit("gone")).alias("dataset")
    ).agg(F.count(F.lit(1)).alias("evaluations"))


@query("SELECT p_partkey, p_name FROM part WHERE p_type IN ('ECONOMY', 'SMALL')")
def lookup_parsers(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_type", "function_id")
    return K.lookup_parsers(parts, ["ECONOMY", "SMALL"]).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer "
       "WHERE c_acctbal > 0)")
def keep_existing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0)
    return V.keep_existing(orders, customers, ["c_custkey"]).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey "
       "NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def purge(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    gone = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    return V.purge(lines, gone, ["o_orderkey"]).select(
        F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey"
    )


@query(
    """SELECT doc_id, source = 'src3' AS user_owned,
  CASE WHEN source = 'src3' THEN 'owned' ELSE 'public' END AS section
FROM documents WHERE (source = 'src3' OR doc_id % 3 = 0) AND lang = 'en'
  AND contains(lower('Doc-' || doc_id), 'c-1')"""
)
def browse(spark, sf_dir):
    d = F.col("doc_id")
    catalogue = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(d % 5 != 1, F.col("source")).alias("user_id"),
        (d % 3 == 0).alias("is_public"), F.col("lang").alias("task"),
        F.concat(F.lit("Doc-"), d.cast("string")).alias("name"), "source",
    ).withColumn("user_id", F.coalesce("user_id", F.when(F.col("source") == "src3", "src3")))
    seen = V.browse(V.visible_to(catalogue, "src3"), "en", "C-1")
    return seen.select("doc_id", "user_owned", "section")


@query(
    sql(
        """SELECT evaluation_id, created_at FROM fx_evaluations
WHERE status = 'done' AND task = 'Generation'""",
        "fx_evaluations",
    )
)
def completed_runs(spark, sf_dir):
    runs = fx.evaluations(spark, sf_dir).withColumnRenamed("task", "project_id")
    return V.completed_runs(runs, "Generation").select("evaluation_id", "created_at")


# --- run planning ------------------------------------------------------------


@query(
    """SELECT substr(sha256(concat_ws('|', 'p1', source, 'azure', m, '{}', 'Say {{input}}')),
    1, 12) AS inference_id, source AS dataset_id, m AS model, 'pending' AS status
FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(['o1', 'gpt-4o']) AS m)"""
)
def plan_runs(spark, sf_dir):
    datasets = table(spark, sf_dir, "documents").select(
        F.col("source").alias("dataset_id"), F.lit("mcq").alias("task_id")
    ).distinct()
    models = [{"provider": "azure", "model": m, "parameters": {}} for m in ("o1", "gpt-4o")]
    return K.plan_runs(datasets, models, "Say {{input}}", "p1").select(
        "inference_id", "dataset_id", "model", "status"
    )


@query(
    """SELECT substr(sha256(concat('run', o_orderkey, '|copy')), 1, 12) AS inference_id,
  o_custkey, 'pending' AS status, FALSE AS is_favorite FROM orders"""
)
def copy_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("inference_id"),
        "o_custkey", F.lit("done").alias("status"), F.lit(True).alias("is_favorite"),
        F.lit("x.parquet").alias("object_key"),
    )
    return K.copy_runs(runs).drop("object_key")


_PARAMS = """SELECT o_orderkey AS run_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'huggingface' WHEN 1 THEN 'azure' WHEN 2 THEN 'anthropic'
    ELSE 'google' END AS provider_id,
  CASE WHEN o_custkey % 2 = 0 THEN 'o1' ELSE 'gpt-4o' END AS model,
  unnest(['temperature', 'top_p', 'max_tokens', 'do_sample', 'reasoning_effort']) AS parameter,
  unnest([CAST((o_orderkey % 30) / 20 AS VARCHAR), '',
    CASE WHEN o_orderkey % 7 = 0 THEN '0' ELSE '512' END,
    CASE WHEN o_orderkey % 3 = 0 THEN 'false' ELSE 'true' END,
    CASE WHEN o_orderkey % 5 = 0 THEN 'minimal' ELSE 'low' END]) AS value
FROM orders"""


def _params(spark, sf_dir):
    key = F.col("o_orderkey")
    provider = F.element_at(
        F.array(*map(F.lit, ("huggingface", "azure", "anthropic", "google"))),
        (key % 4 + 1).cast("int"),
    )
    cells = {
        "temperature": ((key % 30) / 20).cast("string"),
        "top_p": F.lit(""),
        "max_tokens": F.when(key % 7 == 0, "0").otherwise("512"),
        "do_sample": F.when(key % 3 == 0, "false").otherwise("true"),
        "reasoning_effort": F.when(key % 5 == 0, "minimal").otherwise("low"),
    }
    pairs = F.array(
        *[F.struct(F.lit(k).alias("parameter"), v.alias("value")) for k, v in cells.items()]
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("run_id"), provider.alias("provider_id"),
        F.when(F.col("o_custkey") % 2 == 0, "o1").otherwise("gpt-4o").alias("model"),
        F.inline(pairs),
    )


@query(
    sql(
        """SELECT run_id, parameter, CASE
  WHEN NOT (parameter IN ('temperature')
    OR (parameter = 'top_p' AND provider_id <> 'anthropic')
    OR (parameter = 'max_tokens' AND provider_id <> 'huggingface')
    OR (parameter = 'do_sample' AND provider_id = 'huggingface')
    OR (parameter = 'reasoning_effort' AND provider_id = 'azure')) THEN 'unknown parameter'
  WHEN parameter = 'temperature' AND CAST(value AS DOUBLE) <= 1 THEN NULL
  WHEN parameter = 'max_tokens' AND value = '512' THEN NULL
  WHEN parameter = 'do_sample' THEN NULL
  WHEN parameter = 'reasoning_effort' AND value = 'low' THEN NULL
  ELSE 'invalid value' END AS problem FROM params""",
        params=_PARAMS,
    )
)
def check_params(spark, sf_dir):
    checked = K.check_params(_params(spark, sf_dir), K.parameter_table(spark))
    return checked.select("run_id", "parameter", "problem")


@query(
    sql(
        """SELECT run_id, parameter, round(TRY_CAST(v AS DOUBLE), 9) AS number, CASE WHEN
  TRY_CAST(v AS DOUBLE) IS NULL THEN v END AS word FROM (
  SELECT run_id, parameter, CASE WHEN value <> '' THEN value
    WHEN provider_id IN ('huggingface', 'azure') THEN '1.0'
    WHEN provider_id = 'google' THEN '0.95' END AS v
  FROM params WHERE NOT (provider_id = 'azure' AND model = 'o1'
      AND parameter NOT IN ('max_tokens', 'reasoning_effort'))
    AND NOT (provider_id = 'azure' AND model = 'gpt-4o' AND parameter = 'reasoning_effort')
    AND NOT (provider_id <> 'azure' AND run_id % 3 = 0
      AND parameter IN ('temperature', 'top_p'))) WHERE v IS NOT NULL""",
        params=_PARAMS,
    )
)
def fill_params(spark, sf_dir):
    filled = K.fill_params(_params(spark, sf_dir), K.parameter_table(spark))
    number = F.col("value").try_cast("double")
    return filled.select(
        "run_id", "parameter", F.round(number, 9).alias("number"),
        F.when(number.isNull(), F.col("value")).alias("word"),
    )


@query(
    sql(
        """SELECT run_id, parameter, value,
  CASE WHEN parameter = 'reasoning_effort' AND problem THEN 'unsupported effort' END AS problem
FROM sent""",
        params=_PARAMS,
        sent="""SELECT run_id, CASE
    WHEN provider_id = 'azure' AND model = 'o1' AND parameter = 'max_tokens' THEN 'max_completion_tokens'
    WHEN provider_id = 'google' AND parameter = 'max_tokens' THEN 'maxOutputTokens'
    WHEN provider_id = 'google' AND parameter = 'top_p' THEN 'topP' ELSE parameter END AS parameter, value,
    provider_id = 'azure' AND model = 'o1' AND value = 'minimal' AS problem
  FROM params WHERE CASE provider_id
    WHEN 'azure' THEN CASE model WHEN 'o1' THEN parameter IN ('max_tokens', 'reasoning_effort')
      ELSE parameter IN ('temperature', 'top_p', 'max_tokens') END
    WHEN 'anthropic' THEN parameter IN ('max_tokens', 'temperature') AND value <> ''
    WHEN 'google' THEN parameter IN ('max_tokens', 'temperature', 'top_p') AND value <> ''
    ELSE TRUE END""",
    )
)
def request_params(spark, sf_dir):
    """What the requests state; every fifth reasoning run asks for an effort that is not there."""
    return K.request_params(_params(spark, sf_dir))
