import pytest

import __spark_entry__ as contract
import oracle
import querybook

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_twin_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, con, name):
    frame = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        assert oracle.compare(frame, con, ORACLE[name]) is None
        assert con.execute(f"SELECT count(*) FROM ({ORACLE[name]})").fetchone()[0] > 0
    else:
        assert frame.count() > 0


# Queries whose work Python functions do, by design.
PYTHON = {
    "custom_parser", "generate_pending", "rouge_n", "rouge_lcs", "rouge_documents", "meteor",
    "meteor_joined_lexicon", "meteor_references", "embedding_match", "embedding_match_pruned",
    "bootstrap_poisson",
    "significance", "compare_runs_paired", "wilcoxon_signed_rank", "rank_sum",
    "failure_values", "equal_runs", "exact_p_values", "exact_p_tied", "bootstrap_split",
}


@pytest.mark.parametrize("name", [n for n in querybook.QUERIES if n not in PYTHON and "stream" not in n])
def test_plans_stay_native(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for node in ("EvalPython", "MapInArrow", "CartesianProduct", "MapInPandas"):
        assert node not in plan
