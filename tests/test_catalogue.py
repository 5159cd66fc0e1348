import pytest
from oracle import SF, assert_same

import __spark_entry__
from ratiospark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name])


@pytest.mark.parametrize("name", ["exact_fraction_sample", "feat_boxcox", "feat_linear_recipe", "irls_prop", "logistic_fit", "primal_dual_step", "gbm_smooth", "lp_stack"])
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 3 and {"cod", "prd", "prb", "vei", "mki"} <= set(df.columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_recipe_reads_the_sales_once(spark, monkeypatch):
    """the fitted recipe's plan reads staged rows, not the tables."""
    plan = catalogue.feat_linear_recipe(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "p_partkey" not in plan


def test_blend_has_one_shuffle_of_rows(spark):
    """both groupings take place in tasks of a bounded size."""
    plan = catalogue.stack_worst_quarter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(row_id") == 1 and "hashpartitioning(config_id" not in plan and "REPARTITION_BY_NUM" in plan
