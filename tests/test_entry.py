import re

import pytest

import __spark_entry__ as entry_module
from docaudit.plans import registry

SF = "/root/testdata/sf0.001"
FITS = {"model_evaluation", "scored_alts", "cross_validation_checks"}


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["doc_id", "principle", "title", "score", "weight", "problems", "penalty"]
    assert df.count() == 3 * 1500


def test_every_query_but_model_fits_has_an_oracle():
    registry.load()
    assert set(registry.QUERIES) - set(registry.ORACLES) == FITS
    assert set(registry.QUERIES) <= set(entry_module.queries())


def test_no_plan_pairs_all_rows(spark):
    registry.load()
    for name, query in registry.QUERIES.items():
        if name in FITS:
            continue
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|NestedLoopJoin", plan), name


@pytest.mark.parametrize("name", ["principle_scores", "budget_gate", "package_images", "review_queue"])
def test_oracles_agree_at_the_smallest_scale(spark, name):
    from compare import compare, connect
    result = compare(name, entry_module.queries()[name], entry_module.oracle_sql()[name], spark, SF, connect(SF))
    assert re.fullmatch(r"OK \d+", result), result
