"""A table of few megabytes comes in one split; queries with slow rows deal it out to all cores first."""

import re

import pytest

from ledgerloom.plans import registry


@pytest.mark.parametrize("name", ["screen_blocks_found", "section_parsers", "revision_table_columns"])
def test_rows_are_dealt_out(name, spark, sf_dir):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert max(int(n) for n in ["0", *re.findall(r"\bRepartition (\d+), true", plan)]) >= spark.sparkContext.defaultParallelism


def test_revision_columns_are_found_once_a_row(spark, sf_dir):
    """Before, the columns were computed anew for each of their six places."""
    plan = registry.QUERIES["revision_table_columns"](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 1
