"""Checks and their targets: each check is made once, whatever is asked about it."""

import pytest
from test_search_at_size import SF_DIR, shown

import __spark_entry__ as entry


@pytest.mark.parametrize(("name", "passes"), [("agg_11_check_targets", 3), ("flt_8_clear_all_targets", 4), ("agg_13_reject_all_targets", 4)])
def test_lines_are_read_few_times(spark, name, passes):
    plan = shown(entry.queries()[name](spark, SF_DIR))
    assert 0 < plan.split("== Initial Plan ==")[0].count("Generate inline") <= passes
