"""What the physical plans must and must not hold."""

import pytest

from memspool import catalog

#: One row of one number meets all turns here.
ONE_ROW_JOIN = {"style_sample"}


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_joins_and_no_row_udfs(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    assert name in ONE_ROW_JOIN or "BroadcastNestedLoopJoin" not in text


def test_scans_read_what_they_need(spark, sf_dir):
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan(catalog.QUERIES["topn_per_group"](spark, sf_dir))
    assert "In(role, [assistant,user])], ReadSchema" in plan(catalog.QUERIES["role_filter"](spark, sf_dir))


def test_bounded_collections_are_limited_before_the_shuffle(spark, sf_dir):
    text = plan(catalog.QUERIES["context_budget"](spark, sf_dir))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "WindowGroupLimit" in plan(catalog.QUERIES["topn_per_group"](spark, sf_dir))
