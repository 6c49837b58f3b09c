"""Queries on the table where what they read beyond small texts shows: the smallest has no passage in a long text."""

import pytest

from memspark import queries as Q
from tests.compare import assert_same


@pytest.mark.parametrize("name", ["keyword_retrieval", "retrieval_evaluation", "merged_texts", "reward_adjustments"])
def test_reads_whole_tables(spark, name):
    sql = Q.oracle_sql()[name]
    assert "length(text) <" not in sql and "substr(text" not in sql and "% 10" not in sql
    assert_same(Q.queries()[name](spark, "/root/testdata/sf0.01"), sql, "/root/testdata/sf0.01")
