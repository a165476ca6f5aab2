"""Queries of the subpackage against their SQL, and those without any: they must run."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from compare import assert_equal, connect  # noqa: E402

from talliard.llm import queries as q  # noqa: E402


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_equals_sql(spark, sf_dir, name):
    assert_equal(q.QUERIES[name](spark, sf_dir), connect(sf_dir), q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, sf_dir, name):
    df = q.QUERIES[name](spark, sf_dir)
    assert df.count() >= 0
    assert len(set(df.columns)) == len(df.columns)
