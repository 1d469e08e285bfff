"""Each registered query against its SQL, or that it gives rows where it has none."""

import pytest

from tessella.llm import oracles, queries
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query(spark, small, name):
    ours, theirs = same(queries.QUERIES[name](spark, small), connect(small), oracles.SQL[name])
    assert ours == theirs


def test_all_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
