"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from tessella.plans import registry
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    if name not in registry.SQL:
        assert df.count() > 0
        return
    ours, theirs = same(df, duck, registry.SQL[name])
    assert ours == theirs
