"""Every registered query of the engine beside its SQL."""

from __future__ import annotations

import harness
import pytest

from quillspan.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return harness.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, con, name):
    assert harness.differs(spark, con, registry.queries()[name], SQL[name], SF) is None
