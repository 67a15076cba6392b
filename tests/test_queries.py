from __future__ import annotations

import __spark_entry__ as entry
import pytest
from oracle import same

from nearfield.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5000
    assert set(entry.oracle_sql()) <= set(entry.queries())
