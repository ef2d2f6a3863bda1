from __future__ import annotations

import pytest

from framewright import registry
from tests.compare import canonical, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    ours = registry.queries()[name](spark, SF).toPandas()
    theirs = duck(SF, registry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["frame", "query", "class", "fg_prob", "bg_prob"]
    assert set(registry.queries()) <= set(__spark_entry__.queries())
