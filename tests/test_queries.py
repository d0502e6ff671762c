"""Every registered query with SQL gives that SQL's rows; others give rows."""

import pytest

from lodestone.plans import registry
from tests.compare import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert list(got.columns)
    if name in registry.ORACLE_SQL:
        assert rows(got) == rows(duck(SF, registry.ORACLE_SQL[name]))
    else:
        assert len(got)
