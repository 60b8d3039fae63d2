"""Every registered query of the package against its SQL, over the smallest tables."""

import pytest

from lodestone.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, small, same, name):
    df = registry.queries()[name](spark, small)
    if name in SQL:
        same(df, SQL[name])
    else:
        rows = df.collect()
        assert rows
        if "error" in df.columns:
            assert all(r["error"] is None for r in rows)
