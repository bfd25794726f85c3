"""Every core query against its SQL on the same tables."""

import pytest
from conftest import same_rows

from wickerloom.plans.catalogue import all_oracles, all_queries


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(name, spark, sf_dir, duck):
    got = all_queries()[name](spark, sf_dir).toPandas()
    sql = all_oracles().get(name)
    if sql is None:
        assert len(got.columns)
        return
    assert same_rows(got, duck.execute(sql).fetchdf()) is None
