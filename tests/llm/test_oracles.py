"""Every registered query of the package against its SQL."""

from __future__ import annotations

import pytest
from check_oracles import connect, difference

from weaksift.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(ORACLES[name]).df()) is None
