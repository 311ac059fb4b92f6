import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import agree
from strandlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    if name in registry.oracle_sql():
        agree(df, registry.oracle_sql()[name], SF)
    else:
        assert df.count() > 0
    spark.catalog.clearCache()
