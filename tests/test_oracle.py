import os

import pytest

import __spark_entry__ as E
from quadrille.plans import catalog
from tests import oracle_check
from tests.conftest import SF001, SF01


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "x1", "y1", "x2", "y2"]
    assert df.count() == 139


def test_every_query_has_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) <= set(E.queries())


@pytest.mark.skipif(not os.path.exists(SF01), reason="no sf0.01 data")
def test_queries_match_oracle(spark):
    res = oracle_check.run(spark, SF01, list(catalog.QUERIES))
    bad = {k: v for k, v in res.items() if not v.get("values_match")}
    assert not bad, bad


@pytest.mark.skipif(not os.path.exists(SF001), reason="no sf0.001 data")
def test_queries_match_oracle_smallest(spark):
    res = oracle_check.run(spark, SF001, ["spatial_join_lines", "union_vertices", "closest_pair_lineitem"])
    bad = {k: v for k, v in res.items() if not v.get("values_match")}
    assert not bad, bad
