"""Each query against its SQL on the smallest tables."""

import os

import pytest
from parlance.plans import catalogue

from tests import oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

#: Queries that have no rows on the smallest tables.
MAY_BE_EMPTY = {"oe10_echo_pairs", "of16_duplicate_starts", "oh7_surplus_turns", "oh13_establishment_hint", "ox_op29_orphan_state"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.SQL:
        assert oracle.compare(df, con, catalogue.SQL[name]) in (("", "no rows") if name in MAY_BE_EMPTY else ("",))
    else:
        assert df.columns and df.count() > 0
