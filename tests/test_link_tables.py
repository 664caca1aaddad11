"""The case table is made once, however many steps of a query read it."""

import pytest

from lexloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["case_linking", "link_confirmed"])
def test_made_once(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.inputFiles() and not [f for f in df.inputFiles() if "lineitem" in f]
