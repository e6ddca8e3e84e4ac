"""Every registered query on the smallest dataset: against its oracle where SQL can state it, else that it runs."""

import pytest

from cutloom import plans
from tests.harness import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(plans.all_queries()))
def test_query(spark, con, name):
    status, _, _, note = compare(spark, con, name, FOLDER)
    assert status in ("ok", "rows"), note


def test_every_oracle_has_a_query():
    assert set(plans.all_oracles()) <= set(plans.all_queries())
