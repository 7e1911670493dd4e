"""Every registered query against its SQL twin."""

import pytest

from driftline.plans.catalogue import ORACLES, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
#: values that appear only in larger tables
MAY_BE_EMPTY = {"so1_order_log", "w5_paginate", "src11_list_entries", "hi4_restore_version", "jn9_missing_on_server"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    problems = compare(spark, SF, QUERIES[name], ORACLES[name], con)
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if not p.startswith("no rows")]
    assert problems == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
