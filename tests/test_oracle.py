"""Every registered query that has SQL must equal it, row by row, on the smallest supplied folder."""

import os

import pytest

from sherdline.plans import load_all
from sherdline.plans.check import compare, connect
from sherdline.plans.registry import REGISTRY

load_all()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.oracle])
def test_equals_sql(spark, con, name):
    result = compare(spark, con, name, FOLDER)
    assert result["problem"] is None, result["problem"]


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if not q.oracle])
def test_runs(spark, con, name):
    assert compare(spark, con, name, FOLDER)["rows"] > 0
