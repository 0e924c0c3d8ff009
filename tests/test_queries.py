"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from framesift.plans.catalog import QUERIES
from tools import compare

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare.compare(spark, con, SF, name)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["clip_id", "frames_decoded", "frames_kept", "first_kept", "last_kept"]
    rows = df.collect()
    assert rows and all(0 < r.frames_kept <= r.frames_decoded for r in rows)


def test_colliding_stems_stay_distinct(spark):
    df = entry.queries()["unique_stems_colliding"](spark, SF)
    rows = [r.name for r in df.collect()]
    assert len(set(rows)) == len(rows)
