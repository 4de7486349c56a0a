"""What tasks behind a shuffle read is bounded, whatever the input's size."""

from __future__ import annotations

import pytest

from quire.functions.tables import small_tasks
from quire.plans.queries import QUERIES

SIZE, NUMBER = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@pytest.fixture
def session(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.session.timeZone", "UTC")
    return s


def test_larger_tasks_are_cut_and_smaller_ones_stay(session):
    for given, expected in (("64MB", "8388608b"), ("1g", "8388608b"), ("67108864", "8388608b"), ("67108864b", "8388608b"), ("8m", "8m"), ("512k", "512k"), ("1000b", "1000b")):
        session.conf.set(SIZE, given)
        small_tasks(session)
        assert session.conf.get(SIZE) == expected
    assert session.conf.get(NUMBER) == "1000"
    session.conf.set(NUMBER, "7")
    small_tasks(session)
    assert session.conf.get(NUMBER) == "7"
    many = session.newSession()
    many.conf.set("spark.sql.shuffle.partitions", "5000")
    small_tasks(many)
    assert many.conf.get(NUMBER, None) is None


@pytest.mark.parametrize("name", ["rebalance", "arranged", "adopted_pages", "inserted_pages", "linked_pages"])
def test_tasks_of_arrangements_are_small(session, sf, name):
    QUERIES[name](session, sf)
    assert session.conf.get(SIZE) == "8388608b" and session.conf.get(NUMBER) == "1000"


@pytest.mark.parametrize("name", ["layout_images", "missing_clips"])
def test_tasks_of_clips_are_small(session, sf, name):
    QUERIES[name](session, sf)
    assert session.conf.get(SIZE) == "8388608b" and session.conf.get(NUMBER) == "1000"


@pytest.mark.parametrize("name", ["restored_pages", "restored_sources", "restored_rows", "copied_pages", "copies_balanced"])
def test_tasks_of_copies_are_small(session, sf, name):
    QUERIES[name](session, sf)
    assert session.conf.get(SIZE) == "8388608b" and session.conf.get(NUMBER) == "1000"
