from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from usagelens.session import local_session

    session = local_session("usagelens-tests", "8", "6g")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A one-column frame of texts."""

    def make(values, name="c"):
        return spark.createDataFrame([(v,) for v in values], f"{name} string")

    return make
