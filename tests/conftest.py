from __future__ import annotations

import os
from pathlib import Path

import pytest

from checks.compare import local_session


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = str(Path(__file__).parent)
    session = local_session("4")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples of the named columns."""

    def collect(df, *columns):
        return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())

    return collect
