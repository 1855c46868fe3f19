"""A session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT)]


@pytest.fixture(scope="session")
def spark():
    from quern.session import get_spark

    os.environ.setdefault("PYTHONPATH", str(ROOT))
    session = get_spark("tests", cores=4, shuffle_partitions=4, driver_memory="4g")
    yield session
    session.stop()
