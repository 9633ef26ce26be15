"""One local session for all tests, with the package shipped to its workers."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import local_session  # noqa: E402
from tidemark.shipping import ensure_shipped  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return ensure_shipped(local_session(4, "4g"))


@pytest.fixture(scope="session")
def spark_global(spark):
    """The session under a name that property tests may use across their examples."""
    return spark
