import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulse.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "pulse-tests", "local[8]", 4, spark__ui__enabled="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="pulse-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted row tuples of a small result."""
    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    return collect
