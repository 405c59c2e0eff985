import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewright.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def folder():
    """A new folder per test; left in place."""
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def by(df, *keys):
    """{key or key tuple: row dict} of a small result."""
    out = {}
    for r in df.collect():
        k = tuple(r[x] for x in keys)
        out[k[0] if len(k) == 1 else k] = r.asDict()
    return out


@pytest.fixture(scope="session")
def rows_by():
    return by
