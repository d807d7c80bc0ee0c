import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from commitflow.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("local[4]", "commitflow-tests")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="commitflow-tests-"))
    yield session
    session.stop()


@pytest.fixture
def small_buckets(monkeypatch):
    """Many sort ranges even on a few rows."""
    from commitflow.operators import rows

    monkeypatch.setattr(rows, "MIN_ROWS_PER_BUCKET", 5)
    monkeypatch.setattr(rows, "ROWS_PER_BUCKET", 40)


@pytest.fixture
def tmp(tmp_path):
    return str(tmp_path)
