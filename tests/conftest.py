import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from plyframe.session import checkpoint_root, local_session, ship_package
    s = local_session(cores="*", shuffle_partitions=8)
    checkpoint_root(s)
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path_factory):
    """A fresh directory per test (never reused, never cleared)."""
    return tempfile.mkdtemp(prefix="plyframe-test-", dir=str(tmp_path_factory.getbasetemp()))
