import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wattloom.session import build_session
    session = build_session("tests", 8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
