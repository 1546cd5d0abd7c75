import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from papyra.session import build_session
    s = build_session("local[4]", 8, app_name="papyra-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    # a fresh folder per test; never reused, never cleared
    return tempfile.mkdtemp(prefix="papyra-test-")
