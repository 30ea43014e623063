import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quadrant.session import checkpoint_dir, local_session
    s = local_session("*", 8)
    checkpoint_dir(s)  # tests only: no cluster-provided folder
    yield s


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
