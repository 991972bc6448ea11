import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from tarmac.session import local_session

    session = local_session(os.environ.get("TARMAC_TEST_CPUS", "8"), "tarmac-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
