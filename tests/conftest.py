import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import local_session

    s = local_session("*", shuffle_partitions=8, max_failures=4)
    yield s
    s.stop()
