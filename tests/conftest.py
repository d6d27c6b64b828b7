import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from clipgraph.registry.check import session

    s = session()
    yield s
    s.stop()
