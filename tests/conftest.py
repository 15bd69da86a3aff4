import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sprank.session import get_session, ship_package
    s = get_session("local[*]", "sprank-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()
