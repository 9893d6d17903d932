import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from hirelake.session import local_session
    s = local_session(cores=8, shuffle_partitions=8, app="hirelake-tests")
    yield s
    s.stop()
