import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ensemble.session import checkpoint_dir, local_session
    s = local_session(4, shuffle_partitions=8, app="ensemble-tests")
    checkpoint_dir(s)
    yield s
    s.stop()
