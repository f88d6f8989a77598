import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from slotwise.session import local_session

    s = local_session("*", 8, app="slotwise-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from slotwise.sources.seed import seed_rows

    return seed_rows(spark)
