import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from kpiforge.session import local_session

    return local_session(cores="*", shuffle_partitions=8, app="kpiforge-tests")


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)
