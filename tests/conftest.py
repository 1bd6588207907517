import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from txrisk.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8, app_name="txrisk-tests", driver_memory="8g")
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
