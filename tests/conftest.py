import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    return build_session(master="local[*]", shuffle_partitions=8, app="tidemark-tests")


@pytest.fixture
def scratch(spark):
    """A new path in the shared folder for each test."""
    from tidemark.session import scratch_path

    return lambda name="t": scratch_path(spark, name)
