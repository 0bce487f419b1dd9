from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("TABVET_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tabvet.session import local_session

    s = local_session(master="local[4]", shuffle_partitions=4, app="tabvet-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL
