import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ontoloom.session import local_session, ship_package

    session = local_session("tests", cpus=4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
