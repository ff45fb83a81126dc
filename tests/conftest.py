import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from slickwatch.session import local_session, prepare

    session = prepare(local_session("tests", "4", 4))
    yield session
    session.stop()
