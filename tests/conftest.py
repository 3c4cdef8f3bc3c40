import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
sys.path.insert(0, os.path.dirname(HERE))

from compare import test_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = test_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
