import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wakloom.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
