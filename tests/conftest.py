import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyforge.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", "tallyforge-tests", spark__sql__shuffle__partitions="4")
    yield s
    s.stop()
