import os
import sys
from datetime import date, timedelta

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, "/opt/oracle"]

from pairwell.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4, "pairwell-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def day():
    """``day(5)``: the fifth day after 2021-01-01; None stays None."""
    return lambda n: None if n is None else date(2021, 1, 1) + timedelta(days=n)
