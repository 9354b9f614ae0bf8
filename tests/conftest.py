import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from hostguard.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("hostguard-tests", cores="4", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()
