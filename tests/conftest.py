import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from triptych.session import local_session  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not Path(TABLES).exists():
        pytest.skip("no test tables")
    return TABLES
