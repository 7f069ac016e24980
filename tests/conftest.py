import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loomspan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, 8, "6g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("wh")))
    yield session
    session.stop()
