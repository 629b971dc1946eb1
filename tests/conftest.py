import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from oracle import make_session
    from tripleloom.functions.session import configure
    return configure(make_session())


@pytest.fixture(scope="session")
def duck():
    from oracle import duck
    return duck("/root/testdata/sf0.001")
