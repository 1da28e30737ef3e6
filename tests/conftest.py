import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from wavecrest.session import build_session

    return build_session("local[4]", 4)


@pytest.fixture(scope="session")
def sf_dir():
    return SF
