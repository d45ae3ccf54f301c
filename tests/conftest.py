import os
import sys
from pathlib import Path

import pytest

HOME = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(HOME))
os.environ["PYTHONPATH"] = f"{HOME}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from tabloom.session import local_session

    session = local_session("4", 4, "3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
