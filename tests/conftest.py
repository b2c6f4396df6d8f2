import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from quillhawk.runtime import local_session, release_staged

    session = local_session(os.environ.get("TEST_CPUS", "4"), "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release_staged(session)
    session.stop()
