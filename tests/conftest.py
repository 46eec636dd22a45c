import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pagemill.session import build

    s = build("local[4]", 4, "4g", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
