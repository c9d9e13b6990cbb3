from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from starcart.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="starcart-tests")
    yield s
    s.stop()
