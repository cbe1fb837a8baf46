import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from codeloom.session import local_session

    s = local_session(8, "codeloom-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()
