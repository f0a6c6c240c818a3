import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONHASHSEED", "0")

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from sillok.session import local_session

    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    yield session
    session.stop()
