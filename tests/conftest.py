import logging
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stockline import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    logging.getLogger("py4j").setLevel(logging.ERROR)
    s = session.prepare(session.build("tests", "4", 4))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
