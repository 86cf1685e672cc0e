import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import session

    s = session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def lines(spark):
    """A small corpus of five lines."""
    text = ["this is weird", "I'm not pleased", "with what's going on", "with the code for the", "sed scripts. I have written"]
    return spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
