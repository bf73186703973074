import os
import random
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(os.path.dirname(HERE))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, HERE)

from made import COLUMNS, prose, rows_of  # noqa: E402


@pytest.fixture(scope="session")
def frame(spark):
    def make(texts, **more):
        return spark.createDataFrame(rows_of(texts, **more), COLUMNS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one-word, repeated, long, many-word, line-separated and symbol-only texts."""
    rng = random.Random(3)
    common = prose(rng, 40)
    long = prose(rng, 30_000)
    near = common.split()
    near[20] = "changed"
    return [None, "", "  \n\t ", "one", "two words", common, common, " ".join(near), "\n".join(common.split()), long, "12345 $$$ 678", "x" * 50_000, prose(rng, 300) + " " + common, "É ñandú ß ıstanbul <|endoftext|> \x1c end."]
