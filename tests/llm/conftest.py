import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_key` string, tree int, `doc id` string"


@pytest.fixture
def make(spark):
    """Documents of (id, text) pairs, with columns whose names could clash."""

    def of(rows, parts=3):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "k", 1, "x") for i, t in rows], SCHEMA).repartition(parts)

    return of


@pytest.fixture(scope="session")
def prose():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(r.randint(2, 9))) for _ in range(400)]

    def of(n, seed):
        q = random.Random(seed)
        return " ".join(q.choice(vocabulary) + q.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))

    return of
