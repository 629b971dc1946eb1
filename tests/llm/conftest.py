import random

import pytest


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(3)
    return ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
