import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Random prose of a seed."""

    def make(seed: int, words: int, vocabulary: int = 400) -> str:
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary):x}" for _ in range(words))

    return make
