import pytest

WORDS = "alder birch cedar delta ember fjord grove heath inlet jetty knoll larch maple night ocean plain quarry river stone thorn umbra vale willow yarrow zephyr amber brook cliff dune eddy".split()


@pytest.fixture(scope="session")
def prose():
    """A text of n words, the same for the same seed."""
    import random

    def make(seed, n, every=9):
        rng = random.Random(seed)
        out = []
        for i in range(n):
            w = rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "ly"])
            out.append(w + ("." if i % every == every - 1 else ""))
        return " ".join(out)

    return make
