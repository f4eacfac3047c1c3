import random

import pytest

WORDS = ["alpha", "beta", "γάμμα", "d", "epsilon zeta", "--", "\n", "x" * 30, "lorem", "ipsum", "dolor\tsit", "Amet."]


def words(rng: random.Random, count: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(count))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Null and empty texts, blanks only, repeated rows, long runs, near and exact copies."""
    rng = random.Random(7)
    passages = [words(rng, rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else words(rng, rng.randint(1, 40)) for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(parts)))
    rows[3], rows[5], rows[6] = (3, None), (5, ""), (6, " \t\r\n")
    rows[7], rows[13], rows[9], rows[11] = (7, "a" * 500), (13, "a" * 130), (9, "ab" * 400), (11, "ab" * 400)
    long = words(rng, 5000)
    rows[20], rows[21], rows[22] = (20, long), (21, long + " end"), (22, long.upper())
    rows += [rows[30], rows[31]]
    return rows
