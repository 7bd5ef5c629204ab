import random

import pytest

SYLLABLES = "th er on an re he in ed nd ha en at is or te".split()


@pytest.fixture(scope="session")
def words():
    """A seeded source of invented words."""
    rng = random.Random(5)

    def make(n: int) -> str:
        return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))

    return make


def docs_df(spark, rows):
    """``documents`` from (doc_id, text) pairs, with the other columns."""
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
