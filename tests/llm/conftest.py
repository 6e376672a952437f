import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=5):
    """Small documents with copies, near copies, shared passages, junk, nulls, repeated rows and one long text."""
    rng = random.Random(seed)
    words = ["the", "of", "and", "a", "is", *("".join(rng.choice("abcdefghijklmnoé") for _ in range(rng.randint(2, 7))) for _ in range(400))]
    passage = " ".join(rng.choice(words) for _ in range(50))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(n)]
    for i in range(0, n, 9):
        texts[i] += "\n" + passage
    texts[3] = texts[2]
    near = texts[12].split()
    near[len(near) // 2] = "changed"
    texts[13] = " ".join(near)
    texts[20], texts[21], texts[22], texts[23], texts[24] = None, "", " \t\n", "x", "same same same same same same " * 20
    texts[25] = " ".join(rng.choice(words) for _ in range(6000))
    rows = [(i, t, "en", None if i % 11 == 0 else f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id at all here", "en", "src1", 17), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
